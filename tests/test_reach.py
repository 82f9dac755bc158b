"""Walks from many starts, and counts of co-references, against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spanforge.operators import graph, search
from spanforge.plans import staging

EDGE = "src string, src_label string, dst string, dst_label string, type string, repo_id string"


@pytest.fixture(scope="module")
def net(spark):
    """Two repositories with equal paths, a hub, a loop, a cycle and a node alone."""
    rnd = random.Random(7)
    rows = {(f"f{rnd.randrange(40)}", "File", f"m{rnd.randrange(25)}", "Module", "IMPORTS", r) for r in "pq" for _ in range(45)}
    rows |= {(f"f{i}", "File", "hub", "Module", "IMPORTS", "p") for i in range(0, 40, 2)}
    rows |= {("f1", "File", "f1", "File", "CALLS", "p"), ("f3", "File", "f5", "File", "CALLS", "p"), ("f5", "File", "f3", "File", "CALLS", "p")}
    return sorted(rows), spark.createDataFrame(sorted(rows), EDGE)


def brute(rows, starts, depth):
    nodes, edges = set(), set()
    near = defaultdict(list)
    for e in rows:
        a, b = (e[1], e[5], e[0]), (e[3], e[5], e[2])
        near[a].append((b, e))
        near[b].append((a, e))
    for qid, label, repo, name in starts:
        first = [n for n in near if n[0] == label and n[2] == name] if not repo else [(label, repo, name)]
        nodes |= {(qid, *n, 0) for n in first}
        seen, frontier = set(first), set(first)
        for d in range(depth):
            met = {(b, e) for n in frontier for b, e in near.get(n, [])}
            edges |= {(qid, *e) for _, e in met}
            frontier = {b for b, _ in met} - seen
            seen |= frontier
            nodes |= {(qid, *n, d + 1) for n in frontier}
    return nodes, edges


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_walks_equal_brute_force(spark, net, depth):
    rows, edges = net
    starts = [(1, "File", "p", "f0"), (2, "File", "", "f1"), (3, "Module", "q", "m3"), (4, "File", "p", "nowhere"), (5, "File", "", "nowhere"), (6, "File", "q", "f0")]
    table = spark.createDataFrame(starts, "qid long, label string, repo string, id string")
    want = brute(rows, starts, depth)
    for neighbours in (graph.by_both_ends(edges), graph.adjacency(edges, buckets=3)):
        got = graph.traverse_from(neighbours, table, depth)
        assert tuple({tuple(r) for r in x.collect()} for x in got) == want
        assert [x.count() for x in got] == [len(x) for x in want]


def test_a_hops_plan_does_not_grow_and_bucketed_neighbours_stay(spark, net):
    _, edges = net
    starts = spark.createDataFrame([(1, "File", "p", "f0")], "qid long, label string, repo string, id string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        neighbours = graph.adjacency(edges, buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
        plan = neighbours.join(starts, graph.NODE)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1  # of the starts
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scans = [graph.traverse_from(neighbours, starts, d)[1]._jdf.queryExecution().executedPlan().toString().count("FileScan") for d in (2, 3)]
    assert scans == [2, 3]


@pytest.mark.parametrize("hashed", [0, 1 << 18])
def test_hops_move_numbers_and_do_not_sort_neighbours(spark, net, monkeypatch, hashed):
    rows, edges = net
    number = lambda c: F.expr(f"cast(substr({c}, 2) as bigint)").alias(c)
    as_numbers = edges.where("dst <> 'hub'").withColumns({"src": number("src"), "dst": number("dst")})
    monkeypatch.setattr(graph, "HASHED", hashed)
    neighbours = graph.adjacency(as_numbers, buckets=5)
    assert "edge" not in neighbours.columns and dict(neighbours.dtypes)["id"] == dict(neighbours.dtypes)["to"] == "bigint"
    plans, staged = [], graph.staging.staged

    def seen(df, name, by=None):
        plans.extend([df._jdf.queryExecution().executedPlan().toString()] if name == "hop" else [])
        return staged(df, name, by)

    monkeypatch.setattr(graph.staging, "staged", seen)
    starts = [(1, "File", "p", 0), (2, "File", "", 1), (3, "Module", "q", 3), (4, "File", "p", 12345)]
    numbered = [(int(e[0][1:]), e[1], int(e[2][1:]), *e[3:]) for e in rows if e[2] != "hub"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = graph.traverse_from(neighbours, spark.createDataFrame(starts, "qid long, label string, repo string, id long"), 3, 5)
        assert tuple({tuple(r) for r in x.collect()} for x in got) == brute(numbered, starts, 3)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans) == 3 and all(("Sort [" not in p and "ShuffledHashJoin" in p) == (hashed > 0) for p in plans)


def counts(rows, by):
    files = defaultdict(set)
    for src, _, dst, _, kind, repo in rows:
        files[repo, kind, dst].add(src)
    out = defaultdict(set)
    for (repo, _, _), group in files.items():
        for a in group:
            out[(repo, a) if by else (a,)] |= group - {a}
    return {k: len(x) for k, x in out.items() if x}


@pytest.mark.parametrize("by", [(), ("repo_id",)])
@pytest.mark.parametrize(("light", "subsets"), [(64, 6), (2, 6), (1, 2), (0, 1), (3, 0)])
def test_counts_equal_brute_force(net, by, light, subsets):
    rows, edges = net
    got = {tuple(r)[:-1]: r.neighbours for r in search.co_reference_counts(edges, by, light, subsets).collect()}
    assert got == counts(rows, by)


def test_heavy_targets_are_not_paired(spark):
    """Rows of the largest join grow with the edges, not with their square."""
    rows = [(f"f{i}", "File", f"m{j}", "Module", "IMPORTS", "p") for i in range(3000) for j in {0, 1 + i % 2, 3 + i}]
    got = search.co_reference_counts(spark.createDataFrame(rows, EDGE))
    assert {r.neighbours for r in got.collect()} == {2999}
    staging.clear(spark)
