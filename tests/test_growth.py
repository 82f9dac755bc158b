"""Joins whose pairs grew with the square of the tables: now counted or matched by group, with the same results."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.operators import graph, impact, retrieval, review, search, substring
from spanforge.plans import views


def test_symbols_that_many_files_have_make_no_pairs(spark):
    files = spark.range(40000).select(F.concat(F.lit("d"), "id", F.lit(".py")).alias("path"), F.concat(F.lit("s"), F.expr("id % 2")).alias("symbol"))
    files = files.select("path", "symbol", F.concat(F.lit("mod "), "symbol", F.lit("0")).alias("content"))
    began = time.monotonic()
    found = review.symbol_references(files, files).groupBy("symbol", "files").count().collect()
    assert {tuple(r) for r in found} == {("s0", 19999, 20000), ("s1", 19999, 20000)}
    assert time.monotonic() - began < 60  # 800 million pairs took minutes
    odd = spark.createDataFrame([("a.py", "x", "use xy"), (None, "x", "use x"), ("b.py", None, "use x"), ("c.md", "x", "use x"), ("d.py", "q", None)], "path string, symbol string, content string")
    assert {tuple(r) for r in review.symbol_references(odd, odd).collect()} == {("a.py", "x", 1), (None, "x", 0), ("b.py", None, 0), ("c.md", "x", 2), ("d.py", "q", 0)}


def test_policies_of_one_pattern_are_tested_once(spark):
    rules = [(f"r{i}", "protected_write", p, "warn", "m") for i, p in enumerate(["*e*"] * 3000 + ["src/*"] * 3 + ["src/e1", "*1"])]
    policies = spark.createDataFrame(rules, "id string, type string, pattern string, severity string, message string")
    paths = spark.createDataFrame([("src/e1",), ("src/x",), ("e2",), ("src/x",)], "path string")
    got = review.path_violations(policies, paths)
    hits = lambda p: {"*e*": "e" in p, "src/*": p.startswith("src/"), "src/e1": p == "src/e1", "*1": p.endswith("1")}
    want = sorted((r[0], p) for r in rules for p in ("src/e1", "src/x", "e2", "src/x") if hits(p)[r[2]])
    assert sorted((r.policy_id, r.path) for r in got.collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    tested = next(line for line in plan.splitlines() if "RLIKE" in line)
    assert "pattern" in plan and "severity" not in tested and "policy_id" not in tested


CATEGORIES = [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (3, "b"), (4, "c"), (5, None), (6, "a"), (None, "a"), (7, "b"), (7, "a")]


def test_members_of_a_category_are_counted_once_for_all_queries(spark):
    members = spark.createDataFrame(CATEGORIES, "id long, category string")
    asked = members.select(F.col("id").alias("qid"), "category")
    results = spark.createDataFrame([(q, i, k) for q in range(1, 8) for k, i in enumerate([(q + j) % 8 for j in range(1, 7)], 1)], "qid long, id long, rank int")
    gold = asked.join(members, "category").where("id <> qid").select("qid", F.col("id").alias("expected")).distinct()
    want = sorted(map(tuple, retrieval.judged(results, gold).collect()))
    assert sorted(map(tuple, retrieval.judged_by_category(results, asked, members).collect())) == want and len(want) == 5


def test_paths_of_a_category_are_matched_once_for_all_queries(spark):
    rows = [(i, c, e) for (i, c), e in zip(CATEGORIES, ["a.py", "b.py", "A.py", "lib/a.py", None, "x.py", "y.py", "B.py", "z.py", "q/a.py", "q/a.py"], strict=True)]
    members = spark.createDataFrame(rows, "id long, category string, expected string")
    asked = members.select(F.col("id").alias("qid"), "category")
    results = spark.createDataFrame([(q, p, k) for q in range(1, 8) for k, p in enumerate(["src/a.py", "b.py", "z.py", "a.py", None], 1)], "qid long, path string, rank int")
    gold = asked.join(members, "category").where("id <> qid").select("qid", "expected")
    assert sorted(map(tuple, retrieval.suffix_matches_by_category(results, asked, members).collect())) == sorted(map(tuple, retrieval.suffix_matches(results, gold).collect()))
    assert sorted(map(tuple, retrieval.judged_by_path_and_category(results, asked, members).collect())) == sorted(map(tuple, retrieval.judged_by_path(results, gold).collect()))


def test_each_text_is_read_once_for_all_needles(spark):
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("aé:s12") for _ in range(n))
    texts = [(i, word(rnd.randint(0, 60))) for i in range(300)] + [(None, "a::s1"), (301, None), (302, ""), (302, "s1s1")]
    needles = [(i, word(rnd.randint(0, 5))) for i in range(150)] + [(200, None), (201, "::s1"), (201, "::s1"), (202, texts[7][1]), (203, "s1" * 20)] + [(300 + i, word(i)) for i in range(6, 25)]
    want = sorted(((q, i) for q, x in needles if x is not None for i, t in texts if t is not None and x in t), key=str)
    d, n = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(needles, "qid long, needle string")
    for most in (substring.NEEDLE_BYTES, 4000):
        assert sorted(map(tuple, substring.scan(d, n, most_bytes=most).collect()), key=str) == want
    assert substring.scan(d, n.limit(0)).count() == substring.scan(d.limit(0), n).count() == 0


@pytest.mark.parametrize("texts", [5, 3000])
def test_windows_across_steps_of_a_long_text(monkeypatch, texts):
    monkeypatch.setattr(substring, "STEP", 64)
    rnd = random.Random(texts)
    rows = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 4000 // texts + 9))).encode() for _ in range(texts)]
    needles = ["".join(rnd.choice("ab") for _ in range(n)).encode() for n in range(1, 30)] + [rows[-1], rows[0] + b"b"]
    ends = np.cumsum([len(r) for r in rows])
    text, needle = substring.Needles(needles, 3).hits(np.frombuffer(b"".join(rows), np.uint8), ends)
    assert list(zip(text.tolist(), needle.tolist(), strict=True)) == [(i, j) for i, r in enumerate(rows) for j, n in enumerate(needles) if n in r]


def test_scores_of_many_queries_are_taken_in_steps(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(400, 6))
    x[50:120] = x[50]  # more equal vectors than are asked for
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").coalesce(2)
    queries = rows.where("id % 4 = 0").selectExpr("id AS qid", "embedding AS query")
    score = np.round((x / np.linalg.norm(x, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T, 6)
    want = sorted((q, i, k) for q in range(0, 400, 4) for k, i in enumerate(sorted((j for j in range(400) if j != q), key=lambda j: (-score[q, j], j))[:7], 1))
    shown = []
    for steps, most in ((1 << 22, search.MOST_BYTES), (300, search.MOST_BYTES), (300, 2000)):
        monkeypatch.setattr(search, "STEP_SCORES", steps)
        assert sorted((r.qid, r.id, r["rank"]) for r in search.nearest(rows, queries, 7, most_bytes=most).collect()) == want
        shown.append(sorted((r.qid, r.hits, r.best) for r in search.alike(rows, queries, 0.5, most_bytes=most).collect()))
    assert shown[0] == shown[1] == shown[2]


def test_edges_are_made_in_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(views, "LINES", 1000)
    v = views.Views(spark, "/root/testdata/sf0.001")
    assert v.parts == -(-v.table("lineitem").count() // 1000) > 4
    assert f"({'l_orderkey'}" in v.imports._jdf.queryExecution().optimizedPlan().toString().replace("RepartitionByExpression [", "(")


def test_exploration_of_all_nodes_needs_no_focus(spark):
    edges = spark.createDataFrame([("f1", "m", "IMPORTS", "r"), ("f2", "m", "IMPORTS", "r"), ("f1", "s", "CALLS", "q")], "src string, dst string, type string, repo_id string")
    nodes = edges.selectExpr("repo_id", "explode(array(src, dst)) AS node").distinct()
    for most in (None, 1):
        assert sorted(map(str, graph.explore(edges, most=most).collect())) == sorted(map(str, graph.explore(edges, nodes, most).collect()))


def test_an_impact_radius_needs_no_row_for_each_importer_of_a_symbol(spark, monkeypatch):
    monkeypatch.setattr(impact, "symbol_importers", None)  # makes a row for each pair of a file and an importer
    rnd = random.Random(11)
    files = [("r", f"{rnd.choice(['core/', 'src/', 'src/'])}p{i}.rs") for i in range(70)]
    pick = lambda n: sorted({(*rnd.choice(files), f"s{min(rnd.randrange(9), rnd.randrange(9))}") for _ in range(n)})
    defines, calls = pick(60), pick(260)
    imports = sorted({(*rnd.choice(files), f"p{rnd.randrange(70)}::s{rnd.randrange(9)}") for _ in range(200)})
    table = lambda rows, name: spark.createDataFrame(rows, f"repo_id string, path string, {name} string")
    for limit in (2, 5, 10):
        want = set()
        for _, x in files:
            scores = []
            own = {n for _, p, n in defines if p == x}
            for _, y in files:
                stem = any(p == y and m.startswith(x.split("/")[1][:-3]) for _, p, m in imports)
                call = any(p == y and n in own for _, p, n in calls)
                symbol = any(p == y and m.endswith(n) for _, p, m in imports for n in own)
                if x != y and (stem or call or symbol):
                    scores.append((-(stem + call + symbol / 2 + 5 * y.startswith("core")), y, "IMPORTS" if stem or not call else "CALLS"))
            want |= {(x, y, -s, kind, k) for k, (s, y, kind) in enumerate(sorted(scores)[:limit], 1)}
        got = impact.radius(spark.createDataFrame(files, "repo_id string, path string"), table(imports, "module"), table(defines, "name"), table(calls, "name"), limit)
        assert {(r.changed, r.path, r.score, r.relationship, r["rank"]) for r in got.collect()} == want


def test_shared_edges_are_made_distinct_as_numbers(spark):
    v = views.Views(spark, "/root/testdata/sf0.001")
    plain = v.graph.withColumn("src", v.shared_path("src")).distinct()
    assert v.sedge.exceptAll(plain).isEmpty() and plain.exceptAll(v.sedge).isEmpty()
    keys = [line.split("Aggregate [")[1].split("]")[0] for line in v.sedge._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [" in line]
    assert keys and all("src" not in line and "dst" not in line for line in keys)


@pytest.mark.parametrize("most", [1, 3, 32])
def test_callers_of_several_names_need_no_row_for_each_pair_of_files(spark, monkeypatch, most):
    monkeypatch.setattr(impact, "callers", None)  # makes them
    monkeypatch.setattr(impact, "MOST_NAMES", most)
    rnd = random.Random(most)
    files = [(r, f"f{i}") for r in "pq" for i in range(60)]
    pick = lambda n, names: [(*rnd.choice(files), f"s{min(rnd.randrange(names), rnd.randrange(names))}") for _ in range(n)]
    defines = pick(150, 12) + [("p", "f1", None), ("p", None, "s1"), (None, "f1", "s1"), ("p", "gone", "s1"), *[("q", "f2", f"s{i}") for i in range(40)]]
    calls = pick(250, 12) + [("p", "f3", None), ("p", None, "s1"), (None, "f3", "s1"), *[("q", f, f"s{i}") for f in ("f2", "f4") for i in range(40)]]
    table = lambda rows: spark.createDataFrame(rows, "repo_id string, path string, name string")
    want = {}
    for r, x in files:
        own = {n for repo, p, n in defines if (repo, p) == (r, x) and n}
        if found := {p for repo, p, n in calls if repo == r and n in own and p not in (None, x)}:
            want[r, x] = len(found)
    got = impact.caller_counts(spark.createDataFrame(files, "repo_id string, path string"), table(defines), table(calls)).collect()
    assert {(r.repo_id, r.changed): r.callers for r in got} == want and len(got) == len(want)
