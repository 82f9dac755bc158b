"""Runs from folders to tables and from diffs to reviews, the store's commits, plug-ins, reports."""

import pytest
from pyspark.sql import functions as F

from spanforge.operators import graph, mutation, plugins, report, review, search
from spanforge.plans import runs


@pytest.fixture
def store(spark, tmp_path):
    return mutation.Store(spark, f"file://{tmp_path}/store", buckets=4)


def put(root, **contents):
    for name, body in contents.items():
        path = root / name.replace("__", "/").replace("_py", ".py").replace("_go", ".go")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)


def test_index_and_review(spark, tmp_path, store):
    root = tmp_path / "repo"
    put(root, app_py="import os\nimport util\n\ndef run():\n    return helper(1)\n", util_py="def helper(x):\n    return x\n", core__auth_py="import util\n\nhelper(2)\n", bad_py="def (:\n")
    first = runs.index(spark, store, str(root), "r", head="c1")
    assert first == {"mode": "full", "status": "partial", "files": 4, "deleted": 0, "errors": 1}
    assert store.metadata("commit:r") == "c1" and runs.counts(store, "r")["file"] == 4 and runs.counts(store, "other")["file"] == 0
    edges = {(r.src, r.type, r.dst) for r in store.read("edge").collect()}
    assert {("app.py", "IMPORTS", "util"), ("app.py", "CALLS", "helper"), ("util.py", "DEFINES", "helper"), ("r", "CONTAINS", "util.py")} <= edges
    assert not any(dst == "os" for _, _, dst in edges)
    assert store.read("vector").where("size(embedding) <> 64 or text is null").count() == 0

    put(root, app_py="def run():\n    return 2\n", new_py="import util\n")
    (root / "core" / "auth.py").unlink()
    letters = spark.createDataFrame([("M", "app.py", None), ("A", "new.py", None), ("D", "core/auth.py", None)], "letter string, path string, new_path string")
    second = runs.index(spark, store, str(root), "r", head="c2", changes=letters)
    assert second == {"mode": "incremental", "status": "success", "files": 2, "deleted": 1, "errors": 0}
    assert {r.path for r in store.read("file").collect()} == {"app.py", "util.py", "bad.py", "new.py"}
    assert ("app.py", "IMPORTS", "util") not in {(r.src, r.type, r.dst) for r in store.read("edge").collect()}
    assert runs.index(spark, store, str(root), "r", head="c2", changes=letters)["mode"] == "nothing"
    whole = mutation.Store(spark, f"file://{tmp_path}/other")
    runs.index(spark, whole, str(root), "r", head="c2")
    for name in runs.TABLES:  # an update gives what indexing anew gives
        assert sorted(map(str, store.read(name).collect())) == sorted(map(str, whole.read(name).collect())), name

    diff = spark.createDataFrame([("diff --git a/util.py b/util.py\n+import os\n-def helper(x):\ndiff --git a/x.lock b/x.lock\n+1\n",)], "diff string")
    contents = spark.createDataFrame([("new.py", "import util\n"), ("../new.py", "no"), ("app.py", None)], "path string, content string")
    rules = [{"id": "os", "type": "banned_import", "pattern": "os", "severity": "block", "message": "m"}]
    got = runs.reviewed(store, "r", diff, contents, rules)
    assert [r.path for r in got["changed"].collect()] == ["util.py"]
    assert [(r.policy_id, r.path) for r in got["violations"].collect()] == [("os", "util.py")]
    assert [(r.changed, r.path, r.score) for r in got["impact"].collect()] == [("util.py", "new.py", 1.0)]
    assert [(r.path, r.content) for r in got["context"].collect()] == [("new.py", "import util\n")]
    assert got["verdict"].first().risk_level == "UNKNOWN"
    alone = spark.createDataFrame([("diff --git a/app.py b/app.py\n+x = 1\n",)], "diff string")
    assert runs.reviewed(store, "r", alone, contents, rules)["verdict"].first().risk_level == "SAFE"


def test_commits_are_whole(spark, store, monkeypatch):
    a, b = spark.createDataFrame([("r", "a", 1)], "repo_id string, path string, n int"), spark.createDataFrame([("r", "b", 1)], "repo_id string, path string, n int")
    store.commit({"one": store.written("one", a), "two": store.written("two", b)}, {"note": "1"})
    before = store.state()
    new = {"one": store.replaced("one", a.select("repo_id", "path"), ["repo_id", "path"], b), "two": store.replaced("two", b.select("repo_id", "path"), ["repo_id", "path"])}

    class Crash(Exception):
        pass

    def crash(*_):
        raise Crash

    monkeypatch.setattr(mutation.json, "dumps", crash)  # after the tables are written, before the state is
    with pytest.raises(Crash):
        store.commit(new, {"note": "2"})
    monkeypatch.undo()
    assert store.state() == before and store.read("one").first().path == "a" and store.read("two").count() == 1
    late = store.state()
    store.commit(new, {"note": "2"})
    assert (store.read("one").first().path, store.read("two").count(), store.metadata("note")) == ("b", 0, "2")
    with pytest.raises(OSError, match="another writer"):
        store.commit(metadata={"note": "3"}, state=late)
    assert store.metadata("note") == "2" and store.read("one", 0).first().path == "a"


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = mutation.Store(spark, f"file://{tmp_path}/s", buckets=16)
    rows = spark.range(200).select(F.lit("r").alias("repo_id"), F.concat(F.lit("p"), "id").alias("path"), F.col("id").alias("n"))
    store.write("file", rows)
    before = store.state()["tables"]["file"]["versions"][-1]
    store.merge("file", rows.where("n = 7").withColumn("n", F.lit(700).cast("long")), ["repo_id", "path"])
    after = store.state()["tables"]["file"]["versions"][-1]
    assert sum(before[k] != after[k] for k in before) == 1 and store.read("file").agg(F.sum("n")).first()[0] == sum(range(200)) + 693
    assert store.remove("file", rows.where("n in (3, 4)"), ["repo_id", "path"]) == 2 and store.read("file").count() == 198
    assert store.remove("file", rows.limit(0), ["repo_id", "path"]) == 0
    store.vacuum("file")
    assert store.read("file").count() == 198


def test_policies_and_pull_requests(spark, store):
    rule = lambda i, severity="warn": (i, "banned_import", "os", severity, "m", None)
    table = lambda *rows: spark.createDataFrame(list(rows), mutation.POLICY)
    mutation.put_policies(store, table(rule("b"), rule("a")))
    mutation.put_policies(store, table(rule("b", "block")))
    assert [(r.id, r.severity) for r in mutation.policies(store).collect()] == [("a", "warn"), ("b", "block")]
    with pytest.raises(ValueError, match="severity"):
        mutation.put_policies(store, table(rule("c", "panic")))
    assert mutation.drop_policy(store, "a") and not mutation.drop_policy(store, "a")
    store.write("file", spark.createDataFrame([("r", "a.py"), ("s", "b.py")], "repo_id string, path string"))
    requests = spark.createDataFrame([("r", 1, "one")], "repo_id string, number long, title string")
    changed = spark.createDataFrame([("r", 1, "a.py"), ("r", 1, "b.py"), ("s", 2, "b.py")], "repo_id string, number long, path string")
    for _ in range(2):
        mutation.put_pull_requests(store, requests, changed)
        assert [tuple(r) for r in store.read("modifies").select("repo_id", "number", "path").collect()] == [("r", 1, "a.py")]
    assert [tuple(r) for r in graph.pull_request_impact(store.read("modifies"), store.read("file"), spark.createDataFrame([("r", "a.py", "f"), ("s", "a.py", "g")], "repo_id string, src string, name string")).collect()] == [(1, "r", "a.py", "f")]


def test_repositories_are_apart(spark):
    edges = spark.createDataFrame([(s, "File", d, "Module", "IMPORTS", r) for r in "pq" for s, d in (("main", r + "1"), ("other", r + "1"))], "src string, src_label string, dst string, dst_label string, type string, repo_id string")
    walk = lambda repo: {r.repo_id for r in graph.traverse(edges, spark.createDataFrame([("File", repo, "main")], "label string, repo string, id string"), 3)[1].collect()}
    assert walk("p") == {"p"} and walk("q") == {"q"} and walk("") == {"p", "q"} and walk("x") == set()
    pool = spark.createDataFrame([(0, 1, "p", "main", 0.5), (0, 2, "q", "other", 0.4)], "qid long, id long, repo_id string, path string, score double")
    assert {r.id: r.score for r in search.boosted(pool, edges).collect()} == {1: 0.5, 2: 0.4}
    pool = pool.withColumn("repo_id", F.lit("p"))
    assert {r.id: r.score for r in search.boosted(pool, edges).collect()} == {1: 0.55, 2: 0.45}


def test_plugins(spark):
    made = plugins.Registry("adapter")
    made.register("one", lambda x: x + 1)
    with pytest.warns(UserWarning, match="replaced"):
        made.register("one", lambda x: x + 2)
    assert made.create("one", 1) == 3
    with pytest.raises(ValueError, match="there are: one"):
        made.create("two")
    nodes = spark.createDataFrame([("call", "1"), ("odd", "2"), (None, "3")], "type string, id string")
    assert {r.id: r.status for r in plugins.processed(nodes, {"call": lambda x: x}).collect()} == {"1": "success", "2": "failed", "3": "failed"}
    assert plugins.staged(nodes, lambda x: x.where("id > 1"), lambda x: x.limit(1)).count() == 1
    assert plugins.missing_methods(made, mutation.Store) and plugins.missing_methods(made, plugins.Registry) == []


def test_reports_say_what_they_leave_out(spark):
    rows = spark.range(1, 251).select(F.col("id").cast("int").alias("rank"), F.concat(F.lit("p"), "id").alias("path"), F.lit(0.5).alias("score"))
    assert report.search_report(rows).endswith("... and 50 more") and len(report.search_report(rows, most=300).split("\n")) == 250
    assert report.to_json(rows).count("rank") == 250 and report.to_json(rows, most=3).count("rank") == 3
    edges = rows.select(F.lit("a").alias("src"), F.col("path").alias("dst"), F.lit("CALLS").alias("type"))
    assert "%% 50 more edges" in report.diagram(edges, "a") and "more" not in report.diagram(edges, "a", most=250)


def test_search_takes_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [0.0, 0.0]), (6, [1.0]), (7, [0.0, None]), (8, [1.0, 0.0]), (9, [0.5, 0.0])]
    corpus = spark.createDataFrame(rows, "id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (50, None), (51, [0.0, 0.0])], "qid long, query array<double>")
    assert [(r.qid, r.id, r.score, r["rank"]) for r in search.nearest(corpus, queries, 2).orderBy("rank").collect()] == [(1, 8, 1.0, 1), (1, 9, 1.0, 2)]
    assert search.nearest(corpus.limit(0), queries, 2).count() == search.nearest(corpus, queries.limit(0), 2).count() == 0


def test_flagged_results(spark):
    rows = spark.createDataFrame([("a", "SAFE"), ("b", "HIGH"), ("c", None)], "path string, risk_level string")
    risky, safe = review.flagged(rows)
    assert {r.path for r in risky.collect()} == {"b", "c"} and {r.path for r in safe.collect()} == {"a"}
