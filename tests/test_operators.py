"""Operators on small tables with answers worked out by hand."""

import fnmatch
import re
import uuid

import pytest
from pyspark.sql import functions as F

from spanforge.functions import hashing, paths, text
from spanforge.operators import governance, graph, mutation, report, retrieval, review, search
from spanforge.sources import files, languages, parsing
from spanforge.streaming import apply

EDGE = "src string, src_label string, dst string, dst_label string, type string, repo_id string"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())] if values else [(1,)], list(values) or ["x"]).select(column.alias("v")).first().v


@pytest.fixture
def edges(spark):
    f = lambda s, d, r="r": (s, "File", d, "Module", "IMPORTS", r)
    return spark.createDataFrame([f("a", "m"), f("b", "m"), f("b", "n"), f("c", "n"), f("a", "m", "other"), ("a", "File", "g", "Function", "CALLS", "r"), ("c", "File", "c", "File", "CALLS", "r")], EDGE)


def test_neighbours(spark, edges):
    got = {tuple(r) for r in search.co_references(edges).collect()}
    assert got == {("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")}
    assert {tuple(r) for r in search.co_references(edges, spark.createDataFrame([("a",)], ["path"])).collect()} == {("a", "b")}


def test_traversal(spark, edges):
    start = spark.createDataFrame([("File", "", "a")], "label string, repo string, id string")
    reach = lambda d, types=None: {(r.src, r.dst, r.repo_id) for r in graph.traverse(edges.where("repo_id = 'r'"), start, d, types)[1].collect()}
    assert reach(1) == {("a", "m", "r"), ("a", "g", "r")}
    assert reach(2, ["IMPORTS"]) == {("a", "m", "r"), ("b", "m", "r")}
    assert reach(3, ["IMPORTS"]) == reach(2, ["IMPORTS"]) | {("b", "n", "r")}
    assert reach(9) == reach(3) and reach(0) == reach(1) and reach(1) <= reach(2) <= reach(3)
    assert graph.allowed(["nope"]) == list(graph.RELATIONSHIPS)
    with pytest.raises(ValueError, match="nope"):
        graph.allowed(["nope"], strict=True)
    nodes, found = graph.nothing(spark)
    assert nodes.count() == found.count() == 0


def test_statistics(spark):
    nodes = spark.createDataFrame([("a", "r"), ("b", "r"), ("c", "q")], "id string, repo_id string")
    links = spark.createDataFrame([("a", "b", "r")], "src string, dst string, repo_id string")
    assert graph.stats(nodes, links).first().asDict() == {"node_count": 3, "edge_count": 1, "density": 0.166667}
    assert {r.repo_id: r.density for r in graph.stats(nodes, links, ["repo_id"]).collect()} == {"r": 0.5, "q": 0.0}


def test_search(spark):
    rows = [(1, [1.0, 0.0], "src/a.py"), (2, [1.0, 0.0], "tests/b.py"), (3, [0.0, 1.0], "src/c.py"), (4, None, "src/d.py"), (5, [0.0, 0.0], "e"), (6, [1.0], "f")]
    corpus = spark.createDataFrame(rows, "id long, embedding array<float>, path string")
    query = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, query array<float>")
    assert [(r.id, r.score, r.rank) for r in search.nearest(corpus, query, 2).orderBy("rank").collect()] == [(1, 1.0, 1), (2, 1.0, 2)]
    refs = spark.createDataFrame([("src/a.py", "m", "r", "IMPORTS"), ("src/c.py", "m", "r", "IMPORTS")], "src string, dst string, repo_id string, type string")
    got = [(r.id, r.score) for r in search.hybrid(corpus, query, refs, limit=3).orderBy("rank").collect()]
    assert got == [(1, 1.05), (3, 0.05)]
    assert [r.id for r in search.hybrid(corpus, query, refs, limit=3, weight=0, exclude_tests=False).orderBy("rank").collect()] == [1, 2, 3]
    assert search.pool_size(10, exclude_tests=True, boost=True) == 35 and search.pool_size(10, rerank=True) == 100


@pytest.mark.parametrize(("path", "test"), [("a/test_x.py", True), ("a/x_test.py", True), ("a/x_test.js", False), ("x.Spec.ts", True), ("TESTS/x.go", True), ("contest/x.py", False), ("spec", True)])
def test_test_files(spark, path, test):
    assert one(spark, paths.is_test(F.col("p")), p=path) is test


def test_paths(spark):
    assert [one(spark, paths.stem(F.col("p")), p=p) for p in ("a/b.rs", "a/mod.rs", "lib.rs", "x/.env", "a.tar.gz")] == ["b", "a", "", ".env", "a.tar"]
    assert [one(spark, paths.extension(F.col("p")), p=p) for p in ("a/b.rs", ".env", "x.tar.gz", "none")] == [".rs", "", ".gz", ""]
    assert [one(spark, paths.is_ignored(F.col("p")), p=p) for p in ("build/a", "a/build", "x.pyc", "x.egg-info/a", ".env")] == [True, False, True, False, True]
    assert [one(spark, paths.inside("/repo", F.col("p")), p=p) for p in ("a/../b", "../secret", "/repo2/x", "a/../../repo/x")] == [True, False, False, True]


@pytest.mark.parametrize("pattern", ["*.py", "src/*", "a?c", "[ab]*", "[!a]b", "a.b", "*/en/*", "[", "a[b", "x+y", "[a-c]x"])
def test_globs(pattern):
    for name in ("a.py", "src/x/y", "abc", "bcd", "cb", "ab", "a.b", "axb", "x/en/y", "[", "a[b", "x+y", "xxy", "bx", "a\nb"):
        assert bool(re.search(paths.glob_regex(pattern), name)) == fnmatch.fnmatchcase(name, pattern), (pattern, name)


def test_identifiers(spark):
    import hashlib

    digest = hashlib.sha256(b"r:p").hexdigest()
    assert one(spark, hashing.stable_uuid(F.lit("r"), F.lit("p"))) == str(uuid.UUID(digest[:32]))
    assert one(spark, hashing.short_id(F.lit("r"), F.lit("p"))) == digest[:16]
    assert one(spark, hashing.point_id(F.lit("x"))) == str(uuid.UUID(hashlib.md5(b"x").hexdigest()))
    assert one(spark, hashing.name_uuid(str(uuid.NAMESPACE_URL), F.lit("héllo"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "héllo"))


def test_texts(spark):
    long = "a" * 1500 + "b" * 1500
    assert one(spark, text.head_tail(F.col("t")), t=long) == "a" * 990 + "\n...[TRUNCATED]...\n" + "b" * 990
    assert one(spark, text.docstring(F.col("t")), t="'''no''' \"\"\"\n yes \n\"\"\"") == "yes"
    assert one(spark, text.docstring(F.col("t")), t="x = '''single'''") == "single"
    assert one(spark, text.repo_id(F.col("t")), t="git@host.org:own/name.git") == "own/name"
    assert one(spark, text.reply_field(F.lit('{"a": "b"}'), "$.c", F.lit("d"))) == "d"


def test_budget(spark):
    items = spark.createDataFrame([("x", i, t) for i, t in enumerate([5, 9, 3, 4])], "g string, n int, t int")
    got = {b: review.budgeted(items, "g", ["n"], "t", b).first() for b in (1, 10, 100)}
    assert {b: (r.kept, r.skipped, r.total) for b, r in got.items()} == {1: (1, 3, 5), 10: (2, 2, 8), 100: (4, 0, 21)}


def test_policies(spark):
    rules = [{"id": "i", "type": "banned_import", "pattern": "os", "severity": "block", "message": "m"}, {"id": "p", "type": "protected_write", "pattern": "core/*", "severity": "warn", "message": "m"}, {"id": "u", "type": "other", "pattern": "*", "severity": "warn", "message": "m"}]
    changes = spark.createDataFrame([("core/a.py", "+import os\n"), ("b.py", "+++ import os\n-import os\n+ from os import x"), ("c.py", "+x = 'import os'"), ("d.py", None)], "path string, diff string")
    assert {(r.policy_id, r.path) for r in review.violations(rules, changes).collect()} == {("i", "core/a.py"), ("p", "core/a.py"), ("i", "b.py")}
    assert review.violations([], changes).count() == 0


def test_symbols_and_notes(spark):
    found = spark.createDataFrame([("a.rs", "Gone"), ("a.rs", "None")], "path string, symbol string")
    source = spark.createDataFrame([("a.rs", "use x::Gone"), ("b.rs", "x::GoneToo;"), ("c.py", "mod Gone"), ("d.md", "use Gone"), ("e.go", "Gone")], "path string, content string")
    assert {(r.symbol, r.files) for r in review.symbol_references(found, source).collect()} == {("Gone", 2), ("None", 0)}
    where = spark.createDataFrame([("c/src/a.rs",), ("d/b.rs",), ("e/c.py",)], "path string")
    manifests = spark.createDataFrame([("c/Cargo.toml", "publish = false"), ("d/Cargo.toml", 'x = { path = "../c" }'), ("Cargo.toml", "[workspace]")], "path string, content string")
    assert {r.path: r.note[:9] for r in review.crate_notes(where, manifests).collect()} == {"c/src/a.rs": "not publi", "d/b.rs": "workspace"}


def test_quality(spark):
    results = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2), ("q2", "x", 1), ("q2", "c", 4), ("q3", "y", 1)], "qid string, id string, rank int")
    gold = spark.createDataFrame([("q1", "a"), ("q2", "c"), ("q3", "z"), ("q4", None)], "qid string, expected string")
    by = {r.qid: (r.reciprocal_rank, r.recall_at_3, r.recall_at_5) for r in retrieval.judged(results, gold).collect()}
    assert by == {"q1": (1.0, 1.0, 1.0), "q2": (0.25, 0.0, 1.0), "q3": (0.0, 0.0, 0.0), "q4": (0.0, 1.0, 1.0)}
    assert retrieval.summary(retrieval.judged(results, gold.where("qid <> 'q4'"))).first().mrr == round(1.25 / 3, 4)
    assert [r.expected for r in retrieval.missing(results, gold).collect()] == ["z"]


def test_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, None), (4, "d")], "k int, v string")
    assert {tuple(r) for r in mutation.changeset(old, new, ["k"], "v").collect()} == {(1, "R"), (2, "M"), (4, "A")}
    once = mutation.upsert(old, new, ["k"])
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, mutation.upsert(once, new, ["k"]).collect()), key=str)
    ops = mutation.changeset(old, new, ["k"], "v")
    assert {tuple(r) for r in mutation.apply_changes(old, ops, new, ["k"]).collect()} == {tuple(r) for r in new.collect()}


def test_store(spark, tmp_path):
    store = mutation.Store(spark, f"file://{tmp_path}/store", dimension=4)
    mutation.Store(spark, f"file://{tmp_path}/store", dimension=4)
    with pytest.raises(ValueError, match="not 8"):
        mutation.Store(spark, f"file://{tmp_path}/store", dimension=8)
    store.ensure("file", "path string, n int")
    store.merge("file", spark.createDataFrame([("a", 1), ("b", 2)], "path string, n int"), ["path"])
    store.merge("file", spark.createDataFrame([("b", 3)], "path string, n int"), ["path"])
    store.remove("file", spark.createDataFrame([("a",)], "path string"), ["path"])
    assert [tuple(r) for r in store.read("file").collect()] == [("b", 3)] and store.read("file", 1).count() == 2
    other = mutation.Store(spark, f"file://{tmp_path}/other")
    store.copy_to(other, ["file"])
    store.vacuum("file")
    assert other.read("file").count() == store.read("file").count() == 1
    changes = spark.range(101)
    assert [mutation.plan_sync(changes, *x) for x in (("a", "a"), (None, "a"), ("b", "a"))] == ["nothing", "full", "full"]
    assert mutation.plan_sync(spark.range(100), "b", "a") == "incremental"


def test_stream(spark, tmp_path):
    store = mutation.Store(spark, f"file://{tmp_path}/store")
    store.write("file", spark.createDataFrame([("r", "a", "old"), ("r", "b", "old")], "repo_id string, path string, text string"))
    folder = tmp_path / "in"
    folder.mkdir()
    line = '{{"repo_id": "r", "path": "{}", "op": "{}", "seq": {}}}\n'
    (folder / "1.json").write_text(line.format("a", "R", 2) + line.format("b", "M", 1) + line.format("a", "A", 1) + line.format("c", "A", 1))
    load = lambda keys: keys.withColumn("text", F.lit("new"))
    for _ in range(2):
        apply.run(apply.changes(spark, str(folder)), store, "file", load, str(tmp_path / "check"))
        assert {tuple(r) for r in store.read("file").collect()} == {("r", "b", "new"), ("r", "c", "new")}


def test_governance(spark):
    rows = [("ok", "Security"), ("bad", "Fun"), ("none", None)]
    got = {tuple(r) for r in governance.rejected(spark.createDataFrame(rows, "id string, category string"), "intent").collect()}
    assert got == {("bad", "category", "unknown value"), ("none", "category", "missing")}
    governance.check_request(query="x", limit=100, repo=None)
    with pytest.raises(ValueError, match="limit"):
        governance.check_request(limit=101)


def test_sources(spark, tmp_path):
    repo = tmp_path / "repo"
    for name, body in {"app.py": b"import os\nfrom .m import f\n\nclass A:\n    def run(self):\n        return db.save(1)\n", "m.go": b"import \"fmt\"\nfunc Go() { fmt.Print(1) }\n", "bad.py": b"def (:\n", "x.txt": b"no", "build/y.py": b"z = 1", "raw.md": b"ok\xff\xfe!"}.items():
        (repo / name).parent.mkdir(parents=True, exist_ok=True)
        (repo / name).write_bytes(body)
    rows = files.source_files(spark, str(repo), "r")
    assert {r.path: r.language for r in rows.collect()} == {"app.py": "python", "m.go": "go", "bad.py": "python", "raw.md": None}
    assert rows.where("path = 'raw.md'").first().content == "ok!"
    nodes = parsing.parse(rows)
    got = {(r.path, r.type, r.name) for r in nodes.collect()}
    assert {("app.py", "import", "os"), ("app.py", "import", ".m"), ("app.py", "definition", "A"), ("app.py", "definition", "run"), ("app.py", "call", "db.save"), ("m.go", "import", "fmt"), ("m.go", "definition", "Go"), ("bad.py", "error", None)} <= got
    summary = {r.path: r.summary for r in parsing.summaries(rows, nodes).collect()}
    assert summary["app.py"] == "File: app.py\nImports: os, .m\nDefines: class A, def run"
    assert parsing.node_ids(nodes).where("id is null").count() == 0 and parsing.exports(nodes).count() == 3
    assert (parsing.hash_vector("x", 9) == parsing.hash_vector("x", 9)).all() and len(languages.registry()) == 38


def test_reports(spark, edges):
    text_ = report.diagram(edges, "a")
    assert "a -->|IMPORTS| m" in text_ and "style a" in text_
    rows = spark.createDataFrame([(1, "a.py", 0.5, "body")], "rank int, path string, score double, text string")
    assert report.search_report(rows) == "1. a.py (0.5000)\n   body" and report.to_json(rows).startswith('[{"rank":1')
