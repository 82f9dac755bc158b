"""Runs over a checked-out repository: what is tracked, what changed, what a gold set finds."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from spanforge.operators import mutation
from spanforge.plans import runs
from spanforge.sources import files, parsing


@pytest.fixture
def checkout(tmp_path):
    root = tmp_path / "repo"
    root.mkdir()

    def git(*args):
        subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e@x", *args], cwd=root, check=True, capture_output=True)

    def put(**contents):
        for name, body in contents.items():
            path = root / name.replace("__", "/").replace("_py", ".py")
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(body)

    def commit(message="m"):
        git("add", "-A")
        git("commit", "-q", "-m", message)

    git("init", "-q")
    put(app_py="import util\n\n\ndef run():\n    return helper()\n", util_py="def helper():\n    return 1\n", gen__made_py="x = (\n")
    (root / ".gitignore").write_text("gen/\n")
    commit()
    return root, put, git, commit


def test_only_tracked_files_are_indexed_and_updates_follow_commits(spark, tmp_path, checkout):
    root, put, git, commit = checkout
    store = mutation.Store(spark, f"file://{tmp_path}/store", buckets=4)
    first = runs.update(spark, store, str(root), "r")
    assert first == {"mode": "full", "status": "success", "files": 2, "deleted": 0, "errors": 0}  # gen/ is ignored
    assert store.metadata("commit:r") == files.head_commit(str(root))
    assert runs.update(spark, store, str(root), "r")["mode"] == "nothing"

    git("mv", "util.py", "tools.py")
    put(new_py="import tools\n")
    commit()
    letters = {(r.letter, r.path, r.new_path) for r in files.changed_letters(spark, str(root), "HEAD~1").collect()}
    assert ("A", "new.py", None) in letters and ("R", "util.py", "tools.py") in letters
    put(app_py="def (:\n")  # not committed: an incremental run doesn't open it
    second = runs.update(spark, store, str(root), "r")
    assert second == {"mode": "incremental", "status": "success", "files": 2, "deleted": 1, "errors": 0}
    assert {r.path for r in store.read("file").collect()} == {"app.py", "tools.py", "new.py"}
    store.set_metadata("commit:r", "0" * 40)  # a commit that isn't known any more
    assert runs.update(spark, store, str(root), "r")["mode"] == "full"


def test_named_files_open_no_others(spark, checkout):
    root, put, _, _ = checkout
    put(**{"odd [1]{a}*?_py": "x = 1\n"})
    rows = files.named_files(spark, f"file://{root}", "r", ["app.py", "gone.py", "odd [1]{a}*?.py", "note.unknown"])
    assert sorted(f.rsplit("/", 1)[-1] for f in rows.inputFiles()) in (["app.py", "odd [1]{a}*?.py"], ["app.py", "odd%20%5B1%5D%7Ba%7D*%3F.py"])
    assert {(r.path, r.language) for r in rows.collect()} == {("app.py", "python"), ("odd [1]{a}*?.py", "python")}
    assert files.named_files(spark, f"file://{root}", "r", ["gone.py"]).collect() == []


def test_files_are_parsed_once(spark, tmp_path, checkout, monkeypatch):
    root, *_ = checkout
    calls = []
    parse = parsing.parse
    monkeypatch.setattr(parsing, "parse", lambda *a, **k: calls.append(1) or parse(*a, **k))
    tables = runs.tables_of(files.source_files(spark, str(root), "r", ["app.py", "util.py"]), parsing.embedder(8))
    assert len(calls) == 1
    for name, rows in tables.items():  # what is made reads what was parsed, not the sources
        assert "MapInPandas" not in rows._jdf.queryExecution().executedPlan().toString() and rows.count() >= (name != "error")


def test_the_working_tree_is_reviewed(spark, tmp_path, checkout):
    root, put, git, commit = checkout
    store = mutation.Store(spark, f"file://{tmp_path}/store", buckets=4)
    runs.update(spark, store, str(root), "r")
    put(util_py="import os\n\n\ndef helper():\n    return 2\n")
    rules = [{"id": "os", "type": "banned_import", "pattern": "os", "severity": "block", "message": "m"}]
    got = runs.review_working(spark, store, str(root), "r", rules)
    assert [(r.policy_id, r.path) for r in got["violations"].collect()] == [("os", "util.py")]
    assert [r.path for r in got["context"].collect()] == ["app.py"]
    assert runs.review_working(spark, store, str(root), "r", rules, staged_only=True)["changed"].count() == 0
    git("add", "-A")
    assert runs.review_working(spark, store, str(root), "r", rules, staged_only=True)["changed"].count() == 1


def test_a_gold_set_is_evaluated(spark, tmp_path, checkout):
    root, *_ = checkout
    store = mutation.Store(spark, f"file://{tmp_path}/store", buckets=4)
    embed = parsing.embedder(16)
    runs.index(spark, store, str(root), "r", embed=embed)
    text = {r.path: r.text for r in store.read("vector").join(store.read("file").select("path", F.col("summary").alias("text")), ["path", "text"]).collect()}
    queries = [{"id": "a", "query": text["app.py"], "category": "x", "expected_paths": ["repo/APP.py"]}, {"id": "b", "query": text["util.py"], "category": "x", "expected_paths": ["nowhere.py"]}, {"id": "c", "query": "anything", "category": "y", "expected_paths": []}]
    (tmp_path / "gold.json").write_text(json.dumps({"_meta": {}, "queries": queries}))
    got = runs.evaluated(spark, store, f"file://{tmp_path}/gold.json", embed)
    by = {r.qid: (r.reciprocal_rank, r.recall_at_3) for r in got["queries"].collect()}
    assert by == {"a": (1.0, 1.0), "b": (0.0, 0.0), "c": (0.0, 1.0)}
    assert [tuple(r) for r in got["missing"].collect()] == [("b", "nowhere.py")]
    assert got["all"].first().mrr == 0.3333 and {r.category for r in got["categories"].collect()} == {"x", "y"}


def test_imports_and_exports_of_nodes(spark):
    rows = spark.createDataFrame([("r", "a.py", "import os\nfrom b import c\n\n\ndef f():\n    pass\n", "python")], "repo_id string, path string, content string, language string")
    nodes = parsing.parse(rows)
    assert {r.module for r in parsing.imports(nodes).collect()} == {"os", "b"}
    assert [r.usp for r in parsing.exports(nodes).collect()] == ["a.py:f"]
    heads = parsing.parse(rows, heads=True).where("type = 'source'").collect()
    assert [(r.path, r.kind, r.content[:9]) for r in heads] == [("a.py", "python", "import os")]
