"""Vectors added in batches, what is kept beside them, lists of modules to skip."""

import pytest
from pyspark.sql import functions as F

from spanforge.functions import paths, text
from spanforge.operators import graph, mutation
from spanforge.sources import parsing


def test_texts_are_appended_under_new_ids_as_one_commit(spark, tmp_path):
    store = mutation.Store(spark, f"file://{tmp_path}/s", buckets=4)
    rows = spark.createDataFrame([("a", {"path": "p"}), ("a", {"text": "mine"}), ("b", None)], "text string, meta map<string,string>")
    before = store.state()["number"]
    first = {(r.id, tuple(sorted(r.payload.items()))) for r in mutation.add_texts(store, rows, parsing.embedder(8)).collect()}
    assert store.state()["number"] == before + 2  # the table, and the batch
    mutation.add_texts(store, rows.limit(1), parsing.embedder(8))
    held = store.read("added").collect()
    assert len({r.id for r in held}) == 4 and first <= {(r.id, tuple(sorted(r.payload.items()))) for r in held}
    assert sorted(p for _, p in first) == [(("path", "p"), ("text", "a")), (("text", "b"),), (("text", "mine"),)]

    @F.pandas_udf("array<float>")
    def broken(texts):
        raise ValueError("no model")

    with pytest.raises(Exception, match="no model"):
        mutation.add_texts(store, rows, broken)
    assert store.read("added").count() == 4


def test_lists_of_modules_to_skip(spark, tmp_path):
    (tmp_path / "names.txt").write_text("# pinned\njson\n os \n\njson\n")
    pinned = paths.skip_list(spark, f"file://{tmp_path}/names.txt")
    assert {r.name for r in pinned.collect()} == {"json", "os", *paths.VENDOR} and pinned.count() == 2 + len(paths.VENDOR)
    assert {"sys", "wheel"} <= {r.name for r in paths.skip_list(spark).collect()}
    rows = spark.createDataFrame([("json.tool",), ("jsonx",), ("os",), ("numpy.os",), (None,), ("",)], "name string")
    assert {r.name for r in paths.without_skipped(rows, "name", pinned).collect()} == {"jsonx", "numpy.os", None, ""}


def test_exploration_of_hot_modules_stays_small(spark):
    edges = spark.createDataFrame([(f"f{i:03d}", "File", "m", "Module", "IMPORTS", "r") for i in range(300)] * 2, "src string, src_label string, dst string, dst_label string, type string, repo_id string")
    got = graph.explore(edges, spark.createDataFrame([("r", "m"), ("r", "f001")], "repo_id string, node string"), most=2).collect()
    assert {(r.node, r.section, tuple(r.others), r.total) for r in got} == {("m", "Used by", ("f000", "f001"), 300), ("f001", "Imports", ("m",), 1)}


def test_payload_of_null_entries(spark):
    rows = spark.createDataFrame([("a", None), (None, {"x": "1"})], "t string, m map<string,string>")
    assert [r.p for r in rows.select(text.payload(F.col("t"), F.col("m")).alias("p")).collect()] == [{"text": "a"}, {"text": None, "x": "1"}]
