"""Comparison by content, functions in SQL, and tables that lie in buckets."""

import re

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from spanforge.functions import hashing, paths, sqlnames, text
from spanforge.operators import mutation, snapshot
from spanforge.plans import staging
from spanforge.sources import parsing


def test_a_changed_row_is_found_where_counts_agree(spark, tmp_path):
    old = spark.range(5000).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"), F.when(F.col("id") % 3 != 0, F.col("id") * 1.5).alias("x"))
    new = old.where("k <> 77").withColumn("v", F.when(F.col("k") == 4000, "w").otherwise(F.col("v"))).withColumn("x", F.when(F.col("k") == 10, None).otherwise(F.col("x")))
    new = new.unionByName(spark.createDataFrame([(9999, None, None)], "k long, v string, x double")).select("x", "v", "k").repartition(3)
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    snapshot.write(old, ["k"], a)
    snapshot.write(new, ["k"], b)
    found = snapshot.changes(spark, a, b, ["k"])
    assert {tuple(r) for r in found.collect()} == {(77, "R"), (4000, "M"), (10, "M"), (9999, "A")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    for listed in re.findall(r"PartitionFilters: \[_part#\d+ IN \(([\d,]+)\)", plan):  # both sides read these alone
        assert len(listed.split(",")) <= 4 < snapshot.PARTS
    assert plan.count("PartitionFilters: [_part") >= 2
    snapshot.write(old.repartition(5).orderBy(F.rand(1)), ["k"], f"{b}2")
    assert snapshot.changes(spark, a, f"{b}2", ["k"]).collect() == []
    snapshot.write(old.limit(0), ["k"], f"{b}3")
    assert {r.op for r in snapshot.changes(spark, f"{b}3", a, ["k"]).collect()} == {"A"} and snapshot.changes(spark, a, f"{b}3", ["k"]).count() == 5000


def test_a_copy_is_verified_by_content(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 3, "y"), ("b", 3, "y"), ("c", 4, "z")], "label string, k long, v string")
    other = spark.createDataFrame([("a", 2, None), ("a", 1, "x"), ("b", 3, "y"), ("b", 3, "Y"), ("d", 5, "z")], "label string, k long, v string")
    got = {r.label: (r.source_rows, r.target_rows, r.same) for r in snapshot.verified(rows, other, ["k"]).collect()}
    assert got == {"a": (2, 2, True), "b": (2, 2, False), "c": (1, 0, False), "d": (0, 1, False)}


def test_functions_have_the_same_results_in_sql(spark):
    sqlnames.register(spark)
    values = ["a", "", None, "x" * 2001, "src/tests/A.py", "b/Test_c.py", "x_test.py", "a/b.spec.ts", "contest.py", "00000000-0000-0000-0000-00000000000A", "é-1_2", "e" * 1990 + "é\n" * 30]
    rows = spark.createDataFrame([(v,) for v in values], "t string")
    t = F.col("t")
    want = rows.select(hashing.stable_uuid(t, F.lit("b")), hashing.short_id(t, F.lit("b")), hashing.point_id(t), text.token_estimate(t), text.head_tail(t), text.diagram_id(t), paths.is_test(t)).collect()
    got = spark.sql("SELECT stable_uuid(t, 'b'), short_id(t, 'b'), point_id(t), token_estimate(t), head_tail(t), diagram_id(t), is_test(t) FROM {rows}", rows=rows).collect()
    assert list(map(tuple, got)) == list(map(tuple, want))


def test_the_table_function_equals_the_operator(spark):
    nodes = [("r", "a.py", "import", "import", f"m{i:02d}", i) for i in range(30)] + [("r", "a.py", "definition", "class_definition", "C", 2), ("r", "a.py", "definition", "function_definition", "f", 1), ("s", "a.py", "call", "call", "g", 1)]
    nodes += [("r", "long.py", "definition", "function", "n" * 50 + str(i), i) for i in range(200)]
    table = spark.createDataFrame(nodes, "repo_id string, path string, type string, kind string, name string, start_line int")
    files = spark.createDataFrame([("r", "a.py", '"""Doc."""'), ("s", "a.py", ""), ("r", "long.py", "")], "repo_id string, path string, content string")
    sqlnames.register(spark)
    heads = files.select("repo_id", "path", F.lit("source").alias("type"), F.lit(None).cast("string").alias("kind"), text.docstring(F.col("content")).alias("name"), F.lit(0).alias("start_line"))
    got = spark.sql("SELECT * FROM file_summaries(TABLE(SELECT * FROM {nodes}))", nodes=table.unionByName(heads))
    assert got.columns == ["repo_id", "path", "summary"]
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in parsing.summaries(files, table).collect()}
    with pytest.raises(AnalysisException, match="needs the columns name"):
        spark.sql("SELECT * FROM file_summaries(TABLE(SELECT repo_id, path, type, kind, start_line FROM {nodes}))", nodes=table).collect()


def test_summaries_of_lists_of_names_equal_those_of_nodes(spark):
    """A file's imports and definitions may come as lists, so Python is given few rows."""
    sqlnames.register(spark)
    rows = [(repo, f"f{i}", kind, "function", f"n{j:03}", 1) for repo in "pq" for i, n in enumerate((0, 1, 3, 19, 20, 21, 700)) for kind in ("import", "definition") for j in range(n)]
    nodes = spark.createDataFrame(rows, "repo_id string, path string, type string, kind string, name string, start_line int")
    lists = nodes.groupBy("repo_id", "path", "type", "kind", "start_line").agg(F.array_sort(F.collect_list("name")).alias("name"))
    shown = lambda x: {tuple(r) for r in spark.sql("SELECT * FROM file_summaries(TABLE(SELECT * FROM {x}))", x=x).collect()}
    assert shown(lists) == shown(nodes) and len(shown(lists)) == 12


def test_joins_of_bucketed_tables_move_nothing(spark):
    """Files, blocks and edges in buckets by repository and path: deleting with closure has no exchange on them."""
    key = ["repo_id", "path"]
    rows = spark.range(300).select(F.concat(F.lit("r"), F.col("id") % 3).alias("repo_id"), F.concat(F.lit("p"), "id").alias("path"), F.col("id").alias("n"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    file, block = (staging.bucketed(rows, name, key, buckets) for name in ("file", "block"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = file.join(block.withColumnRenamed("n", "m"), key)
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 300
        gone = staging.bucketed(rows.where("n % 10 = 0").select(*key), "gone", key, buckets)
        left = mutation.delete(block, gone, key)
        assert "Exchange" not in left._jdf.queryExecution().executedPlan().toString() and left.count() == 270
        both = block.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).join(file, key)
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString() and both.count() == 300
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
