"""Tables compared by content (U7, A16): checksums that know no order, a tree of them, and only what differs is read."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Parts that rows are dealt to by key, and buckets in each: the leaves and the level above them.
PARTS, LEAVES = 64, 64


def _leaf(key: list[str]) -> Column:
    return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in key], F.lit(7)), F.lit(PARTS * LEAVES)).cast("int")


def sums(rows: DataFrame, key: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, part, leaf, n, one, two): rows of each bucket of keys and two sums of hashes of all their columns, by name.

    Sums don't depend on the order or the partitions, and repeated rows count; a bucket with other rows has other sums
    but for a chance of 2**-64 a sum.
    """
    columns = [F.to_json(F.struct(F.col(c).alias("v"))) for c in sorted(rows.columns)]
    leaf = _leaf(key)
    hashed = rows.select(*(by or []), (leaf / LEAVES).cast("int").alias("part"), leaf.alias("leaf"), *[F.xxhash64(*columns, F.lit(i)).cast("decimal(38,0)").alias(f"h{i}") for i in (1, 2)])
    return hashed.groupBy(*(by or []), "part", "leaf").agg(F.count(F.lit(1)).alias("n"), F.sum("h1").alias("one"), F.sum("h2").alias("two"))


def differing(old: DataFrame, new: DataFrame) -> DataFrame:
    """(part, leaf) of buckets with other sums: parts first, then the leaves of those that differ."""

    def unequal(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        value = F.struct("n", "one", "two")
        both = a.select(*on, value.alias("_a")).join(b.select(*on, value.alias("_b")), on, "full_outer")
        return both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*on)

    level = lambda x: x.groupBy("part").agg(*[F.sum(c).alias(c) for c in ("n", "one", "two")])
    parts = unequal(level(old), level(new), ["part"])
    within = lambda x: x.join(parts, "part", "left_semi")
    return unequal(within(old), within(new), ["part", "leaf"])


def write(rows: DataFrame, key: list[str], folder: str) -> None:
    """A snapshot: the rows, dealt to parts by key, and the sums of their buckets."""
    leaf = _leaf(key)
    dealt = rows.withColumns({"_leaf": leaf, "_part": (leaf / LEAVES).cast("int")})
    dealt.repartition("_part").sortWithinPartitions("_part", "_leaf").write.partitionBy("_part").parquet(f"{folder}/rows")
    sums(rows, key).coalesce(1).write.parquet(f"{folder}/sums")
    schema = StructType([*rows.schema.fields, StructField("_leaf", IntegerType())]).json()  # without rows there is no file to tell it
    rows.sparkSession.createDataFrame([(schema,)], "schema string").coalesce(1).write.text(f"{folder}/schema")


def changes(spark: SparkSession, old: str, new: str, key: list[str]) -> DataFrame:
    """(key, op) of the rows that are added (A), removed (R) or modified (M) between two snapshots; keys are unique.

    The sums, a row a bucket, are compared first. Of the rows only the parts that differ are opened, and within them
    the buckets (files are sorted by these), so the work goes with what changed.
    """
    found = differing(spark.read.parquet(f"{old}/sums"), spark.read.parquet(f"{new}/sums")).collect()  # a row a bucket at most
    parts, leaves = sorted({r["part"] for r in found}), sorted({r["leaf"] for r in found})

    def differ(folder: str) -> DataFrame:
        schema = StructType.fromJson(json.loads(spark.read.text(f"{folder}/schema").first()[0]))
        kept = schema.fieldNames()[:-1]
        rows = spark.read.schema(schema.add("_part", IntegerType())).parquet(f"{folder}/rows").where(F.col("_part").isin(parts) & F.col("_leaf").isin(leaves))
        return rows.select(*key, F.to_json(F.struct(*sorted(kept)), {"ignoreNullFields": "false"}).alias("_row"))

    both = differ(old).withColumnRenamed("_row", "_a").join(differ(new).withColumnRenamed("_row", "_b"), key, "full_outer")
    op = F.when(F.col("_a").isNull(), "A").when(F.col("_b").isNull(), "R").when(F.col("_a") != F.col("_b"), "M")
    return both.select(*key, op.alias("op")).where("op is not null")


def verified(source: DataFrame, target: DataFrame, key: list[str], label: str = "label") -> DataFrame:
    """By label: rows on both sides and whether their contents are the same (A16), which equal counts don't tell."""
    a, b = sums(source, key, [label]), sums(target, key, [label])
    both = a.select(label, "part", "leaf", F.struct("n", "one", "two").alias("_a")).join(b.select(label, "part", "leaf", F.struct("n", "one", "two").alias("_b")), [label, "part", "leaf"], "full_outer")
    n = lambda side: F.coalesce(F.sum(F.col(f"{side}.n")), F.lit(0))
    return both.groupBy(label).agg(n("_a").alias("source_rows"), n("_b").alias("target_rows"), F.bool_and(F.col("_a").eqNullSafe(F.col("_b"))).alias("same"))
