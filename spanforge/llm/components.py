"""Connected components by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.shared import drop, stage


def stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v), u > v: neighbours of each node are tied to the least of them and the node.

    Large: the neighbours above the node. Small: those below it, and the node. The least neighbour is a sum
    made map-side and joined back, so a node with any number of neighbours is never gathered in one row; a hot
    one is a skewed join, which Spark splits.
    """
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        tied = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        tied = edges.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return tied.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge to another; component is the least node reachable.

    Nodes are integers, not null; loops and repeated edges don't matter. Rounds end when the edges, which by
    then tie each node to the least of its component, no longer change. The result is a staged table.
    """
    return components_staged(edges, a, b)[0]


def components_staged(edges: DataFrame, a: str = "a", b: str = "b") -> tuple[DataFrame, str]:
    """components(), and the path of its table."""
    spark = edges.sparkSession
    now, path = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        then, then_path = stage(stars(stars(now, True), False), "edges")
        drop(spark, path)
        now, path = then, then_path
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), path
