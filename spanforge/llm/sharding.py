"""K-d tree partitioning of documents into shards of near-equal bytes. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.shared import stage

#: Bits of a split key: the dimension's bin, the text's checksum (equal texts stay together), the id's hash.
BIN, CRC, ID = 16, 32, 15
#: The digits in which a weighted median is searched, first ones first.
DIGITS = (BIN, 16, 16, ID)


@dataclass
class Node:
    """A node of the tree: leaf, or split where a row goes left if its key in the dimension is below `at`."""

    leaves: int
    first: int  # number of its leftmost shard
    dimension: str = ""
    at: int = 0
    left: Node | None = None
    right: Node | None = None


def shard_of(node: Node) -> Column:
    if node.left is None or node.right is None:
        return F.lit(node.first)
    return F.when(F.col(f"k_{node.dimension}") < node.at, shard_of(node.left)).otherwise(shard_of(node.right))


def leaves(node: Node) -> list[Node]:
    return [node] if node.left is None or node.right is None else leaves(node.left) + leaves(node.right)


def medians(rows: DataFrame, open_: list[Node], root: Node, tolerance: float) -> None:
    """Split each open node at the weighted quantile of its dimension, all nodes in the same jobs.

    Digit by digit: sums of bytes by (node, digit), summed map-side, then the digit where the running sum
    passes the wanted part. A job returns a row for each open node, at most as many as there are shards.
    """
    here = rows.withColumn("node", shard_of(root))
    state = {n.first: {"prefix": 0, "below": 0, "total": None, "node": n} for n in open_}
    shift = sum(DIGITS)
    waiting = dict(state)
    for bits in DIGITS:
        shift -= bits
        key = F.coalesce(*[F.when(F.col("node") == f, F.col(f"k_{s['node'].dimension}")) for f, s in waiting.items()])
        prefix = F.coalesce(*[F.when(F.col("node") == f, F.lit(s["prefix"])) for f, s in waiting.items()])
        part = here.withColumn("key", key).where(F.shiftright("key", shift + bits) == prefix).withColumn("digit", F.shiftright("key", shift).bitwiseAND((1 << bits) - 1))
        sums = part.groupBy("node", "digit").agg(F.sum("size").alias("bytes"))
        own = Window.partitionBy("node")
        run = sums.withColumns({"upto": F.sum("bytes").over(own.orderBy("digit")), "all": F.sum("bytes").over(own)})
        part_left = {f: s["node"].leaves // 2 / s["node"].leaves for f, s in waiting.items()}
        wanted = F.coalesce(*[F.when(F.col("node") == f, F.col("all") * part_left[f] if s["total"] is None else F.lit(s["total"] * part_left[f] - s["below"])) for f, s in waiting.items()])
        found = run.where((F.col("upto") >= wanted) & (F.col("upto") - F.col("bytes") < wanted)).collect()
        for r in found:
            s = waiting[r["node"]]
            node: Node = s["node"]
            s["total"] = r["all"] if s["total"] is None else s["total"]
            goal = s["total"] * part_left[r["node"]]
            low = s["below"] + r["upto"] - r["bytes"]
            s["prefix"] = (s["prefix"] << bits) + r["digit"]
            if r["bytes"] <= tolerance * s["total"] / node.leaves or not shift:
                over = goal - low > low + r["bytes"] - goal  # the nearer side of the digit
                node.at = (s["prefix"] + over) << shift
                del waiting[r["node"]]
            else:
                s["below"] = low
        if not waiting:
            break
    for s in waiting.values():  # no rows came to the node
        s["node"].at = 0
    for s in state.values():
        n = s["node"]
        n.left, n.right = Node(n.leaves // 2, n.first), Node(n.leaves - n.leaves // 2, n.first + n.leaves // 2)


def tree(rows: DataFrame, shards: int, dimensions: list[str], tolerance: float = 0.001) -> Node:
    """Split until each leaf is one shard, along the dimension whose bins spread widest in the node."""
    root = Node(shards, 0)
    while open_ := [n for n in leaves(root) if n.leaves > 1]:
        spread = [(F.max(f"k_{d}") - F.min(f"k_{d}")).alias(d) for d in dimensions]
        widths = {r["node"]: r for r in rows.groupBy(shard_of(root).alias("node")).agg(*spread).collect()}
        for n in open_:
            n.dimension = max(dimensions, key=lambda d: (widths[n.first][d] or 0, -dimensions.index(d))) if n.first in widths else dimensions[0]
        medians(rows, open_, root, tolerance)
    return root


def kd_shards(docs: DataFrame, shards: int = 24, block_rows: int = 100_000, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document.

    Size is the text's UTF-8 bytes plus 8 (null: 8). Law `bytes`: a k-d tree over the metadata dimensions
    (each category by a hash of its value, and the text's length on a log scale) splits at weighted medians
    along the widest dimension until each leaf holds its equal part of the bytes. Rows alike in a dimension are
    ordered by the text's checksum, then the id's hash, so equal texts stay together where a split allows it,
    and one value or one text that fills several shards is divided. Slots number the rows of a shard: a count by
    block of ids and texts, then a position within the block, so that no task orders a whole shard.

    Null ids and categories are values like others; rows that are alike get slots each; an empty table gives no
    rows. Very long texts count with all their bytes; one that is more than a shard's part fills a shard alone. Columns
    other than id, text and categories, whatever their names, are not read. Only split points and sums by node come to the driver.
    """
    size = F.coalesce(F.octet_length(docs[text_col]), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce(docs[text_col], F.lit("")).cast("binary"))
    top = (1 << BIN) - 1
    bins = {c: F.pmod(F.xxhash64(F.coalesce(docs[c].cast("string"), F.lit("\0"))), F.lit(top + 1)) for c in categories}
    bins["length"] = F.least(F.lit(top), (F.log2(size.cast("double")) / 32 * top)).cast("long")
    tail = F.pmod(F.xxhash64(F.coalesce(docs[id_col].cast("string"), F.lit("\0"))), F.lit(1 << ID))
    keys = {f"k_{d}": F.shiftleft(F.shiftleft(b.cast("long"), CRC).bitwiseOR(crc), ID).bitwiseOR(tail) for d, b in bins.items()}
    rows, _ = stage(docs.select(docs[id_col].alias("id"), size.alias("size"), crc.alias("text_crc32"), *[k.alias(n) for n, k in keys.items()]), "shards")
    root = tree(rows, shards, list(bins))
    blocks = max(1, rows.count() // (shards * block_rows))
    placed = rows.select("id", "size", "text_crc32", shard_of(root).cast("int").alias("shard"), F.pmod(F.xxhash64("id", "text_crc32", "size"), F.lit(blocks)).alias("block"))
    counts = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("offset"))
    slot = F.row_number().over(Window.partitionBy("shard", "block").orderBy("id", "text_crc32", "size")) - 1
    done = placed.withColumn("_slot", slot).join(offsets, ["shard", "block"])
    return done.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_slot") + F.col("offset")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
