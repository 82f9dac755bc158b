"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.shared import numbered, stage, unpacked

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in text; null: 0."""
    space = r"[\x20\x09-\x0D]"
    edges = F.when(text.rlike(f"^{space}"), 1).otherwise(0) + F.when(text.rlike(f"{space}\\z"), 1).otherwise(0)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.size(F.split(text, f"{space}+", -1)) - edges).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Adds rank, weight and target to (source, source_size).

    All sizes together are shared by weight. A target stops at `most` times its source's size, and the rest is
    shared again by weight among the others. In the order of that cap over the weight the sources that stop
    come first, so running sums give the end of the repeated sharing at once.
    """
    whole = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("rank", F.row_number().over(by_name))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1).cast("long")).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumns({"total": F.sum("source_size").over(whole), "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)), "weight_left": F.sum("weight").over(after)})
    s = s.withColumn("stops", (F.col("total") - F.col("cap_before")) * F.col("weight") > F.col("cap") * F.col("weight_left"))
    free = F.col("total") - F.coalesce(F.sum(F.when(F.col("stops"), F.col("cap"))).over(whole), F.lit(0))
    share = F.sum(F.when(~F.col("stops"), F.col("weight"))).over(whole)
    target = F.when(F.col("stops"), F.col("cap").cast("double")).otherwise((free * F.col("weight")).cast("double") / share)
    return s.withColumn("target", target).select("source", "source_size", "rank", "weight", "total", "target")


def seats(parties: DataFrame, group: list[str], share: str, number: str, tie: str, out: str) -> DataFrame:
    """Sainte-Laguë: `number` seats of each group go to the highest quotients share / (2k - 1), ties to the lower `tie`.

    With m parties, the seats of one lie within a seat or two of share / total * (number -+ m / 2), rounded, so
    only the quotients between are listed: about five a party, however many seats there are. A party without
    share gets none.
    """
    own = Window.partitionBy(*group)
    total, m, n = F.sum(share).over(own), F.count(F.lit(1)).over(own), F.col(number)
    some = F.col(share) > 0
    p = parties.withColumns({"_low": F.when(some, F.greatest(F.lit(0), F.floor(F.col(share) / total * F.greatest(n - m / 2, F.lit(0.0)) - 0.5) - 1)).otherwise(0).cast("long"), "_high": F.when(some, F.floor(F.col(share) / total * (n + m / 2) + 0.5) + 2).otherwise(0).cast("long")})
    p = p.withColumn("_left", n - F.sum("_low").over(own))
    k = p.withColumn("_k", F.explode_outer(F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low") + 1, F.col("_high")))))
    k = k.withColumn("_quotient", F.col(share) / (2 * F.col("_k") - 1))
    won = F.row_number().over(own.orderBy(F.col("_quotient").desc_nulls_last(), tie, "_k")) <= F.col("_left")
    k = k.withColumn("_won", (won & F.col("_quotient").isNotNull()).cast("long"))
    keys = [F.col(c) for c in parties.columns]
    return k.groupBy(*keys, "_low").agg(F.sum("_won").alias("_more")).withColumn(out, F.col("_low") + F.col("_more")).drop("_low", "_more")


def mix(docs: DataFrame, block: int = 16, shard_words: int = 4_000_000, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, shard, shard_size, start, quota and taken of every document.

    Sizes are words. Blocks of `block` words go to sources by Sainte-Laguë, then by it to each source's shards
    (about shard_words each; documents fall into them by a seeded digest of their id, or of their text if it is null), which gives integer
    quotas per shard. A shard's documents stand in seeded order; its quota of blocks is read off from the start
    of that sequence, and over it again where the quota is larger than the shard. `start` is the document's
    first word there and taken the number of its words in the blocks, at most 3 times its size.

    Null texts have size 0, null sources form one source that comes last, null ids are as any other id, rows
    that are alike each count. An empty table gives no rows. Reruns agree. Windows go over shards, never over a
    source; only the table of sources is ordered as a whole. With row_col, a unique number of each row, that column
    comes first, and rows of one id and size stand in the order of a hash of their texts. Very long texts are counted
    whole, in Spark; a document longer than its quota gives its first words. Other columns, whatever their names, are
    not read.
    """
    more = [] if row_col is None else [docs[row_col].alias("at"), F.xxhash64(docs[text_col]).alias("hash")]
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_col].cast("string"), F.concat(F.lit("/"), F.xxhash64(docs[text_col]).cast("string")))))
    sized, _ = stage(docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"), key.alias("key"), *more), "mix")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    sources = sources.withColumns({"blocks": F.ceil(F.col("total") / block), "shards": F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))})
    sources = seats(sources, [], "target", "blocks", "rank", "source_blocks")
    sources, _ = stage(sources, "sources")

    number = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    s = sources.alias("s")
    rows = sized.alias("d").join(s, F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "source_size", "target", "rank", "source_blocks", (number % F.col("shards")).alias("shard"))
    sizes = rows.groupBy("rank", "shard", "source_blocks").agg(F.sum("size").alias("shard_size"))
    quotas = seats(sizes, ["rank"], "shard_size", "source_blocks", "shard", "shard_blocks")
    quotas = quotas.select("rank", "shard", "shard_size", F.least(F.col("shard_blocks") * block, F.col("shard_size") * MOST_REPEATS).alias("quota"))
    order = Window.partitionBy("rank", "shard").orderBy("key", "id", "size", *(["hash", "at"] if more else []))
    rows = rows.withColumn("start", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).join(quotas, ["rank", "shard"])
    full = F.when(F.col("shard_size") > 0, F.floor(F.col("quota") / F.col("shard_size"))).otherwise(0)
    rows = rows.withColumn("full", full.cast("long"))
    rest = F.col("quota") - F.col("full") * F.col("shard_size")
    rows = rows.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start"))).cast("long"))
    return rows.select(*([F.col("at").alias(row_col)] if more else []), F.col("id").alias(id_col), "source", "size", "source_size", "target", "shard", "shard_size", "start", "quota", "full", "part", (F.col("full") * F.col("size") + F.col("part")).alias("taken"))


def mixed_docs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs as often as the mix takes them, with docs' columns; a last part is cut after its words.

    Decisions are made and carried out row by row: rows without an id, or that share one, each have their own.
    """
    staged, _ = numbered(docs, "numbered")
    field = lambda c, name: F.col("row").getField(c).alias(name)
    narrow = staged.select("at", field(id_col, "id"), field(text_col, "text"), field(source_col, "source"))
    taken = mix(narrow, id_col="id", row_col="at", **options).select("at", "size", "full", "part").where("full > 0 or part > 0")
    rows = staged.select("at", "row", field(text_col, "text")).join(taken, "at").withColumn("copy", F.explode(F.expr("sequence(1, cast(full + if(part > 0, 1, 0) as int))")))
    # Pieces that each end with a word: joined again they keep the white space between.
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1)
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("part").cast("int")), "")
    rows = rows.withColumn("text", F.when((F.col("copy") > F.col("full")) & (F.col("part") < F.col("size")), cut).otherwise(F.col("text")))
    changed = {text_col: F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return unpacked(rows, docs, **changed)


#: DuckDB SQL of op4's rows.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank, sum(source_size) OVER ()::BIGINT AS total FROM s0),
s2 AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight, 3 * source_size AS cap FROM s1),
s3 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cap_before,
                 sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS weight_left FROM s2),
s4 AS (SELECT *, (total - cap_before) * weight > cap * weight_left AS stops FROM s3),
s5 AS (SELECT *, CASE WHEN stops THEN cap::DOUBLE
                      ELSE ((total - coalesce(sum(CASE WHEN stops THEN cap END) OVER (), 0)::BIGINT) * weight)::DOUBLE
                           / sum(CASE WHEN NOT stops THEN weight END) OVER ()::DOUBLE END AS target FROM s4),
q AS (SELECT rank, total, target / (2 * k - 1) AS quotient, k
      FROM s5, generate_series(1, (target / 16)::BIGINT + 40) AS g(k) WHERE target > 0),
w AS (SELECT rank, row_number() OVER (ORDER BY quotient DESC, rank, k) AS r, total FROM q),
s6 AS (SELECT s5.*, coalesce((SELECT count(*) FROM w WHERE w.rank = s5.rank AND r <= ceil(total / 16.0)), 0)::BIGINT AS source_blocks,
              greatest(1, ceil(source_size / 4000000.0))::BIGINT AS shards FROM s5),
r AS (SELECT d.*, source_size, target, rank, source_blocks, ('0x' || substr(key, 1, 8))::BIGINT % shards AS shard
      FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source),
h AS (SELECT rank, shard, source_blocks, sum(size)::BIGINT AS shard_size FROM r GROUP BY ALL),
hq AS (SELECT rank, shard, source_blocks, shard_size::DOUBLE / (2 * k - 1) AS quotient, k
       FROM h, generate_series(1, source_blocks) AS g(k) WHERE shard_size > 0),
hw AS (SELECT rank, shard, source_blocks, row_number() OVER (PARTITION BY rank ORDER BY quotient DESC, shard, k) AS n FROM hq),
hs AS (SELECT h.*, least(16 * coalesce((SELECT count(*) FROM hw WHERE hw.rank = h.rank AND hw.shard = h.shard AND n <= hw.source_blocks), 0), 3 * shard_size)::BIGINT AS quota FROM h),
p AS (SELECT r.*, shard_size, quota, (sum(size) OVER (PARTITION BY r.rank, r.shard ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS start
      FROM r JOIN hs ON r.rank = hs.rank AND r.shard = hs.shard),
f AS (SELECT *, CASE WHEN shard_size > 0 THEN quota // shard_size ELSE 0 END AS whole FROM p)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, quota - whole * shard_size - start)))::BIGINT AS taken
FROM f
"""
