"""Ranked lexical search: postings by term, integer scores, the first k documents of each item."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.shared import STEP_BYTES, drop, stage, steps

#: Letters and digits of ASCII, and all beyond ASCII.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")

#: Bytes of the items' distinct terms up to which documents are reduced to these where they are read. Beyond, the
#: postings of all terms are written and the join drops what no item asks for.
MOST_BYTES = 16 << 20


def parts(text: bytes, size: int = STEP_BYTES) -> Iterator[bytes]:
    """A long text in parts of about this size that break no term."""
    at = 0
    while len(text) - at > size:
        found = BREAK.search(text, at + size)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.end()
    yield text[at:] if at else text


def term_counts(text: bytes) -> Counter:
    """The terms, with the letters A-Z in lower case, and how often each occurs."""
    out: Counter = Counter()
    for part in parts(text):
        out.update(TERM.findall(part.lower()))  # bytes.lower: ASCII letters only
    return out


POSTING = "at bigint, id {kind}, n bigint, term string, tf bigint"


def postings(rows: DataFrame, id_col: str, text_col: str, only: frozenset[bytes] | None = None, totals: bool = False) -> DataFrame:
    """(at, id, n, term, tf) of each row and distinct term: `at` is the row's number, n its terms with repeats.

    With `only`, of these terms alone. With `totals`, each task adds a row whose term is empty, with the number of
    rows that have terms in n and the number of their terms in tf.
    """
    kind = rows.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = terms = 0
        id_type = None
        names = ["at", "id", "n", "term", "tf"]
        for batch in steps(batches, 2):
            id_type = batch.schema.field(1).type
            row, size, found, tf = [], [], [], []
            for i, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                counts = term_counts(text) if text else {}
                if not counts:
                    continue
                n = sum(counts.values())
                docs, terms = docs + 1, terms + n
                kept = [t for t in counts if t in only] if only is not None else [*counts]
                row += [i] * len(kept)
                size += [n] * len(kept)
                found += kept
                tf += map(counts.__getitem__, kept)
            if row:
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(size, pa.int64()), pa.array(found, pa.binary()).cast(pa.string()), pa.array(tf, pa.int64())], names)
        if totals and docs:
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.nulls(1, id_type), pa.array([docs], pa.int64()), pa.array([""]), pa.array([terms], pa.int64())], names)

    numbered = rows.select(F.monotonically_increasing_id().alias("at"), rows[id_col].alias("id"), rows[text_col].alias("text"))
    return numbered.mapInArrow(work, POSTING.format(kind=kind))


def floor_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(item, rank, document, score): the k documents that score highest for each item, equal scores by document id.

    BM25 in integers: a term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), a document's length norm
    75 + 25 n N div L, and a posting scores weight * (10^9 tf div (1000 tf + 12 norm)) for each time that an item has
    its term.

    The postings are a table dealt and sorted by term, which AQE splits by size where a term is frequent, and written
    once. Document frequencies are counted there, and each posting is scored once, as its score is the same for all
    items. The scored postings, numbers only, move by document; there they meet the items' terms, and sums by item and
    document need no further shuffle while the items' table is small enough for Spark to broadcast (it is written, so
    its size is known; beyond, Spark joins by term and adds up partial sums). Of each partition only k rows an item go
    on to the last window.

    Each row is a document or an item of its own: null and repeated ids stand for themselves, null ids come last among
    equal scores. Null and empty texts, and those without a term, are no documents and ask for nothing; documents of
    score 0 aren't listed. Long texts are read in parts. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    asked, asked_path = stage(postings(items, item_col, text_col).select(F.col("at").alias("item_at"), F.col("id").alias("item"), "term", F.col("tf").alias("times")), "item-terms")
    terms = asked.select("term").distinct()
    size = asked.agg(F.coalesce(F.sum(F.octet_length("term") + 100), F.lit(0))).first()[0]
    only = frozenset(t.encode() for (t,) in terms.toLocalIterator()) if size <= most_bytes else None

    found = postings(docs, id_col, text_col, only, totals=True)
    table, _ = stage(found.hint("rebalance", "term").sortWithinPartitions("term", "at"), "postings")
    number, length = (x or 0 for x in table.where("term = ''").agg(F.sum("n"), F.sum("tf")).first())

    df = table.where("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2 * number + 2) / (2 * F.col("df") + 1))).cast("long")
    weights, _ = stage(df.join(terms, "term").select("term", weight.alias("w")).where("w > 0").withColumn("key", F.monotonically_increasing_id()), "term-weights")
    wanted, _ = stage(asked.join(weights, "term").select("key", "item_at", "item", "times"), "item-weights")
    drop(spark, asked_path)

    norm = F.lit(75) + floor_div(25 * F.col("n") * F.lit(number), F.lit(max(length, 1)))
    gain = F.col("w") * floor_div(1_000_000_000 * F.col("tf"), 1000 * F.col("tf") + 12 * norm)
    scored = table.where("term <> ''").join(weights, "term").select("at", "id", "key", gain.alias("gain")).where("gain > 0").repartition("at")
    sums = scored.join(wanted, "key").groupBy("at", "id", "item_at", "item").agg(F.sum(F.col("gain") * F.col("times")).alias("score"))
    order = Window.partitionBy("item_at").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "at")
    return sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


SQL = r"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS x, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
    s AS (SELECT count(*) AS nn, sum(len(ts))::BIGINT AS ll FROM d WHERE len(ts) > 0),
    p AS (SELECT x, doc_id, len(ts)::BIGINT AS n, t, count(*) AS tf FROM (SELECT x, doc_id, ts, unnest(ts) AS t FROM d) GROUP BY ALL),
    f AS (SELECT t, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY t),
    g AS (SELECT x, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * nn) // ll)))) AS gain FROM p JOIN f USING (t), s),
    q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
    r AS (SELECT item_id, x, doc_id, sum(gain)::BIGINT AS score FROM q JOIN g USING (t) GROUP BY ALL HAVING sum(gain) > 0)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r QUALIFY rank <= 20
"""
