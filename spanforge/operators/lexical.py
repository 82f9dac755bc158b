"""Scores from the corpus (V6, V11, E1, E2): document frequencies, BM25 as a join, projected tf-idf vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.plans.staging import staged

K1, B = 1.2, 0.75
#: Numbers of a projected vector: one for each digit of a term's MD5.
SIZE = 32
#: Terms whose frequencies go to all tasks (12 bytes each), and terms of texts that a task weighs at a time.
MOST_TERMS, STEP_TERMS = 1 << 22, 1 << 18


def terms(text: Column) -> Column:
    """Letters, digits and underscores, in lower case, with repeats."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1)


@dataclass
class Statistics:
    """Of a corpus: (id, term, tf, length) as a written table, (term, df), documents and their mean length. A
    vocabulary() has no occurrences and no length."""

    occurrences: DataFrame | None
    frequencies: DataFrame
    number: int
    mean: float

    def idf(self) -> Column:
        n = F.lit(float(self.number))
        return F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5))


def statistics(docs: DataFrame, id_col: str = "id", text_col: str = "text", wanted: DataFrame | None = None) -> Statistics:
    """Documents, mean length and term counts over all docs (id, text); occurrences of the wanted terms (term) only,
    if given, so that a rerank moves no others. Documents without terms count with length 0; ids tell documents apart.
    """
    split = docs.select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("terms"))
    sizes = split.agg(F.count(F.lit(1)), F.coalesce(F.avg(F.size("terms")), F.lit(0.0))).first()
    each = split.select("id", F.size("terms").alias("length"), F.explode("terms").alias("term"))
    if wanted is not None:
        each = each.join(wanted.select("term").distinct(), "term", "left_semi")
    found = staged(each.groupBy("id", "length", "term").agg(F.count(F.lit(1)).alias("tf")), "occurrences")
    frequencies = staged(found.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    return Statistics(found, frequencies, sizes[0], sizes[1])


def bm25(pairs: DataFrame, queries: DataFrame, stats: Statistics, digits: int = 6) -> DataFrame:
    """(qid, id, score) of pairs (qid, id): BM25 of the query's distinct terms (qid, term); 0 where none occurs."""
    tf = F.col("tf").cast("double")
    gain = stats.idf() * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / max(stats.mean, 1e-9)))
    asked = pairs.select("qid", "id").distinct().join(queries.select("qid", "term").distinct(), "qid")
    scores = asked.join(stats.occurrences, ["id", "term"]).join(stats.frequencies, "term").groupBy("qid", "id").agg(F.sum(gain).alias("score"))
    return pairs.select("qid", "id").distinct().join(scores, ["qid", "id"], "left").select("qid", "id", F.round(F.coalesce("score", F.lit(0.0)), digits).alias("score"))


def reranker(docs: DataFrame, queries: DataFrame, id_col: str = "id", text_col: str = "text") -> Callable[[DataFrame], DataFrame]:
    """For search.hybrid: a pool (qid, id, score, ...) with the BM25 of the query's text (qid, text) as its score.

    Document frequencies are of all docs; only terms that some query has are kept, and only pairs of the pool scored.
    """
    asked = queries.select("qid", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))

    def rerank(pool: DataFrame) -> DataFrame:
        pool = staged(pool, "pool")  # it is read twice
        stats = statistics(docs, id_col, text_col, asked)
        return pool.drop("score").join(bm25(pool, asked, stats), ["qid", "id"]).select(*pool.columns)

    return rerank


def told_apart(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows (id, text) whose id no other row has, and (id, term, tf) of all others; None if there are none."""
    several = staged(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("several")), "several-ids")
    if several.isEmpty():
        return rows, None
    same = F.col("id").eqNullSafe(F.col("several"))
    rest = rows.join(several, same, "left_semi").select("id", F.explode(terms(F.col("text"))).alias("term"))
    return rows.join(several, same, "left_anti"), rest.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> Statistics:
    """Documents and document frequencies only: a task counts the terms of its documents before they move."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    single, rest = told_apart(rows)
    each = single.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    each = each if rest is None else each.unionAll(rest.select("term"))
    return Statistics(None, staged(each.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequencies"), docs.count(), 0.0)


def digests(terms: pa.Array) -> np.ndarray:
    """The MD5 of each term, a row of 16 bytes."""
    raw = b"".join(hashlib.md5(t, usedforsecurity=False).digest() for t in terms.cast(pa.binary()).to_pylist())
    return np.frombuffer(raw, np.uint8).reshape(-1, 16)


def known(stats: Statistics, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The first 64 bits of the MD5 of the terms that at least so many documents have, in order, their frequencies, and
    this number: 2, or more where these are over `most` terms."""
    octaves = stats.frequencies.where("df > 1").groupBy(F.floor(F.log2("df")).cast("int").alias("octave")).agg(F.count(F.lit(1)).alias("n")).collect()
    least = next(x for x in range(1, 64) if sum(r["n"] for r in octaves if r["octave"] >= x) <= most)
    found = stats.frequencies.where(F.col("df") >= 1 << least).select(F.unhex(F.substring(F.md5("term"), 1, 16)).alias("h"), F.col("df").cast("int").alias("df")).toArrow()
    h = np.frombuffer(b"".join(found["h"].to_pylist()), ">u8").astype(np.uint64)
    by = np.argsort(h)
    return h[by], found["df"].to_numpy()[by], 1 << least


WEIGHED = "id {kind}, vector array<double>, term string, tf bigint"


def vectors(rows: DataFrame, stats: Statistics, id_col: str = "id", text_col: str = "text", most: int = MOST_TERMS) -> DataFrame:
    """(id, vector): tf-idf of each text, projected to SIZE numbers by signs from the terms' MD5, of length 1.

    A model's place without a model: texts that share rare words are near. A term's sign in place j is + where digit j
    of its digest is below 8; terms that the corpus doesn't have count like those of a single
    document. Texts without terms have no direction and give no row.

    The frequencies of the `most` most frequent terms go to all tasks, found by 64 bits of their digests, and a task weighs
    its texts where they lie; terms of one document need none. Only what the rarer terms of a larger vocabulary add, and the
    terms of rows that share an id, is shuffled, as rows.
    """
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    single, rest = told_apart(rows)
    hashes, frequencies, least = known(stats, most)
    number = float(stats.number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            step = np.cumsum(length) // STEP_TERMS
            cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if length[a:b].any():
                    yield from weighed(batch.column(0)[a:b], batch.column(1)[a:b].flatten().dictionary_encode(), length[a:b])

    def weighed(ids: pa.Array, words: pa.DictionaryArray, length: np.ndarray) -> Iterator[pa.RecordBatch]:
        digest, n = digests(words.dictionary), len(words.dictionary)
        h = np.ascontiguousarray(digest[:, :8]).view(">u8").reshape(n).astype(np.uint64)
        at = np.minimum(np.searchsorted(hashes, h), max(0, len(hashes) - 1))
        there = hashes[at] == h if len(hashes) else np.zeros(n, bool)
        df = np.where(there, frequencies[at], 1) if len(hashes) else np.ones(n)
        idf = np.log1p((number - df + 0.5) / (df + 0.5))
        sign = 1.0 - 2.0 * np.unpackbits(digest, axis=1)[:, ::4][:, :SIZE]
        pair, tf = np.unique(np.repeat(np.arange(len(ids)), length) * n + words.indices.to_numpy(), return_counts=True)
        doc, term = pair // n, pair % n
        if least > 2 and not (own := there[term]).all():
            far = ~own
            rare = words.dictionary.take(pa.array(term[far]))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc[far])), pa.nulls(int(far.sum()), pa.list_(pa.float64())), rare, pa.array(tf[far])], ["id", "vector", "term", "tf"])
            doc, term, tf = doc[own], term[own], tf[own]
        if not len(doc):
            return
        w = (1 + np.log(tf)) * idf[term]
        sums = np.stack([np.bincount(doc, w * sign[term, j], len(ids)) for j in range(SIZE)], axis=1)
        full = np.flatnonzero(np.bincount(doc, minlength=len(ids)))
        vector = pa.ListArray.from_arrays(pa.array(np.arange(0, SIZE * len(full) + 1, SIZE, np.int32)), pa.array(sums[full].ravel()))
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(full)), vector, pa.nulls(len(full), pa.string()), pa.nulls(len(full), pa.int64())], ["id", "vector", "term", "tf"])

    kind = rows.schema["id"].dataType.simpleString()
    summed = single.select("id", terms(F.col("text")).alias("terms")).mapInArrow(run, WEIGHED.format(kind=kind))
    if rest is not None or least > 2:
        made = staged(summed, "weighed")
        far = made.where("term is not null").select("id", "term", "tf")
        far = far if rest is None else far.unionAll(rest)
        met = far.join(stats.frequencies, "term", "left").withColumn("df", F.coalesce("df", F.lit(1)))
        weight = (1 + F.log(F.col("tf").cast("double"))) * stats.idf()
        signed = [F.sum(F.when(F.substring(F.col("digest"), j + 1, 1) < "8", F.col("w")).otherwise(-F.col("w"))) for j in range(SIZE)]
        # Narrow rows are shuffled, not sums of SIZE numbers for each task and document.
        more = met.select("id", weight.alias("w"), F.md5("term").alias("digest")).repartition("id").groupBy("id").agg(F.array(*signed).alias("more"))
        near = made.where("term is null").select(F.col("id").alias("own"), "vector")
        total = F.when(F.col("more").isNull(), F.col("vector")).when(F.col("vector").isNull(), F.col("more")).otherwise(F.zip_with("vector", "more", lambda x, y: x + y))
        summed = near.join(more, F.col("own").eqNullSafe(F.col("id")), "full").select(F.coalesce("own", "id").alias("id"), total.alias("vector"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    return summed.select("id", "vector").withColumn("norm", norm).where("norm > 0").select("id", F.transform("vector", lambda x: x / F.col("norm")).alias("vector"))
