"""Vector search and hybrid ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from spanforge.functions.paths import is_test
from spanforge.functions.vector import cosine  # noqa: F401  for callers that score pairs
from spanforge.operators.graph import file_key
from spanforge.plans.staging import staged

#: Bytes of a query set's vectors up to which it is sent to every task; a larger one meets the rows in blocks.
MOST_BYTES = 128 << 20

#: Scores that are worked out at a time, and best ones of a query set up to which it is one block.
STEP_SCORES, MOST_BEST = 1 << 22, 1 << 22


def filters(corpus: DataFrame, repo: str | None = None, path: str | None = None, path_contains: str | None = None, kind: str | None = None) -> DataFrame:
    """Conditions that all hold, before any scoring, so that they reach the scan."""
    for condition in (repo and F.col("repo") == repo, path and F.col("path") == path, path_contains and F.col("path").contains(path_contains), kind and F.col("type") == kind):
        if condition is not None:
            corpus = corpus.where(condition)
    return corpus


def unit(vectors: pa.Array, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of the wanted length that have a direction, and these as unit vectors."""
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(size == wanted)
    if not wanted or not len(at):
        return at[:0], np.zeros((0, wanted))
    x = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), wanted)
    norm = np.sqrt((x * x).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return at[good], x[good] / norm[good][:, None]


def against(corpus: DataFrame, queries: DataFrame, wanted: list[str], id_col: str, skip_self: bool, work: Callable[..., Iterator[pa.RecordBatch]], schema: StructType, most_bytes: int, best: int = 1) -> DataFrame:
    """work(qids, steps) of the rows of a task and the queries they meet, in steps of (scores, rows) of STEP_SCORES
    scores at most, however many queries there are; each query meets each row once. best: what work keeps of a query.

    Up to most_bytes of vectors the queries are one matrix that goes to each task. Beyond, queries and rows are dealt
    into blocks of about that size and each pair of blocks is one group, so nothing that grows reaches the driver.
    """
    sizes = queries.groupBy(F.coalesce(F.size("query"), F.lit(0)).alias("size")).agg(F.count(F.lit(1)).alias("n")).where("size > 0")
    length = sizes.orderBy(F.col("n").desc(), "size").first()
    length, number = length or (0, 0)
    queries = queries.where(F.size("query") == length).select("qid", F.col("query").cast("array<double>").alias("query"))
    rows = corpus.where(F.size("embedding") == length).select(*wanted, "embedding")

    def meet(qids: pa.Array, matrix: np.ndarray, batches: Iterable[pa.RecordBatch | pa.Table]) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
        step = max(1, STEP_SCORES // max(1, len(matrix)))
        for batch in (b.slice(start, step) for b in batches for start in range(0, b.num_rows, step)):
            place, x = unit(column(batch, len(wanted)), length)
            if not len(place) or not len(matrix):
                continue
            score = matrix @ x.T
            np.clip(score, -1, 1, out=score)
            if skip_self:
                ids = column(batch, wanted.index(id_col)).take(pa.array(place))
                if ids.type == qids.type or (pa.types.is_integer(ids.type) and pa.types.is_integer(qids.type)):
                    same = pc.index_in(ids, value_set=qids.cast(ids.type)).to_numpy(zero_copy_only=False).astype(float)
                    hit = np.flatnonzero(~np.isnan(same))
                    score[same[hit].astype(int), hit] = -np.inf
            yield score, [column(batch, i).take(pa.array(place)) for i in range(len(wanted))]

    def heads(table: pa.Table, i: int) -> tuple[pa.Array, np.ndarray]:
        at, matrix = unit(column(table, i + 1), length)
        return column(table, i).take(pa.array(at, pa.int64())), matrix

    blocks = max(-(-number * length * 8 // most_bytes), -(-number * best // MOST_BEST))
    if blocks <= 1:
        qids, matrix = heads(queries.toArrow(), 0)
        return rows.mapInArrow(lambda batches: work(qids, meet(qids, matrix, batches)), schema)

    parts = max(1, -(-rows.count() * length * 8 // most_bytes))
    deal = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("qid", "query", deal(blocks, "qid").alias("block_"), every(parts).alias("part_"))
    right = rows.select("*", deal(parts, id_col, "embedding").alias("part_")).select("*", every(blocks).alias("block_"))
    empty = pa.table({f.name: pa.array([], t) for f, t in zip(schema.fields, to_arrow_schema(schema).types)})

    def pair(asked: pa.Table, found: pa.Table) -> pa.Table:
        qids, matrix = heads(asked, 0)
        out = list(work(qids, meet(qids, matrix, [found])))
        return pa.Table.from_batches(out).cast(empty.schema) if out else empty

    return left.groupBy("block_", "part_").cogroup(right.groupBy("block_", "part_")).applyInArrow(pair, schema)


def column(batch: pa.RecordBatch | pa.Table, i: int) -> pa.Array:
    found = batch.column(i)
    return found if isinstance(found, pa.Array) else pa.concat_arrays(found.chunks) if found.num_chunks else pa.array([], found.type)


def nearest(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "id", keep: tuple[str, ...] = (), skip_self: bool = True, digits: int = 6, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(qid, id, score, rank): the k most similar rows for each query (qid, query), ties to the lower id.

    Rows are multiplied with the queries in steps, in blocks where these are many, and of a task's rows only those that
    may be among a query's k go on, so what moves is about k rows a query and task, and what a task holds is bounded. Vectors that are null, zero, not
    finite or of another length than the queries' take no part; queries are as long as most of them are. Scores are
    cosines in doubles, no less than -1 nor more than 1.
    """
    wanted = [*dict.fromkeys([id_col, *keep])]

    def best(qids: pa.Array, steps: Iterator[tuple[np.ndarray, list[pa.Array]]]) -> Iterator[pa.RecordBatch]:
        least = np.full(len(qids), -np.inf)
        kept, held = [], 0  # (queries, scores, columns of their rows)

        def cut() -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
            q, score = np.concatenate([x[0] for x in kept]), np.concatenate([x[1] for x in kept])
            columns = [pa.concat_arrays([x[2][i] for x in kept]) for i in range(len(wanted))]
            if not len(q):
                return q, score, columns
            order = np.lexsort((-score, q))
            first = np.searchsorted(q[order], np.arange(len(qids)))
            last = np.minimum(first + k - 1, len(q) - 1)
            full = (first + k <= len(q)) & (q[order][last] == np.arange(len(qids)))
            least[full] = np.maximum(least[full], score[order][last[full]])
            # Scores are rounded later, so those that may be equal to the last one then go on too.
            good = np.flatnonzero(score >= least[q] - 2 * 10.0**-digits)
            return q[good], score[good], [c.take(pa.array(good)) for c in columns]

        for score, rows in steps:
            if not held and score.shape[1] >= k:
                least = np.maximum(least, np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k])
            q, row = np.nonzero(score >= np.maximum(least - 2 * 10.0**-digits, -2)[:, None])
            kept.append((q, score[q, row], [c.take(pa.array(row)) for c in rows]))
            held += len(q)
            if held > 2 * k * len(qids) + STEP_SCORES // 4:
                kept = [cut()]
                held = len(kept[0][0])
                if held > k * len(qids) + STEP_SCORES // 4:  # very many equal scores: they needn't stay here
                    yield from given(qids, kept.pop())
                    held = 0
        if kept:
            yield from given(qids, cut())

    def given(qids: pa.Array, found: tuple[np.ndarray, np.ndarray, list[pa.Array]]) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(found[0]), 1 << 17):
            part = slice(low, low + (1 << 17))
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(found[0][part])), *[c[part] for c in found[2]], pa.array(found[1][part])], ["qid", *wanted, "raw"])

    schema = StructType([queries.schema["qid"], *corpus.select(*wanted).schema.fields, StructField("raw", DoubleType())])
    scored = against(corpus, queries, wanted, id_col, skip_self, best, schema, most_bytes, k).select("qid", *wanted, F.round("raw", digits).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col(id_col))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def alike(corpus: DataFrame, queries: DataFrame, least: float, id_col: str = "id", skip_self: bool = True, digits: int = 6, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(qid, hits, best): how many rows score least or more for each query, and the highest score; 0 and null where
    none does. Counts are summed for each task before they move."""

    def tally(qids: pa.Array, steps: Iterator[tuple[np.ndarray, list[pa.Array]]]) -> Iterator[pa.RecordBatch]:
        hits, top = np.zeros(len(qids), np.int64), np.full(len(qids), -1.0)
        for score, _ in steps:
            hits += (np.round(score, digits) >= least).sum(1)
            top = np.maximum(top, score.max(1))
        q = np.flatnonzero(hits)
        yield pa.RecordBatch.from_arrays([qids.take(pa.array(q)), pa.array(hits[q]), pa.array(top[q])], ["qid", "hits", "best"])

    schema = StructType([queries.schema["qid"], StructField("hits", LongType()), StructField("best", DoubleType())])
    parts = against(corpus, queries, [id_col], id_col, skip_self, tally, schema, most_bytes)
    found = parts.groupBy("qid").agg(F.sum("hits").alias("hits"), F.round(F.max("best"), digits).alias("best"))
    return queries.select("qid").join(found, "qid", "left").select("qid", F.coalesce("hits", F.lit(0)).alias("hits"), "best")


def pool_size(limit: int, rerank: bool = False, exclude_tests: bool = False, boost: bool = False) -> int:
    """Candidates to fetch, so that later filters and ranks have enough to choose from (V4)."""
    return int(limit * ((10 if rerank else 1) + 0.5 * exclude_tests + 2 * boost))


def co_references(refs: DataFrame, sources: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(path, neighbour): files that refer to the same target in the same repository in the same way.

    With `by`, columns of refs, only references alike in these meet, and the columns come first; ("repo_id",) tells
    apart files that have the same path in several repositories. Sources (path, or repo_id and path) limit the files.
    """
    key = [*dict.fromkeys([*by, "repo_id", "type", "dst"])]
    a = refs.select(*key, F.col("src").alias("path"))
    if sources is not None:
        a = a.join(sources.select(*file_key(sources)).distinct(), file_key(sources), "left_semi")
    b = refs.select(*key, F.col("src").alias("neighbour"))
    return a.join(b, key).where("path <> neighbour").select(*by, "path", "neighbour").distinct()


#: Files up to which a target's files are paired, and targets with more up to which a file's are counted by subsets.
LIGHT, MOST_SUBSETS = 64, 6


def co_reference_counts(refs: DataFrame, by: tuple[str, ...] = (), light: int = LIGHT, most_subsets: int = MOST_SUBSETS) -> DataFrame:
    """(by, path, neighbours): how many other files refer to a target that the file refers to (J4); none is no row.

    Targets of at most `light` files pair these. Heavier ones never do: the files that share one of a file's heavy
    targets are counted by inclusion and exclusion over the sets of heavy targets that files have, each file adding to
    the count of each subset of its own; work is linear in their edges. Files with more than `most_subsets` heavy
    targets are few kinds by nature; for each kind, bitmaps of the targets' files are united. Light pairs that
    share a heavy target, too, are left out, so each neighbour counts once.
    """
    target = [*dict.fromkeys([*by, "repo_id", "type", "dst"])]
    file = [*by, "path"]
    # Files and targets of several get numbers, which hold once written; a file with its targets is a row, which numbers it
    # where its edges are made distinct.
    own = [c for c in target if c not in by]
    known = refs.select(*target, F.col("src").alias("path")).dropna(subset=file).repartition(*file).distinct()
    files = known.groupBy(*file).agg(F.collect_list(F.struct(*own)).alias("targets")).withColumn("no", F.monotonically_increasing_id())
    files = staged(files, "reference-files")
    edges = files.select(*by, "no", F.explode("targets").alias("t")).select(*by, "no", "t.*")
    several = edges.groupBy(*target).agg(F.count(F.lit(1)).alias("files")).where("files > 1")
    several = staged(several.select(*target, (F.col("files") > light).alias("heavy"), F.monotonically_increasing_id().alias("target")), "reference-targets")
    numbered = staged(edges.join(several, target).select(*by, "no", "target", "heavy"), "numbered-references")

    on_heavy = numbered.where("heavy")
    sets = staged(on_heavy.groupBy("no", *by).agg(F.sort_array(F.collect_list("target")).alias("set")), "heavy-sets")  # a file has no more than its own targets
    kinds = sets.groupBy(*by, "set").agg(F.count(F.lit(1)).alias("n"))
    # By kind: how many files have a target of it. A part of a kind's set is held by each kind that has all of it.
    narrow = kinds.where(F.size("set") <= most_subsets)
    every = F.expr("transform(sequence(1, shiftleft(1, size(set)) - 1), m -> named_struct('part', filter(set, (t, i) -> (shiftright(m, i) & 1) = 1), 'sign', if(bit_count(m) % 2 = 1, 1, -1)))")
    asked = narrow.select(*by, "set", "n", F.explode(every).alias("p")).select(*by, "set", "n", "p.part", "p.sign")
    wide = kinds.where(F.size("set") > most_subsets)
    parts = asked.select(*by, "part").distinct().withColumn("first", F.element_at("part", 1))
    wide_hits = wide.select(*by, "set", "n", F.explode("set").alias("first")).join(parts, [*by, "first"]).where(F.size(F.array_except("part", "set")) == 0)
    held = asked.select(*by, "n", "part").unionByName(wide_hits.select(*by, "n", "part")).groupBy(*by, "part").agg(F.sum("n").alias("held"))
    counted = asked.join(held, [*by, "part"]).groupBy(*by, "set").agg(F.sum(F.col("sign") * F.col("held")).alias("near"))

    maps = on_heavy.join(wide.select(F.explode("set").alias("target")).distinct(), "target", "left_semi").groupBy("target", F.expr("bitmap_bucket_number(no)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(no))").alias("map"))
    united = wide.select(*by, "set", F.explode("set").alias("target")).join(maps, "target").groupBy(*by, "set", "bucket").agg(F.expr("bitmap_count(bitmap_or_agg(map))").alias("near"))
    near = counted.unionByName(united.groupBy(*by, "set").agg(F.sum("near").alias("near")))
    by_heavy = sets.join(near, [*by, "set"]).select("no", (F.col("near") - 1).alias("n"))

    on_light = numbered.where("not heavy").select("target", "no")
    pairs = on_light.join(on_light.withColumnRenamed("no", "other"), "target").where("no <> other").select("no", "other").distinct()
    there = sets.select("no", "set")
    apart = pairs.join(there, "no", "left").join(there.select(F.col("no").alias("other"), F.col("set").alias("others")), "other", "left").where(~F.coalesce(F.arrays_overlap("set", "others"), F.lit(False)))
    by_light = apart.groupBy("no").agg(F.count(F.lit(1)).alias("n"))
    total = by_heavy.unionByName(by_light).groupBy("no").agg(F.sum("n").alias("neighbours")).where("neighbours > 0")
    return files.join(total, "no").select(*file, "neighbours")


def boosted(pool: DataFrame, refs: DataFrame, weight: float = 0.05, digits: int = 6) -> DataFrame:
    """Adds weight to a score for each other path of the same query's pool that shares a reference (V5). If the pool
    has repo_id, its files are those of that repository."""
    key = file_key(pool)
    paths = pool.select("qid", *key[:-1], F.col("path").alias("src")).distinct()
    near = co_references(refs.select("src", "repo_id", "type", "dst").join(paths, [*key[:-1], "src"]), by=("qid", *key[:-1]))
    counts = near.groupBy("qid", *key).agg(F.count(F.lit(1)).alias("together"))
    return pool.join(counts, ["qid", *key], "left").withColumn("score", F.round(F.col("score") + weight * F.coalesce("together", F.lit(0)), digits)).drop("together")


def hybrid(corpus: DataFrame, query: DataFrame, refs: DataFrame | None, limit: int = 10, exclude_tests: bool = True, weight: float = 0.05, rerank: Callable[[DataFrame], DataFrame] | None = None, **conditions) -> DataFrame:
    """Search, drop test files, boost, rerank and cut: each step sees the candidates of the one before it.

    If corpus has repo_id, results carry it, and the boost tells files of different repositories apart.
    """
    boost = refs is not None and weight != 0
    file = file_key(corpus)
    pool = nearest(filters(corpus, **conditions), query, pool_size(limit, rerank is not None, exclude_tests, boost), keep=tuple(file)).drop("rank")
    if exclude_tests:
        pool = pool.where(~is_test(F.col("path")))
    if boost:
        pool = boosted(pool, refs, weight)
    if rerank is not None:
        pool = rerank(pool)
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    return pool.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("qid", "id", *file, "score", "rank")


def embedded_queries(rows: DataFrame, embed: Callable[[Column], Column], fallback: Callable[[Column], Column]) -> DataFrame:
    """(qid, query) from (qid, text): by the model, or by the fallback where it gives no vector."""
    return rows.select("qid", F.coalesce(embed(F.col("text")), fallback(F.col("text"))).alias("query"))


def fallback_scores(ranked: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """1 - (place - 1) / number, for when no model scores (V7)."""
    own = Window.partitionBy(group)
    return ranked.withColumn("score", F.round(1 - (F.row_number().over(own.orderBy(*order)) - 1) / F.count(F.lit(1)).over(own), 6))
