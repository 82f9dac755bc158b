"""Indexed vector search (V2, V3): an inverted file of lists around centroids, and bounds that say what is exact."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from spanforge.operators.search import column, unit
from spanforge.plans.staging import staged

#: Vectors at most that centroids are fitted on and probes are calibrated with; the index holds every vector.
SAMPLE = 1 << 16
#: Rows of a list aimed at, lists at most (each from 16 vectors of the sample at least), and rows of one block of a list.
LIST_ROWS, MOST_LISTS, BLOCK_ROWS = 64, 4096, 1 << 15
#: Rounds of the fit; queries that calibrate the probes; the recall at `TARGET_K` that these shall reach on the sample.
ROUNDS, TRIALS, TARGET_K, TARGET = 12, 256, 10, 0.95
#: Two cosines closer than this may be equal once rounded.
SLACK = 2e-6


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


@dataclass
class Index:
    """Centroids, the radius of each list as an angle, its blocks, and the table (list, block, id, ..., embedding)."""

    table: DataFrame
    centroids: np.ndarray
    radius: np.ndarray
    blocks: np.ndarray
    probes: int
    id_col: str
    keep: list[str] = field(default_factory=list)

    @property
    def length(self) -> int:
        return self.centroids.shape[1]

    def save(self, folder: str) -> None:
        """The lists as a table partitioned by list, and the rest, which is of bounded size, as one row beside it."""
        spark = self.table.sparkSession
        self.table.repartition("list", "block").write.partitionBy("list").mode("overwrite").parquet(f"{folder}/lists")
        head = {"centroids": self.centroids.tolist(), "radius": self.radius.tolist(), "blocks": self.blocks.tolist(), "probes": self.probes, "id_col": self.id_col, "keep": self.keep}
        spark.createDataFrame([(json.dumps(head),)], "head string").coalesce(1).write.mode("overwrite").text(f"{folder}/head")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Index:
        head = json.loads(spark.read.text(f"{folder}/head").first()[0])
        table = spark.read.parquet(f"{folder}/lists")
        return Index(table, np.array(head["centroids"]), np.array(head["radius"]), np.array(head["blocks"]), head["probes"], head["id_col"], head["keep"])


def fitted(x: np.ndarray, lists: int, seed: int = 0) -> np.ndarray:
    """Centroids of the unit vectors x: the k-means of directions."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(ROUNDS):
        own = nearest_lists(x, c, 1)[:, 0]
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1)
        empty = norm < 1e-9
        sums[empty], norm[empty] = x[rng.choice(len(x), int(empty.sum()))], 1
        c = sums / norm[:, None]
    return c


def nearest_lists(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    out = np.empty((len(x), n), np.int64)
    for a in range(0, len(x), 4096):
        s = x[a : a + 4096] @ centroids.T
        out[a : a + 4096] = np.argsort(-s, axis=1, kind="stable")[:, :n] if n > 1 else s.argmax(1)[:, None]
    return out


def calibrated(x: np.ndarray, centroids: np.ndarray, seed: int = 1) -> int:
    """Lists to probe so that the neighbours of sampled vectors in the sample are found TARGET of the time."""
    rng = np.random.default_rng(seed)
    q = rng.choice(len(x), min(TRIALS, len(x)), replace=False)
    scores = x[q] @ x.T
    scores[np.arange(len(q)), q] = -np.inf
    k = min(TARGET_K, len(x) - 1)
    if k < 1:
        return 1
    true = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    own = nearest_lists(x, centroids, 1)[:, 0]
    place = np.argsort(nearest_lists(x[q], centroids, len(centroids)), axis=1)  # rank of each list for each query
    ranks = np.sort(np.take_along_axis(place, own[true], axis=1).reshape(-1))
    return int(ranks[min(len(ranks) - 1, int(np.ceil(TARGET * len(ranks))))]) + 1


def build(corpus: DataFrame, id_col: str = "id", keep: tuple[str, ...] = (), vector_col: str = "embedding", seed: int = 0, sample: int = SAMPLE, list_rows: int = LIST_ROWS) -> Index:
    """An index of every vector of corpus that has a direction and the usual length.

    Centroids come from a sample by hash of the id, of `sample` vectors about; each vector then goes to the list of
    its nearest centroid. A list is dealt into blocks by its size, so a list that holds a third of all rows is as many
    tasks as it needs.
    """
    rows = corpus.select(*dict.fromkeys([id_col, *keep]), F.col(vector_col).cast("array<double>").alias("embedding")).where(F.size("embedding") > 0)
    wanted = rows.columns[:-1]
    # Lengths are few; where they differ, most rows decide.
    top = rows.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "size").first()
    length, number = top if top else (0, 0)
    rows = rows.where(F.size("embedding") == length)
    modulus = max(1, number // sample)
    picked = rows.where(F.pmod(F.xxhash64(id_col), F.lit(modulus)) == seed % modulus).select("embedding").limit(2 * sample).toArrow()
    _, x = unit(column(picked, 0), length) if picked.num_rows else (None, np.zeros((0, length)))
    lists = int(max(1, min(MOST_LISTS, number // list_rows, len(x) // 16)))
    centroids = fitted(x, lists, seed) if len(x) else np.zeros((1, max(length, 1)))
    probes = calibrated(x, centroids) if len(x) else 1

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, y = unit(batch.column(len(wanted)), length)
            if not len(at):
                continue
            own = nearest_lists(y, centroids, 1)[:, 0]
            angle = angles((y * centroids[own]).sum(1))
            kept = [batch.column(i).take(pa.array(at)) for i in range(len(wanted))]
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * length, pa.int32()), pa.array(y.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*kept, vectors, pa.array(own.astype(np.int32)), pa.array(angle)], [*wanted, "embedding", "list", "angle"])

    schema = StructType([*rows.schema.fields, StructField("list", IntegerType()), StructField("angle", DoubleType())])
    assigned = staged(rows.mapInArrow(assign, schema), "assigned")
    radius, blocks = np.full(lists, -1.0), np.zeros(lists, np.int64)
    for r in assigned.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("r")).collect():  # a row a list
        radius[r["list"]], blocks[r["list"]] = r["r"], -(-r["n"] // BLOCK_ROWS)
    block = F.pmod(F.xxhash64(id_col, "embedding"), by_list(blocks)).cast("int")
    table = assigned.select("list", block.alias("block"), *wanted, "embedding")
    return Index(table, centroids, radius, blocks, probes, id_col, list(wanted))


def by_list(values: np.ndarray) -> Column:
    """The value of a row's list, 1 at least; there are MOST_LISTS at most."""
    if values.max(initial=1) <= 1:
        return F.lit(1)
    return F.element_at(F.array(*[F.lit(int(v)) for v in np.maximum(values, 1)]), F.col("list") + 1)


def asked(index: Index, queries: DataFrame) -> DataFrame:
    """Queries (qid, query) that can be asked, as doubles."""
    return queries.select("qid", F.col("query").cast("array<double>").alias("query")).where(F.size("query") == index.length)


def probed(index: Index, queries: DataFrame, probes: int, least: str | None = None) -> DataFrame:
    """(qid, query, list, block): the `probes` nearest lists of each query; or, with a column `least`, all others that
    may hold a vector of at least that cosine. Also `bound` (list -1): the most that a list not probed can hold."""
    c, radius, blocks = index.centroids, index.radius, index.blocks
    lists, length = len(c), index.length

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = unit(batch.column(1), length)
            if not len(at):
                continue
            s = x @ c.T
            order = np.argsort(-s, axis=1, kind="stable")
            most = np.where(radius >= 0, np.cos(np.maximum(0, angles(s) - radius - 1e-7)), -2.0)
            near = np.zeros((len(at), lists), bool)
            np.put_along_axis(near, order[:, :probes], True, axis=1)
            rest = np.where(near, -2.0, most)
            if least is None:
                wanted = near & (radius >= 0)
            else:
                floor = batch.column(2).take(pa.array(at)).to_numpy(zero_copy_only=False)
                wanted = rest >= floor[:, None] - SLACK
            q, l = np.nonzero(wanted)  # noqa: E741
            times = blocks[l]
            q, l = np.repeat(q, times), np.repeat(l, times)  # noqa: E741
            block = np.arange(len(q)) - np.repeat(np.cumsum(times) - times, times)
            place = pa.array(at)
            if least is None:
                q, l, block = np.append(q, np.arange(len(at))), np.append(l, np.full(len(at), -1)), np.append(block, np.zeros(len(at), int))  # noqa: E741
            chosen = batch.slice(0).take(place).take(pa.array(q))
            yield pa.RecordBatch.from_arrays([chosen.column(0), chosen.column(1), pa.array(l.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(rest.max(1)[q])], ["qid", "query", "list", "block", "bound"])

    kind = queries.schema["qid"].dataType.simpleString()
    return queries.mapInArrow(work, f"qid {kind}, query array<double>, list int, block int, bound double")


def scored(index: Index, pairs: DataFrame, k: int, skip_self: bool) -> DataFrame:
    """(qid, kept columns, raw): of each query's probed blocks, the rows that may be among its first k."""
    qid, length, keep, id_col = pairs.schema["qid"], index.length, index.keep, index.id_col
    schema = StructType([qid, *index.table.select(*index.keep).schema.fields, StructField("raw", DoubleType())])
    empty = pa.table({f.name: pa.array([], t) for f, t in zip(schema.fields, to_arrow_schema(schema).types, strict=True)})
    def meet(asked_: pa.Table, found: pa.Table) -> pa.Table:
        if not asked_.num_rows or not found.num_rows:
            return empty
        _, q = unit(column(asked_, 1), length)
        qids, out = column(asked_, 0), []
        _, x = unit(column(found, found.schema.get_field_index("embedding")), length)
        ids = column(found, found.schema.get_field_index(id_col))
        for a in range(0, len(q), step := max(1, (1 << 23) // max(1, len(x)))):
            s = q[a : a + step] @ x.T
            if skip_self and pa.types.is_integer(ids.type) and pa.types.is_integer(qids.type):
                s[qids.slice(a, step).to_numpy(zero_copy_only=False)[:, None] == ids.to_numpy(zero_copy_only=False)[None, :]] = -np.inf
            n = min(k, s.shape[1])
            floor = np.maximum(np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n], -2)[:, None] - SLACK
            i, j = np.nonzero(s >= floor)
            out.append(pa.table([qids.take(pa.array(a + i)), *[column(found, found.schema.get_field_index(c)).take(pa.array(j)) for c in keep], pa.array(np.clip(s[i, j], -1, 1))], names=[*empty.schema.names]))
        return pa.concat_tables(out).cast(empty.schema)

    # A list that very many queries probe meets them in blocks, too.
    many = np.zeros(len(index.centroids), np.int64)
    for r in pairs.where("list >= 0 and block = 0").groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():  # a row a list
        many[r["list"]] = -(-r["n"] // BLOCK_ROWS)
    parts = by_list(many)
    left = pairs.where("list >= 0").select("qid", "query", F.col("list").alias("list_"), F.col("block").alias("block_"), F.pmod(F.xxhash64("qid"), parts).cast("int").alias("part_"))
    right = index.table.select("*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return left.groupBy("list_", "block_", "part_").cogroup(right.groupBy("list", "block", "part")).applyInArrow(meet, schema)


def nearest(index: Index, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False, skip_self: bool = True, digits: int = 6) -> DataFrame:
    """(qid, kept columns, score, rank, exact): k most similar rows of the lists probed for each query.

    Scores are cosines, worked out anew from the vectors, ties to the lower id. A query is exact if no list left out
    can hold a row as similar as its last one: the angle to a row is never less than that to the list's centroid less
    the list's radius. With exact=True the lists that may are probed in a second round, so all are. Where vectors have
    no clusters that is nearly all lists; a scan is then as good.
    """
    n = min(probes or index.probes, len(index.centroids))
    wanted = asked(index, queries)
    pairs = staged(probed(index, wanted, n), "probes")
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col(index.id_col))
    rank = lambda rows: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    first = staged(rank(scored(index, pairs, k, skip_self).withColumn("score", F.round("raw", digits))), "first-round")
    bounds = pairs.where("list = -1").select("qid", "query", "bound")
    last = first.groupBy("qid").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("found"))
    state = bounds.join(last, "qid", "left").select("qid", "query", F.when(F.col("found") >= k, F.col("least")).otherwise(F.lit(-1.0)).alias("least"), (F.coalesce(F.col("found") >= k, F.lit(False)) & (F.col("bound") < F.col("least") - SLACK) | (F.col("bound") < -1)).alias("exact"))
    if not exact:
        return first.join(state.select("qid", "exact"), "qid").select("qid", *index.keep, "score", F.col("rank").cast("long").alias("rank"), "exact")
    again = staged(probed(index, state.where("not exact").select("qid", "query", "least"), n, "least"), "probes-again")
    more = scored(index, again, k, skip_self).withColumn("score", F.round("raw", digits))
    both = first.select("qid", *index.keep, "score").unionByName(more.select("qid", *index.keep, "score"))
    return rank(both).select("qid", *index.keep, "score", F.col("rank").cast("long").alias("rank"), F.lit(True).alias("exact"))


def recall(found: DataFrame, true: DataFrame, by: list[str]) -> DataFrame:
    """(queries, wanted, hits, recall) of found against the true neighbours, both with the columns `by`."""
    flagged = true.select(*by).distinct().join(found.select(*by).distinct().withColumn("hit", F.lit(1)), by, "left")
    return flagged.agg(F.count_distinct(by[0]).alias("queries"), F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("hits"), F.round(F.count("hit") / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("recall"))
