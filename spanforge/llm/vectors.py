"""Near-duplicate embeddings by an exact metric range join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.components import components
from spanforge.llm.shared import partitions, stage

#: Vectors, and bytes of them, of a cell's block, which a task holds while the others stream by.
BLOCK, BLOCK_BYTES = 1 << 16, 32 << 20
#: Vectors of a cell that is worth a pivot; pivots at most; leading numbers of a vector that are compared before the whole.
CELL, MOST_PIVOTS, HEAD = 4096, 256, 12
#: Rows of either side that are multiplied at a time.
STRIDE, TILE = 1024, 4096


def slack(size: int) -> float:
    """More than the rounding error of a distance worked out as sqrt(2 - 2 xy) from unit vectors of `size` numbers.

    A product of unit vectors is off by (size + 8) * 2**-53 at most, normalising included; under the root that is
    largest near 0, where it becomes its own root.
    """
    return 2 * float(np.sqrt(2 * (size + 8) * 2.0**-52))


def unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    return x / np.linalg.norm(x, axis=1)[:, None]


def headed(x: np.ndarray) -> np.ndarray:
    """The first HEAD numbers of each vector, and the length of the rest: products of these are never below those
    of the whole vectors, as the rest's product is at most the product of its lengths (Cauchy-Schwarz)."""
    k = min(HEAD, x.shape[1])
    return np.concatenate([x[:, :k], np.linalg.norm(x[:, k:], axis=1)[:, None]], axis=1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector as doubles, size) of the rows whose vector can have a cosine."""
    v = vectors[vector_col]
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), v.cast("array<double>").alias("v")).where(good)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            size = column.value_lengths().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(size)])
            out = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):  # noqa: B905
                x = flat[a:b] / np.abs(flat[a:b]).max()  # so that no square over- or underflows
                out.append((x + 0.0).tobytes())  # + 0.0: no negative zeros
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(size, pa.int32())], ["id", "vector", "size"])

    return rows.mapInArrow(run, "id bigint, vector binary, size int")


class Pivots:
    """The pivots of each vector length, and the bounds that say into which cells a vector must go."""

    def __init__(self, rows: list, radius: float) -> None:
        self.radius, self.by, self.rings = radius, {}, {}
        for size in {r["size"] for r in rows}:
            x = unit([bytes(r["vector"]) for r in rows if r["size"] == size])
            self.by[size] = (x, np.sqrt(np.maximum(0, 2 - 2 * x @ x.T)))

    def home(self, size: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest pivot of each vector, and the distances to all."""
        distance = np.sqrt(np.maximum(0, 2 - 2 * x @ self.by[size][0].T))
        return distance.argmin(1), distance

    def reach(self, size: int, home: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """Which cells may hold a vector within the radius of x.

        If y is in the cell of q, d(y, q) <= d(y, p) for every p, so with r the radius d(x, q) <= d(x, p) + 2 r;
        as distances are Euclidean, x also lies within r of the plane halfway between p and q. And for every pivot
        p, |d(x, p) - d(y, p)| <= r, so x lies within r of the ring of the cell's distances to p.
        """
        r = self.radius + slack(10 * size)
        own = distance[np.arange(len(home)), home][:, None]
        apart = self.by[size][1][home]
        out = (distance <= own + 2 * r) & (distance**2 - own**2 <= 2 * apart * r + 2 * slack(size))
        if size in self.rings:
            low, high = self.rings[size]  # by cell and pivot
            for q in range(out.shape[1]):
                at = np.flatnonzero(out[:, q])
                d = distance[at]
                out[at, q] = ((d >= low[q] - r) & (d <= high[q] + r)).all(1)
        return out


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row: links are pairs with cosine >= threshold.

    Equal vectors are one class that is compared once; members link with each other and with what the class
    links with. Classes go to the cell of their nearest pivot and, where the triangle inequality allows a
    partner, to other cells as guests; each pair of cells meets in one of them. Of a cell the least and largest
    distance to every pivot are known, so all pivots say whether a vector must go there. A cell is cut into blocks
    of BLOCK vectors, each a task's share of its own. Tasks stream the guests past their block; of two vectors the
    first numbers and the lengths of the rest tell whether they can be near, before the whole is multiplied.
    They return counts and a spanning set of the links, never all pairs of a group.

    Null, zero and non-finite vectors, and vectors with null components, have no links and are their own
    component; so have vectors of different lengths none with each other. A null id takes part; its row's
    component is the least id that is not null. Rows with the same id are distinct vectors whose component is
    one. Other columns, whatever their names, are not read; an empty table gives no rows. On data without clusters
    no metric bound can keep cells apart: each class is then sent to each block, though only few pairs are
    multiplied as a whole.
    """
    spark = vectors.sparkSession
    rows, _ = stage(usable(vectors, id_col, vector_col), "vectors")
    classes, _ = stage(rows.groupBy("size", "vector").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")).withColumn("class", F.monotonically_increasing_id()), "classes")
    number = classes.count()
    radius = float(np.sqrt(2 - 2 * threshold))
    order = F.struct(F.xxhash64("vector").alias("hash"), "vector")
    wanted = min(MOST_PIVOTS, max(1, -(-number // min(CELL, BLOCK))))
    # The first in the order of a hash, and one at least for each length of vectors.
    first = classes.select("size", "vector").orderBy(F.xxhash64("vector"), "vector").limit(wanted).collect()
    every = classes.groupBy("size").agg(F.min(order).alias("first")).select("size", "first.vector").collect()
    pivots = Pivots([*first, *(r for r in every if r["size"] not in {f["size"] for f in first})], radius)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each cell: members, and its least and largest distances to the pivots, by task."""
        held: dict = {}
        for batch in batches:
            size = batch.column(0).to_numpy()
            raw = batch.column(1).to_pylist()
            for s in np.unique(size).tolist():
                home, distance = pivots.home(s, unit([raw[i] for i in np.flatnonzero(size == s)]))
                for q in np.unique(home).tolist():
                    d = distance[home == q]
                    n, low, high = held.get((s, q), (0, np.inf, -np.inf))
                    held[s, q] = n + len(d), np.minimum(low, d.min(0)), np.maximum(high, d.max(0))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*((s, q, n, low, high) for (s, q), (n, low, high) in held.items()), strict=True), [pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.float64())] * 2], strict=True)], ["size", "home", "n", "low", "high"])

    rings = classes.select("size", "vector").mapInArrow(homes, "size int, home int, n bigint, low array<double>, high array<double>")
    spots = rings.select("size", "home", "n", F.posexplode(F.arrays_zip("low", "high")).alias("pivot", "d"))
    cells = spots.groupBy("size", "home", "pivot").agg(F.sum("n").alias("n"), F.min("d.low").alias("low"), F.max("d.high").alias("high")).collect()
    blocks: dict = {}
    for s, (x, _) in pivots.by.items():
        pivots.rings[s] = np.full((len(x), len(x)), np.inf), np.full((len(x), len(x)), -np.inf)  # a cell without members: none
    for c in cells:
        low, high = pivots.rings[c["size"]]
        low[c["home"], c["pivot"]], high[c["home"], c["pivot"]] = c["low"], c["high"]
        blocks[c["size"], c["home"]] = -(-c["n"] // min(BLOCK, max(1, BLOCK_BYTES // (8 * c["size"]))))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block in which a class is a host (role 0) or a guest (role 1)."""
        for batch in batches:
            size, number_, copies = (batch.column(i).to_numpy() for i in (0, 2, 3))
            raw = batch.column(1).to_pylist()
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                home, distance = pivots.home(int(s), unit([raw[i] for i in at]))
                reach = pivots.reach(int(s), home, distance)
                out: list[tuple] = []
                for k, i in enumerate(at.tolist()):
                    p = int(home[k])
                    own = (int(number_[i]) * 0x9E3779B97F4A7C15 >> 20) % blocks[int(s), p]
                    out.append((int(s), p, own, 0, number_[i], copies[i], raw[i]))
                    out += [(int(s), p, b, 1, number_[i], copies[i], raw[i]) for b in range(own)]  # later blocks visit earlier ones
                    for q in np.flatnonzero(reach[k]).tolist():
                        if q != p and ((p + q) % 2 == 0) == (q < p):  # of two cells one is the host of both
                            out += [(int(s), q, b, 1, number_[i], copies[i], raw[i]) for b in range(blocks.get((int(s), q), 0))]
                    if len(out) > 20_000:
                        yield rows_of(out)
                        out = []
                if out:
                    yield rows_of(out)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: Cell | None = None
        for batch in batches:
            size, home, block, role, number_, copies = (batch.column(i).to_numpy() for i in range(6))
            raw = batch.column(6).to_pylist()
            key = np.stack([size, home, block, role])
            cut = [0, *(1 + np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0))).tolist(), len(raw)]
            for a, b in zip(cut[:-1], cut[1:]):  # noqa: B905
                if a == b:
                    continue
                if cell is None or cell.key != tuple(key[:3, a]):
                    if cell is not None:
                        yield from cell.done()
                    cell = Cell(tuple(key[:3, a]), threshold)
                for c in range(a, b, STRIDE):
                    d = min(b, c + STRIDE)
                    part = (number_[c:d], copies[c:d], unit(raw[c:d]))
                    if role[a] == 0:
                        cell.hosts.append(part)
                    else:
                        yield from cell.guests(*part)
        if cell is not None:
            yield from cell.done()

    dealt = classes.select("size", "vector", "class", "copies").mapInArrow(spread, "size int, home int, block int, role int, class bigint, copies bigint, vector binary")
    dealt = dealt.repartition(partitions(spark), "size", "home", "block").sortWithinPartitions("size", "home", "block", "role", "class")
    found, _ = stage(dealt.mapInArrow(meet, "class bigint, n bigint, other bigint"), "links")
    degree = found.groupBy("class").agg(F.sum("n").alias("others"))
    named = classes.select("size", "vector", "class", "least", "copies")
    groups = components(found.where("other is not null").select(F.col("class").alias("a"), F.col("other").alias("b")))
    # A component's name is its least id, not its least class.
    tied = named.join(groups, named["class"] == groups["node"], "left").withColumn("component", F.coalesce("component", "class")).join(degree, "class", "left")
    least = tied.groupBy("component").agg(F.min("least").alias("component_id"))
    verdict = tied.join(least, "component").select("size", "vector", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = rows.join(verdict, ["size", "vector"]).select("id", "n_links", "component_id")
    v = vectors[vector_col]
    bad = v.isNull() | ~F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) | ~F.exists(v, lambda x: x != 0)
    alone = vectors.where(F.coalesce(bad, F.lit(True))).select(vectors[id_col].cast("long").alias("id"), F.lit(0).cast("long").alias("n_links"), vectors[id_col].cast("long").alias("component_id"))
    return linked.unionAll(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    types = [*[pa.int32()] * 4, pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["size", "home", "block", "role", "class", "copies", "vector"])


def links_of(number: list, n: list, other: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(n, pa.int64()), pa.array(other, pa.int64())], ["class", "n", "other"])


class Cell:
    """A block of a cell: its hosts are held, its guests pass."""

    def __init__(self, key: tuple, threshold: float) -> None:
        self.key, self.threshold, self.hosts, self.ready = key, threshold, [], False
        self.compared = 0  # pairs multiplied as a whole

    def begin(self) -> None:
        if not self.ready:
            self.number = np.concatenate([h[0] for h in self.hosts]) if self.hosts else np.zeros(0, np.int64)
            self.copies = np.concatenate([h[1] for h in self.hosts]) if self.hosts else np.zeros(0, np.int64)
            self.x = np.concatenate([h[2] for h in self.hosts]) if self.hosts else np.zeros((0, 1))
            self.n = np.zeros(len(self.number), np.int64)
            self.parent, self.ready, self.hosts = np.arange(len(self.number)), True, []
            self.head = headed(self.x)
            for a in range(0, len(self.x), STRIDE):
                self.meet(self.x[a : a + STRIDE], self.copies[a : a + STRIDE], a)

    def meet(self, x: np.ndarray, copies: np.ndarray, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(n, first): how many vectors among the hosts each of x links with, copies counted, and one of them (or -1).

        Counts of the hosts and their components follow. With `own`, x are the hosts from there on, and meet those
        before them. A tile of x and hosts at a time, and no pairs outlive their tile: in a dense one, links are counted
        by products, and once they tie all of a tile's rows and hosts together, nothing is left to look at.
        """
        n, first = np.zeros(len(x), np.int64), np.full(len(x), -1)
        if own is not None:
            first[:] = own + np.arange(len(x))
        head, least = headed(x), self.threshold - 2.0**-40  # far more than products are off by
        end = len(self.x) if own is None else own + len(x)
        for b in range(0, end, TILE):
            y = self.x[b : min(b + TILE, end)]
            near = head @ self.head[b : b + len(y)].T >= least
            some = int(np.count_nonzero(near))
            if own is not None and b + len(y) > own:  # only hosts before the row itself
                near &= np.arange(b, b + len(y)) < (own + np.arange(len(x)))[:, None]
            if 8 * some > near.size:  # many: all of them at once
                self.compared += near.size
                near &= x @ y.T >= self.threshold
                links = near.astype(np.float64)  # sums of whole numbers below 2**53: exact
                sums = (links @ self.copies[b : b + len(y)]).astype(np.int64)
                self.n[b : b + len(y)] += (copies @ links).astype(np.int64)
                i = np.flatnonzero(near.any(1))
                one = b + near[i].argmax(1)
            else:
                i, j = np.nonzero(near)
                self.compared += len(i)
                keep = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65536]], y[j[k : k + 65536]]) for k in range(0, len(i), 65536)]) >= self.threshold if len(i) else np.zeros(0, bool)
                pair_i, pair_j = i[keep], b + j[keep]
                near = None
                sums = np.bincount(pair_i, self.copies[pair_j], len(x)).astype(np.int64)
                self.n[b : b + len(y)] += np.bincount(pair_j - b, copies[pair_i], len(y)).astype(np.int64)
                i, at = np.unique(pair_i, return_index=True)
                one = pair_j[at]
            n += sums
            if own is not None:
                self.n[own : own + len(x)] += sums
            if not len(i):
                continue
            new = first[i] < 0
            first[i[new]] = one[new]
            self.join(first[i], one)
            roots = self.roots(np.concatenate([np.arange(b, b + len(y)), first[i]]))
            host, mine = roots[: len(y)], roots[len(y) :]
            if (roots == roots[0]).all():
                continue
            if near is not None:
                row, label = self.labels(near[i], host)
            else:
                row, label = np.searchsorted(i, pair_i), host[pair_j - b]
            other = np.flatnonzero(mine[row] != label)
            pairs = np.unique(np.stack([mine[row[other]], label[other]]), axis=1)
            self.join(*pairs)
        return n, first

    @staticmethod
    def labels(links: np.ndarray, host: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, label) of each label among the hosts that a row links with: a few labels by columns, else by pairs."""
        known, at = np.unique(host, return_inverse=True)
        if len(known) > 64:
            row, j = np.nonzero(links)
            return row, host[j]
        found = np.stack([links[:, at == k].any(1) for k in range(len(known))], axis=1)
        row, k = np.nonzero(found)
        return row, known[k]

    def roots(self, i: np.ndarray) -> np.ndarray:
        r = self.parent[i]
        while (r != (up := self.parent[r])).any():
            r = up
        self.parent[i] = r
        return r

    def root(self, i: int) -> int:
        while (up := self.parent[i]) != i:
            self.parent[i] = self.parent[up]
            i = int(self.parent[i])
        return i

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        i, j = self.roots(i), self.roots(j)
        differ = np.flatnonzero(i != j)
        for a, b in zip(i[differ].tolist(), j[differ].tolist(), strict=True):
            a, b = self.root(a), self.root(b)
            if a != b:
                self.parent[max(a, b)] = min(a, b)

    def guests(self, number: np.ndarray, copies: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.begin()
        if not len(self.number):
            return
        for a in range(0, len(x), STRIDE):
            n, first = self.meet(x[a : a + STRIDE], copies[a : a + STRIDE])
            i = np.flatnonzero(first >= 0)
            if len(i):
                yield links_of(number[a + i].tolist(), n[i].tolist(), self.number[first[i]].tolist())

    def done(self) -> Iterator[pa.RecordBatch]:
        self.begin()
        at = np.flatnonzero(self.n)
        if len(at):
            root = [self.root(i) for i in at.tolist()]
            yield links_of(self.number[at].tolist(), self.n[at].tolist(), [int(self.number[r]) if r != i else None for i, r in zip(at.tolist(), root, strict=True)])
