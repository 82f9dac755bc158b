"""Best-fit packing: a linear program over configurations of lengths says which pieces share a sequence."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm import bpe
from spanforge.llm.shared import stage, steps

#: What one step of the weights covers of a length's count, how fast a covered length loses weight, how far from the
#: best a configuration may be, and how many configurations one pricing may give.
STEP, DECAY, SLACK, MOST_CONFIGS = 1 / 8, 1.0, 0.02, 512
#: Pricings at most, and the part of all tokens that may stay uncovered: what is, the rounding places.
MOST_PRICINGS, UNCOVERED = 300, 0.02
#: Parts of the covered tokens, in the order of the pricings, that the rounding tries to keep; it takes the best.
PARTS = (1.0, 0.95, 0.9, 0.8, 0.65, 0.5, 0.3)
#: Rows of one length that one group ranks.
RANK_ROWS = 1 << 13

Config = tuple[tuple[int, int], ...]  # (length, how often), lengths descending


def knapsack(price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best, choice): the most that lengths at these prices are worth within each capacity, and the length that is
    added last there (0: none). price has an entry for each length up to the capacity, below 0 for those not for sale."""
    size = len(price)
    best, choice = np.zeros(size), np.zeros(size, np.int64)
    for room in range(1, size):
        worth = best[:room][::-1] + price[1 : room + 1]
        at = int(worth.argmax())
        best[room], choice[room] = (worth[at], at + 1) if worth[at] > best[room - 1] else (best[room - 1], 0)
    return best, choice


def chosen(choice: np.ndarray, room: int) -> Counter:
    out: Counter = Counter()
    while room > 0:
        if length := int(choice[room]):
            out[length] += 1
            room -= length
        else:
            room -= 1
    return out


def solve(counts: dict[int, int], capacity: int, pricings: int = MOST_PRICINGS) -> tuple[dict[Config, float], float]:
    """(amounts, bound): how many sequences of each configuration cover all counts, and a lower bound on sequences.

    Multiplicative weights for the covering program: a length's price begins at its size, falls exponentially with the
    part of its count that is covered, and a covered one is not for sale any more. A knapsack gives the most valuable configuration;
    others that begin with another length and are worth nearly as much are taken too, as long as the falling prices
    leave them within the slack. Any prices bound the optimum from below: all pieces at these prices, divided by the
    most that a sequence can be worth.
    """
    n = np.zeros(capacity + 1)
    for length, count in counts.items():
        n[length] = count
    there = n > 0
    covered = np.zeros(capacity + 1)
    amounts: Counter = Counter()
    volume = float((n * np.arange(capacity + 1)).sum())
    bound = volume / capacity
    safe = np.where(there, n, 1)
    for _ in range(pricings):
        open_ = there & (covered < 1)
        if (n * np.arange(capacity + 1))[open_].sum() <= UNCOVERED * volume:
            break
        price = np.where(open_, np.arange(capacity + 1) / capacity * np.exp(-DECAY * covered), -1.0)
        best, choice = knapsack(price)
        bound = max(bound, float((n * np.maximum(price, 0)).sum() / best[-1]))
        first = price + best[::-1]  # the value with this length taken first
        first[~open_] = -1
        candidates = np.argsort(-first, kind="stable")[:MOST_CONFIGS]
        for length in candidates[first[candidates] >= (1 - SLACK) * best[-1]].tolist():
            config = chosen(choice, capacity - length)
            config[length] += 1
            at, often = np.array(list(config), np.int64), np.array(list(config.values()), np.float64)
            amount = STEP / (often / n[at]).max()
            while (covered[at] < 1).all() and (at / capacity * np.exp(-DECAY * covered[at]) * often).sum() >= (1 - SLACK) * best[-1]:
                amounts[tuple(sorted(config.items(), reverse=True))] += amount
                covered[at] += amount * often / n[at]
    return dict(amounts), bound


def filled(config: Config) -> int:
    return sum(length * often for length, often in config)


def rounded(counts: dict[int, int], amounts: dict[Config, float], capacity: int) -> list[tuple[Config, int]]:
    """(configuration, sequences) that hold all counts exactly.

    Amounts are rounded down, then up once where the pieces are still there, the fullest first. What is left goes, the
    longest first, where it fits best, into these sequences or new ones. The last configurations that the program
    found have few lengths to choose from, so it is tried how many of the first ones to keep.
    """
    total = sum(amount * filled(config) for config, amount in amounts.items())
    best = None
    for part in PARTS:
        kept, so_far = {}, 0.0
        for config, amount in amounts.items():
            so_far += amount * filled(config)
            if so_far > part * total * (1 + 1e-9):
                break
            kept[config] = amount
        made = completed(*whole(counts, kept), capacity)
        if best is None or sum(k for _, k in made) < sum(k for _, k in best):
            best = made
    return best


def whole(counts: dict[int, int], amounts: dict[Config, float]) -> tuple[Counter, Counter]:
    """(sequences by configuration, counts left over) of amounts rounded to whole numbers."""
    left, groups = Counter(counts), Counter()

    def take(config: Config, most: int) -> None:
        k = min([most, *(left[length] // often for length, often in config)])
        if k > 0:
            groups[config] += k
            for length, often in config:
                left[length] -= often * k

    for config in sorted(amounts, key=lambda c: (-filled(c), c)):
        take(config, int(amounts[config]))
    for config in sorted(amounts, key=lambda c: (-filled(c), int(amounts[c]) - amounts[c], c)):
        take(config, 1)
    return groups, left


def completed(groups: Counter, left: Counter, capacity: int) -> list[tuple[Config, int]]:
    """Sequences that also hold what is left, by best fit, the longest first; equal sequences are one entry."""
    rooms: list[dict[Config, int]] = [{} for _ in range(capacity + 1)]
    some = 0  # a bit for each room that some sequence has
    for config, k in groups.items():
        room = capacity - filled(config)
        rooms[room][config] = k
        some |= 1 << room
    for length in sorted(left, reverse=True):
        todo = left[length]
        while todo:
            fits = some >> length
            if fits:
                room = length + (fits & -fits).bit_length() - 1
                config, k = rooms[room].popitem()
                often = min(room // length, todo)
                used = min(k, todo // often)
                if k > used:
                    rooms[room][config] = k - used
                elif not rooms[room]:
                    some &= ~(1 << room)
            else:  # new sequences, each with as many of this length as fit
                room, config = capacity, ()
                often = min(room // length, todo)
                used = todo // often
            more = Counter(dict(config))
            more[length] += often
            new = tuple(sorted(more.items(), reverse=True))
            rest = room - often * length
            rooms[rest][new] = rooms[rest].get(new, 0) + used
            some |= 1 << rest
            todo -= often * used
    return sorted((config, k) for of in rooms for config, k in of.items())


class Places:
    """Where the piece of a given length and rank goes."""

    def __init__(self, groups: list[tuple[Config, int]]) -> None:
        rank: Counter = Counter()
        rows, sequence = [], 0
        for config, k in groups:
            offset = 0
            for length, often in config:
                rows.append((length, rank[length], often, sequence, offset))
                rank[length] += often * k
                offset += length * often
            sequence += k
        rows.sort()
        self.sequences = sequence
        self.length, self.rank, self.often, self.sequence, self.offset = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 5
        self.first = np.searchsorted(self.length, np.arange(self.length[-1] + 2)) if rows else np.zeros(2, np.int64)

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset); ranks count from 0."""
        at = np.empty(len(length), np.int64)
        for value in np.unique(length).tolist():
            mine = length == value
            lo, hi = self.first[value], self.first[value + 1]
            at[mine] = lo + np.searchsorted(self.rank[lo:hi], rank[mine], "right") - 1
        k = rank - self.rank[at]
        return self.sequence[at] + k // self.often[at], self.offset[at] + k % self.often[at] * length


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, length: int, keep_ids: bool, id_col: str, text_col: str) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of all documents, with their ids if asked for.

    A document longer than a sequence is cut into pieces of a sequence each, before which the rest of it stands.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, width = bpe.encoder(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        names = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
        for batch in steps(batches, 1):
            row, rows = [], []
            for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                ids = np.frombuffer(encode(text), width).astype("<u4").tobytes() + end if text else end
                size = len(ids) // 4
                start, stop = 0, size % length or length
                piece = 0
                while start < size:
                    part = ids[4 * start : 4 * stop]
                    row.append(i)
                    rows.append((piece, start, stop - start, zlib.crc32(part), *([part] if keep_ids else [])))
                    piece, start, stop = piece + 1, stop, stop + length
            types = [pa.int32(), *[pa.int64()] * 3, *([pa.binary()] if keep_ids else [])]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *columns], names)

    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if keep_ids else "")
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(work, schema)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, length: int = 2048, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): all documents in few sequences of at most `length`.

    A document's ids are its text's and end_id; only longer documents are cut, the first piece being the shorter one.
    The pieces are written once; their counts by length, `length` rows at most, go to the driver. There the linear
    program over configurations (multisets of lengths that fit a sequence) is solved by multiplicative weights, with
    a knapsack for the pricing, and rounded: work and result depend on `length`, not on the number of documents. Each
    piece then gets a rank among those of its length, by groups of a bounded size, and the rank says its place.

    Null and empty texts are the end id alone. Null or repeated ids: each row is packed by itself. Equal pieces are
    ranked in the order of the written table, so a rerun that reads it again agrees. Very long texts are encoded in
    parts. Other columns are not read. An empty table gives no pieces.
    """
    found, _ = stage(pieces(docs, tokenizer_path, end_id, length, keep_ids, id_col, text_col).withColumn("at", F.monotonically_increasing_id()), "pieces")
    counts = {size: n for size, n in found.groupBy("length").agg(F.count(F.lit(1))).collect()}
    amounts, _ = solve({size: n for size, n in counts.items() if size < length}, length)
    groups = rounded(counts, amounts, length)
    places = Places(groups)

    hottest = max(counts.values(), default=0)
    rows = found.withColumn("part", F.pmod(F.xxhash64("at"), F.lit(1 + hottest // RANK_ROWS)))
    before = rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "part").orderBy("at")
    ranked = rows.withColumn("place", F.row_number().over(order)).join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("place") - 1)
    kept = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.of(*(batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank")))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    out = ranked.select(*kept, "rank")
    schema = out.select(*kept, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return out.mapInArrow(place, schema).select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if keep_ids else []))
