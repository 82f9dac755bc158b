"""Removal of every byte that lies in a string of `least` bytes which also starts elsewhere."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from spanforge.llm.shared import STEP_BYTES, drop, packed, partitions, stage, steps
from spanforge.llm.suffixes import deep_shallow
from spanforge.llm.words import U64, digested, flat, mixed, prefix_hash, scale

#: Bytes of an anchor; entries that a task packs at a time, and that one part of the index should hold; runs sorted together.
GRAM, PACK, PART, SORT = 32, 1 << 18, 1 << 19, 20_000

#: Runs of one anchor beyond which they are dealt on by more of their bytes, and the offsets of a part of them then.
HOT, OFFSETS = 1000, 8

#: A run of windows with one anchor: `size` bytes from `start` on, the anchor `off` bytes behind it.
ENTRY = np.dtype([("key", "<u8"), ("run", "<u8"), ("doc", "<i8"), ("text", "<i8"), ("start", "<u4"), ("size", "<u2"), ("off", "<u2"), ("twice", "<u4")])


@dataclass
class Runs:
    doc: np.ndarray
    start: np.ndarray
    size: np.ndarray
    off: np.ndarray
    key: np.ndarray
    run: np.ndarray


def runs(raw: np.ndarray, at: np.ndarray, least: int) -> Runs:
    """The windows of `least` bytes of all texts, gathered to runs of one anchor each.

    A window's anchor is its gram of the lowest hash, the first of equal ones; it depends on the window's bytes
    alone, so equal windows have equal anchors at the same place in them, and lie in runs of the same key.
    """
    n, span = len(raw), least - GRAM + 1
    if n < least:
        z = np.zeros(0, np.int64)
        return Runs(z, z, z, z, z.astype(U64), z.astype(U64))
    prefix = prefix_hash(raw)
    gram = prefix[GRAM:] - prefix[:-GRAM]
    scale(gram, inverse=True)
    low = ((gram * U64(0xD6E8FEB86659FD93)) & U64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=U64)
    wide = 1
    while wide * 2 <= span:
        low = np.minimum(low[: len(low) - wide], low[wide:])
        wide *= 2
    if wide < span:
        low = np.minimum(low[: len(low) - (span - wide)], low[span - wide :])
    anchor = (low & U64(0xFFFFFFFF)).astype(np.int64)  # of the window at each position
    inside = np.zeros(len(anchor), bool)
    long = np.flatnonzero(np.diff(at) >= least)
    mark = np.zeros(len(anchor) + 1, np.int8)
    mark[at[long]] += 1
    mark[at[long + 1] - least + 1] -= 1
    inside = np.cumsum(mark[:-1], dtype=np.int8) > 0
    new = inside.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new)
    end = inside.copy()
    end[:-1] &= new[1:] | ~inside[1:]
    last = np.flatnonzero(end)
    doc = np.searchsorted(at, first, "right") - 1
    stop = last + least
    a = anchor[first]
    return Runs(doc, first - at[doc], stop - first, a - first, mixed(gram[a]), digested(raw, first, stop, np.zeros(len(first), U64), 0))


def sections(raw: np.ndarray, at: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first, raw, at): texts as they are, but a very long one in sections, which share the bytes that windows
    across their edges need, so that each window lies in one section and memory doesn't go with the text."""
    if len(at) > 2 or len(raw) <= 2 * STEP_BYTES:
        yield 0, raw, at
        return
    for first in range(0, len(raw) - least + 1, STEP_BYTES):
        cut = raw[first : first + STEP_BYTES + least - 1]
        yield first, cut, np.array([0, len(cut)])


ENTRIES = "part bigint, doc bigint, text bigint, a int, b int, entries binary"


def entries(texts: DataFrame, least: int, parts: int) -> DataFrame:
    """Runs packed by part of the key space; and, with part null, spans [a, b) that are already known to repeat.

    Of equal runs in one pack only the first is sent on, marked as found twice, and all are spans: that bounds
    what a passage that any number of documents share sends to its part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            e = np.concatenate(held)
            e = e[np.lexsort((e["run"], e["key"]))]
            new = np.concatenate([[True], (e["key"][1:] != e["key"][:-1]) | (e["run"][1:] != e["run"][:-1])])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(e)))
            many = np.repeat(times > 1, times)
            known = e[many]
            e["twice"] = many
            e = e[first]
            if len(known):
                yield batch_of([pa.nulls(len(known), pa.int64()), known["doc"], known["text"], known["start"].astype(np.int32), (known["start"] + known["size"]).astype(np.int32), pa.nulls(len(known), pa.binary())], ENTRIES)
            part = (e["key"] >> U64(13)) % U64(parts)
            by = np.argsort(part, kind="stable")
            e, part = e[by], part[by]
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            k = len(cut) - 1
            blobs = [e[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield batch_of([part[cut[:-1]].astype(np.int64), *[pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())], blobs], ENTRIES)

        for batch in steps(batches, 2):
            raw, at = flat(batch.column(2))
            for first, cut, cut_at in sections(raw, at, least):
                r = runs(cut, cut_at, least)
                e = np.zeros(len(r.doc), ENTRY)
                for name, x in (("key", r.key), ("run", r.run), ("doc", batch.column(0).to_numpy()[r.doc]), ("text", batch.column(1).to_numpy()[r.doc]), ("start", r.start + first), ("size", r.size), ("off", r.off)):
                    e[name] = x
                held.append(e)
                n += len(e)
                if n >= PACK:
                    yield from sent()
                    held, n = [], 0
        if n:
            yield from sent()

    return texts.mapInArrow(run, ENTRIES)


KINDS = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def batch_of(columns: list, schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, KINDS[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


FLAGGED = "doc bigint, text bigint, a int, b int, off int, key bigint, compare boolean, whole boolean"


def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the runs whose key another run has: whole ones repeat as they are; of each, one is to be compared if
    the key has several."""
    part, held = None, []

    def one() -> Iterator[pa.RecordBatch]:
        e = np.concatenate(held)
        e = e[np.lexsort((e["start"], e["text"], e["doc"], e["run"], e["key"]))]
        key = np.concatenate([[True], e["key"][1:] != e["key"][:-1]])
        run = key | np.concatenate([[True], e["run"][1:] != e["run"][:-1]])
        first = np.flatnonzero(run)
        times = np.diff(np.append(first, len(e)))
        twice = np.maximum.reduceat(e["twice"], first) > 0
        whole = np.repeat((times > 1) | twice, times)
        keys = np.cumsum(key) - 1
        different = np.bincount(keys[first])[keys] > 1
        compare = different & run
        keep = whole | compare
        e = e[keep]
        if len(e):
            yield batch_of([e["doc"], e["text"], e["start"].astype(np.int32), (e["start"] + e["size"]).astype(np.int32), e["off"].astype(np.int32), e["key"].astype(np.int64), compare[keep], whole[keep]], FLAGGED)

    for batch in batches:
        for p, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if p != part and held:
                yield from one()
                held = []
            part = p
            held.append(np.frombuffer(blob, ENTRY))
    if held:
        yield from one()


CUTS = "key bigint, low int, doc bigint, text bigint, a int, off int, whole boolean, bytes binary"


def cuts(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs that are to be compared, under the key of those that they are to be compared with.

    Windows with the anchor at offsets low to high share low bytes before it and least - GRAM - high bytes behind
    it. So the runs of an anchor that has many are dealt on by these bytes, once for each OFFSETS offsets that they
    have, and only runs that share all but a few bytes of a window still meet. Other anchors' runs meet as they are,
    with low = -1, for all offsets.
    """
    for batch in steps(batches, 2):
        doc, text = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out: list[tuple] = []
        for i, (raw, spots) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            for x in spots:
                a, b, off = x["a"], x["b"], x["off"]
                row = (doc[i], text[i], a, off, x["whole"], raw[a:b])
                if not x["hot"]:
                    out.append((x["key"], -1, *row))
                    continue
                for low in range((off - (b - a - least)) // OFFSETS * OFFSETS, off + 1, OFFSETS):
                    high, at = min(low + OFFSETS - 1, least - GRAM), a + off
                    around = b"%d %d " % (x["key"], low) + raw[max(a, at - low) : at + least - high]
                    out.append((int.from_bytes(hashlib.blake2b(around, digest_size=8).digest(), "little", signed=True), low, *row))
            if len(out) > 10_000:
                yield batch_of([list(c) for c in zip(*out, strict=True)], CUTS)
                out = []
        if out:
            yield batch_of([list(c) for c in zip(*out, strict=True)], CUTS)


SPANS = "doc bigint, text bigint, a int, b int"


def classes(order: np.ndarray, common: np.ndarray, wanted: int) -> np.ndarray:
    """Number of the class of each string by its first `wanted` bytes, from its place in suffix order."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < wanted)
    return out


def compared(key: list, off: np.ndarray, runs_: list[bytes], least: int, part: np.ndarray | None = None) -> Iterator[tuple[int, int, int]]:
    """(run, first, end) of the windows that repeat in another run of the same key; key is sorted. Of runs with
    a part (not -1) only the OFFSETS offsets from it on are looked at.

    Runs of a key are sorted by what follows the anchor's begin and, read backwards, by what precedes it. Two
    windows that begin o bytes before the anchor are equal if the runs lie together in both orders: to a depth
    of least - o in the one and of o in the other, which the common prefixes of neighbours tell.
    """
    n = len(runs_)
    right = [b[o:] for b, o in zip(runs_, off.tolist(), strict=True)]
    left = [b[:o][::-1] for b, o in zip(runs_, off.tolist(), strict=True)]
    sorted_ = []
    for texts, known in ((right, 0), (left, 0)):
        order: list[int] = []
        common: list[int] = []
        at = 0
        while at < n:
            end = at + 1
            while end < n and key[end] == key[at]:
                end += 1
            got, lcp = deep_shallow(texts, list(range(at, end)), known)
            order += got
            common += [-1, *lcp[1:]]
            at = end
        sorted_.append((np.array(order), np.array(common)))
    size = np.array([len(b) for b in runs_])
    low, high = off - (size - least), off  # the offsets of a run's windows
    if part is not None:
        low, high = np.where(part < 0, low, np.maximum(low, part)), np.where(part < 0, high, np.minimum(high, part + OFFSETS - 1))
    again = np.zeros((n, least - GRAM + 2), bool)
    for o in range(least - GRAM + 1):
        here = np.flatnonzero((low <= o) & (o <= high))
        if len(here) < 2:
            continue
        c = classes(*sorted_[0], least - o)[here] * (n + 1) + classes(*sorted_[1], o)[here]
        by = np.argsort(c, kind="stable")
        same = c[by[1:]] == c[by[:-1]]
        hit = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        again[here[by[hit]], o] = True
    edge = np.diff(again.astype(np.int8), axis=1, prepend=0)
    i, first = np.nonzero(edge == 1)
    j, end = np.nonzero(edge == -1)
    for r, a, b in zip(i.tolist(), first.tolist(), end.tolist(), strict=True):
        # offsets a..b-1: the window of offset b - 1 begins first, that of a ends last
        yield r, int(off[r]) - (b - 1), int(off[r]) - a + least


def spans_of(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Spans from the runs, which come sorted by key; keys are handled some thousand runs at a time."""
    held: list[tuple] = []

    def one(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        key, low, doc, text, start, off, whole, raw = (list(c) for c in zip(*rows, strict=True))
        found = compared(list(zip(key, low, strict=True)), np.array(off), raw, least, np.array(low))
        out = [(doc[r], text[r], start[r] + a, start[r] + b) for r, a, b in found if not whole[r]]
        if out:
            yield batch_of([list(c) for c in zip(*out, strict=True)], SPANS)

    for batch in steps(batches, 7):
        held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
        if len(held) >= SORT:
            cut = len(held) - 1
            while cut and held[cut - 1][:2] == held[-1][:2]:
                cut -= 1
            if cut:
                yield from one(held[:cut])
                held = held[cut:]
    if held:
        yield from one(held)


def with_keys(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """Two numbers that name a row: its id (null: 0; no whole number: a hash) and a hash of its text. Rows that
    share both are alike."""
    whole = isinstance(docs.schema[id_col].dataType, IntegralType)
    number = docs[id_col].cast("long") if whole else F.when(docs[id_col].isNotNull(), F.xxhash64(docs[id_col]))
    return F.coalesce(number, F.lit(0)), F.xxhash64(docs[id_col].cast("string"), docs[text_col].cast("string"))


def repeated_spans(docs: DataFrame, least: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, text, spans): the sorted spans, which may overlap, of each row that has any; see with_keys."""
    spark = docs.sparkSession
    doc, text = with_keys(docs, id_col, text_col)
    texts = docs.select(doc.alias("doc"), text.alias("text"), docs[text_col].cast("binary").alias("raw"))
    total = docs.agg(F.sum(F.octet_length(docs[text_col]))).first()[0] or 0
    parts = max(partitions(spark), -(-2 * total // ((least - GRAM + 2) * PART)))
    sorted_, packed_path = stage(entries(texts, least, parts), "runs", compression="snappy")
    flagged, flagged_path = stage(sorted_.where("part is not null").select("part", "entries").repartition(partitions(spark), "part").sortWithinPartitions("part").mapInArrow(judged, FLAGGED), "flagged")
    known, known_path = stage(sorted_.where("part is null").select("doc", "text", "a", "b"), "known")
    drop(spark, packed_path)
    several = flagged.where("compare")
    hot = several.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("key", F.lit(True).alias("hot"))
    wanted = several.join(hot, "key", "left").groupBy("doc", "text").agg(F.collect_list(F.struct("a", "b", "off", "key", "whole", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("spots"))
    cut = texts.join(wanted, ["doc", "text"]).select("doc", "text", "raw", "spots").mapInArrow(lambda batches: cuts(batches, least), CUTS)
    dealt = cut.repartition(partitions(spark), "key", "low").sortWithinPartitions("key", "low")
    found, found_path = stage(dealt.mapInArrow(lambda batches: spans_of(batches, least), SPANS), "spans")
    spans = known.unionAll(flagged.where("whole").select("doc", "text", "a", "b")).unionAll(found)
    out, _ = stage(spans.distinct().groupBy("doc", "text").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans")), "spans")
    drop(spark, flagged_path, known_path, found_path)
    return out


def rest_of(raw: bytes, spans: list | None) -> tuple[bytes, int]:
    """What is left of a text, and the number of its maximal removed runs."""
    if not spans:
        return raw, 0
    parts, at, n = [], 0, 0
    end = -1
    for s in spans:
        if s["a"] > end:  # touching spans are one
            n += 1
            parts.append(raw[at : s["a"]])
        end = max(end, s["b"])
        at = max(at, s["b"])
    return b"".join([*parts, raw[at:]]), n


def removal(docs: DataFrame, least: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document, judged on the input as it is.

    The windows of `least` bytes are gathered to runs of one anchor; runs without a partner of the same anchor
    go at once, runs that are equal as a whole are settled by 64 bits of BLAKE2b of their bytes and the hash of their anchors,
    and the rest are suffix-sorted within their anchor by deep-shallow sorting, which decides each of their windows
    by its bytes. Anchors deal the work out, and hot ones are dealt on by the bytes around them; no text is
    compared with all others.

    Null and shorter texts lose nothing. Matches never cross rows. A row that occurs twice is removed in both
    places, as each is elsewhere for the other; ids may be null or repeat. Removal may cut a character: what is
    left is bytes. A very long text is a step of its own and worked through in sections. Other columns,
    whatever their names, are not read; an empty table gives no rows.
    """
    doc, text = with_keys(docs, id_col, text_col)
    spans = repeated_spans(docs, least, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 1):
            out = []
            for raw, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = raw or b""
                kept, n = rest_of(raw, s)
                out.append((len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest()))
            columns = [list(c) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3])], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("binary").alias("raw"), doc.alias("doc"), text.alias("text")).join(spans, ["doc", "text"], "left").select("id", "raw", "spans")
    return rows.mapInArrow(run, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string").withColumnRenamed("id", id_col)


def cut_docs(docs: DataFrame, least: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with the repeats cut out of their texts; halves of cut characters go too.

    n_chars, if docs has it, follows the text. Null texts stay null.
    """
    doc, text = with_keys(docs, id_col, text_col)
    spans = repeated_spans(docs, least, id_col, text_col)
    rows = packed(docs, doc=doc, text=text).join(spans, ["doc", "text"], "left")
    rows = rows.select(*[F.col("row").getField(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], "spans")
    names = docs.columns
    at = names.index(text_col)
    count = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, at):
            texts = [None if t is None else rest_of(t.encode(), s)[0].decode(errors="ignore") if s else t for t, s in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True)]
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, columns[at].type)
            if count is not None:
                columns[count] = pa.array([None if t is None else len(t) for t in texts], columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, docs.schema)
