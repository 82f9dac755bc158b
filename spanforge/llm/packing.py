"""Lexical retrieval packing: BM25 neighbours of a seed fill its window."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from spanforge.llm import bpe
from spanforge.llm.shared import steps
from spanforge.llm.tokens import cut_at_spaces, forget, kept_ids, lowered, tokenizer

K1, B = 1.2, 0.75
#: Tokens of an index shard: it bounds a shard's memory and the cost of a query.
SHARD_TOKENS = 1 << 20
#: Terms that more than this part of a shard's documents have are kept as dense rows of weights: there are at most
#: 4 times as many of them as a document has terms on average, and adding rows is faster than adding up postings.
DENSE_PART = 0.25


class Index:
    """A BM25 inverted index over the token ids of one shard's documents."""

    def __init__(self, docs: list[np.ndarray]) -> None:
        terms, counts = [], []
        for ids in docs:
            ids = np.sort(ids, kind="stable")  # a radix sort for 16-bit ids
            new = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            terms.append(ids[new])
            counts.append(np.diff(np.append(new, len(ids))))
        n = len(docs)
        term, tf = np.concatenate(terms), np.concatenate(counts).astype(np.float32)
        sizes = [len(t) for t in terms]
        doc = np.repeat(np.arange(n, dtype=np.int32), sizes)
        self.df = np.bincount(term)
        length = np.array([len(d) for d in docs], np.float32)
        idf = np.log1p((n - self.df + 0.5) / (self.df + 0.5)).astype(np.float32)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (length / length.mean())[doc]))
        frequent = self.df > max(2, n * DENSE_PART)
        self.row = np.cumsum(frequent) - 1
        self.row[~frequent] = -1
        dense = self.row[term] >= 0
        self.rows = np.zeros((int(frequent.sum()), n), np.float32)
        self.rows[self.row[term[dense]], doc[dense]] = weight[dense]
        self.few = np.where(frequent, 0, self.df)
        term, doc, weight = term[~dense], doc[~dense], weight[~dense]
        by = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[by], weight[by]
        self.first = np.concatenate([[0], np.cumsum(self.few)])
        self.docs, self.n = docs, n

    def scores(self, seed: int, left: np.ndarray | None = None) -> np.ndarray:
        """BM25 of every document for the seed's distinct terms, or those of what is left of it; none is left out."""
        q = np.unique(self.docs[seed] if left is None else left)
        start, size = self.first[q], self.few[q]
        total = int(size.sum())
        at = np.arange(total) + np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        out = np.bincount(self.doc[at], self.weight[at], self.n)
        rows = self.row[q]
        return out + self.rows[rows[rows >= 0]].sum(0)


class Packer:
    """Packs documents into sequences, a shard at a time; what doesn't fill a window waits for the next shard."""

    def __init__(self, length: int) -> None:
        self.length, self.waiting, self.tokens = length, [], 0

    def add(self, doc: tuple, ids: np.ndarray, start: int) -> Iterator[list[tuple]]:
        self.waiting.append([doc, ids, start])
        self.tokens += len(ids)
        if self.tokens >= SHARD_TOKENS:
            yield from self.pack()

    def pack(self) -> Iterator[list[tuple]]:
        """Full windows, as lists of (doc, ids, start)."""
        docs, length = self.waiting, self.length
        if not docs or self.tokens < length:
            return
        index = Index([ids for _, ids, _ in docs])
        free = np.ones(len(docs), bool)
        left = self.tokens
        seed = 0
        while left >= length:
            while not free[seed]:
                seed += 1
            window, room = [], length
            score = index.scores(seed, docs[seed][1])
            score[seed] = np.inf  # the seed comes first, then neighbours by score, then by place
            score[~free] = -np.inf
            some = 32
            while room:
                some = min(some, len(docs))
                best = np.argpartition(-score, some - 1)[:some] if some < len(docs) else np.arange(len(docs))
                best = best[np.lexsort((best, -score[best]))]
                for d in best.tolist():
                    if not free[d]:
                        continue
                    doc, ids, start = docs[d]
                    take = min(room, len(ids))
                    window.append((doc, ids[:take], start))
                    room -= take
                    if take == len(ids):
                        free[d] = False
                    else:
                        docs[d] = [doc, ids[take:], start + take]
                    if not room:
                        break
                some *= 4
            left -= length
            yield window
        self.waiting = [x for x, f in zip(docs, free.tolist(), strict=True) if f]
        self.tokens = left

    def rest(self) -> Iterator[list[tuple]]:
        """What is left, less than a window, in sequences of decreasing powers of two, which need no padding."""
        yield from self.pack()
        todo, left = self.waiting[::-1], self.tokens
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            window = []
            while room:
                doc, ids, start = todo.pop()
                take = min(room, len(ids))
                window.append((doc, ids[:take], start))
                room -= take
                if take < len(ids):
                    todo.append((doc, ids[take:], start + take))
            yield window
        self.waiting, self.tokens = [], 0


PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def signature(ids: np.ndarray) -> int:
    """The least hash of the document's runs of three ids: near copies mostly have the same."""
    x = ids.astype(np.uint64)
    if len(x) > 2:
        x = x[:-2] * np.uint64(0x9E3779B97F4A7C15) + x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + x[2:] * np.uint64(0x165667B19E3779F9)
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(32)
    return int((x * np.uint64(0xC4CEB9FE1A85EC53)).min() >> np.uint64(1))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, length: int = 4096, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents in sequences of at most `length` tokens; with their ids if asked for.

    A document's ids are its text's and end_id; null text counts as empty. Windows that one document fills are
    sequences of their own. The rest of each document goes by the signature of its ids to a partition, which
    Spark splits or merges by size, so no signature, however common, makes a large task. Partitions are cut into
    index shards; there the first unused document is a seed, BM25 over all its token ids ranks the unused others,
    and they fill the window in that order, the last one cut. Its rest stays in the index with the terms of what
    it was; as a seed it asks for its own terms only. What is left of a partition is cut at powers of two. Every
    id lies in exactly one piece; sequence ids hold the partition's number and count on within it.

    Null or repeated ids: each row is packed by itself. Null and empty texts are the end id alone. Very long
    texts fill windows alone but for their rest. Equal scores go to the place in the shard. Other columns are not
    read. An empty table gives no pieces. Memory is one shard.
    """
    width = "<u2" if tokenizer(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"
    kind = docs.schema[id_col].dataType.simpleString()
    bytes_each = np.dtype(width).itemsize
    end = end_id.to_bytes(bytes_each, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if cut_at_spaces(tokenizer_path):
            get = kept_ids(tokenizer_path, width).__getitem__
            of = lambda text: b"".join(map(get, lowered(text).split()))
        else:
            of = bpe.encoder(tokenizer_path)[0]
        for batch in steps(batches, 1):
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids = np.frombuffer(of(text or b"") + end, width)
                whole = len(ids) // length * length
                for at in range(0, whole, length):
                    piece = ids[at : at + length]
                    out.append((doc, at, length, crc32(piece), len(ids), at // length * 0x9E3779B97F4A7C1 + len(ids) & (1 << 62) - 1, piece.tobytes() if keep_ids else None))
                if whole < len(ids):
                    rest = ids[whole:]
                    out.append((doc, whole, len(rest), None, len(ids), signature(rest), rest.tobytes()))
            yield batch_of(out, [batch.schema.field(0).type, *[pa.int64()] * 5, pa.binary()], ["id", "start", "length", "ids_crc32", "doc_tokens", "signature", "ids"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()
        forget()  # encoding is over once its shuffle is read, and workers live on
        packer, number = Packer(length), TaskContext.get().partitionId() << 40
        id_type, out = pa.int64(), []
        types = [*[pa.int64()] * 6, *([pa.binary()] if keep_ids else [])]
        names = ["id", *(x.split()[0] for x in PIECES.split(", ")), *(["ids"] if keep_ids else [])]

        def put(window: list[tuple]) -> None:
            nonlocal number
            offset = 0
            for (doc, tokens), ids, start in window:
                out.append((doc, start, len(ids), crc32(ids), tokens, number, offset, *([ids.astype("<u4").tobytes()] if keep_ids else [])))
                offset += len(ids)
            number += 1

        for batch in steps(batches, 6):
            id_type = batch.schema.field(0).type
            for doc, start, size, crc, tokens, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if crc is not None:
                    out.append((doc, start, size, crc, tokens, number, 0, *([np.frombuffer(ids, width).astype("<u4").tobytes()] if keep_ids else [])))
                    number += 1
                    continue
                for window in packer.add((doc, tokens), np.frombuffer(ids, width), start):
                    put(window)
            if out:
                yield batch_of(out, [id_type, *types], names)
                out.clear()
        for window in packer.rest():
            put(window)
        if out:
            yield batch_of(out, [id_type, *types], names)

    encoded = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(encode, f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, signature bigint, ids binary")
    routed = encoded.hint("rebalance", "signature").sortWithinPartitions("signature", "id", "start", "ids_crc32", "ids")
    return routed.mapInArrow(place, f"id {kind}, {PIECES}" + (", ids binary" if keep_ids else "")).withColumnRenamed("id", id_col)


def batch_of(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
