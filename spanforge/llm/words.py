"""Words `[^\\x20\\x09-\\x0D]+` of many texts at once, with 64-bit hashes, in NumPy.

All hashes come from one prefix sum of table[byte] * BASE**position modulo 2**64, so that the hash of any
span is one subtraction and one multiplication. They do not depend on the process, batch or position. Modulo a power
of two, long texts can be made whose sums are equal whatever the base; so spans of more than LONG bytes, few among
words, have a cryptographic digest instead where equal hashes are taken for equal bytes (`digested`).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C55
BASE_INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finisher)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


TABLE = mixed(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
#: BASE**i for i < 2**16, and the same of its inverse; higher powers are products of one of these and one of _high.
CHUNK = 1 << 16
LOW = []
for _base in (BASE, BASE_INVERSE):
    _x = np.full(CHUNK, _base, U64)
    _x[0] = 1
    LOW.append(np.multiply.accumulate(_x))
_high: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def high_powers(chunks: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**(CHUNK * i) and its inverse for i < chunks at least; the last size is kept."""
    size = 1 << max(8, (chunks - 1).bit_length())
    if size not in _high:
        _high.clear()
        both = []
        for base in (BASE, BASE_INVERSE):
            x = np.full(size, pow(base, CHUNK, 1 << 64), U64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _high[size] = (both[0], both[1])
    return _high[size]


def scale(x: np.ndarray, inverse: bool = False) -> None:
    """Multiply each x[i] by BASE**i, or divide by it, in place."""
    low, high = LOW[inverse], high_powers(-(-len(x) // CHUNK) or 1)[inverse]
    for i, at in enumerate(range(0, len(x), CHUNK)):
        part = x[at : at + CHUNK]
        part *= low[: len(part)] * high[i] if i else low[: len(part)]


def back(at: np.ndarray) -> np.ndarray:
    """BASE**-i for each position."""
    high = high_powers((int(at.max()) >> 16) + 1 if len(at) else 1)[1]
    return LOW[1][at & (CHUNK - 1)] * high[at >> 16]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end and len + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """8 bytes for each byte, and no more while it is made."""
    out = np.zeros(len(raw) + 1, U64)
    x = out[1:]
    np.take(TABLE, raw, out=x, mode="clip")  # no copy, as bytes are never out of range
    scale(x)
    np.cumsum(x, out=x)
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of the bytes [start, end) of the text that prefix was made from."""
    return mixed((prefix[end] - prefix[start]) * back(start) + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


#: Bytes up to which the hash of a span is that of the prefix sums.
LONG = 32


def digested(raw: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, longer: int = LONG) -> np.ndarray:
    """hashes, in place, with 64 bits of BLAKE2b for each span of more than `longer` bytes."""
    at = np.flatnonzero(end - start > longer)
    if len(at):
        data, digest = memoryview(np.ascontiguousarray(raw)), hashlib.blake2b
        found = b"".join([digest(data[a:b], digest_size=8).digest() for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
        hashes[at] = np.frombuffer(found, "<u8")
    return hashes


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray  # number of the text in the batch
    hash: np.ndarray
    first: np.ndarray  # of each text, and the total: offsets into the others


def words(raw: np.ndarray, at: np.ndarray, lower: bool = False, prefix: np.ndarray | None = None) -> Words:
    n = len(at) - 1
    if not len(raw):
        z = np.zeros(0, np.int64)
        return Words(z, z, z, np.zeros(0, U64), np.zeros(n + 1, np.int64))
    if lower:
        raw = LOWER[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    inside = ~SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, at)
    doc = np.repeat(np.arange(n), np.diff(first))
    return Words(start, end, doc, digested(raw, start, end, span_hash(prefix_hash(raw) if prefix is None else prefix, start, end)), first)
