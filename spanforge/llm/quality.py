"""Quality rules: base counts, and repetition found by suffix arrays of words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanforge.llm.shared import steps
from spanforge.llm.words import SPACE, U64, Words, digested, flat, mixed, prefix_hash, span_hash, words

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class Rules:
    """A text is rejected by the base rules, or if its repeats go beyond either of the two last limits."""

    min_words: int = 50
    max_repeat_words_percent: int = 50
    #: Repeats shorter than this many words are ordinary phrases and don't count in what follows.
    min_repeat: int = 15
    max_covered_percent: int = 30
    max_longest_repeat: int = 200


def suffix_array(key: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and LCP array of many sequences at once, by prefix doubling; memory is linear.

    key: a number for each element; last: the position after the sequence's end, for each element. Suffixes end
    with their sequence; an end sorts first. lcp[k] is the length that suffixes sa[k - 1] and sa[k] share, 0 for
    k = 0 and across sequences if the keys of different sequences differ.
    """
    n = len(key)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 1
    size = np.diff(np.append(np.flatnonzero(new), n))
    active = order[np.repeat(size > 1, size)]
    while len(active):
        then = active + h
        second = np.where(then < last[active], rank[np.minimum(then, n - 1)], -1)
        first = rank[active]
        by = np.lexsort((second, first))
        at, first, second = active[by], first[by], second[by]
        group = np.ones(len(at), bool)
        group[1:] = first[1:] != first[:-1]
        sub = group.copy()
        sub[1:] |= second[1:] != second[:-1]
        spot = np.arange(len(at))
        rank[at] = first + np.maximum.accumulate(np.where(sub, spot, 0)) - np.maximum.accumulate(np.where(group, spot, 0))
        h *= 2
        size = np.diff(np.append(np.flatnonzero(sub), len(at)))
        active = at[np.repeat(size > 1, size)]
    sa = order  # its place is free
    sa[rank] = np.arange(n)
    return sa, common_prefixes(key, last, sa, rank)


#: Common prefixes up to this length are compared for all suffixes at once.
ALL_AT_ONCE = 16


def common_prefixes(key: np.ndarray, last: np.ndarray, sa: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """LCP array. Prefixes that go beyond ALL_AT_ONCE elements, few in most texts, are measured in the order of
    the text: a suffix shares at least one element less than the suffix before it, so no element is compared twice."""
    lcp = np.zeros(len(sa), np.int64)
    pair = 1 + np.flatnonzero(key[sa[1:]] == key[sa[:-1]])
    lcp[pair] = 1
    for k in range(1, ALL_AT_ONCE):
        a, b = sa[pair - 1] + k, sa[pair] + k
        ok = (a < last[a - k]) & (b < last[b - k])
        ok[ok] = key[a[ok]] == key[b[ok]]
        pair = pair[ok]
        lcp[pair] = k + 1
    keys, shared, before = memoryview(key), 0, -2
    for i in np.sort(sa[pair]).tolist():
        at = int(rank[i])
        j = int(sa[at - 1])
        shared = max(shared - 1, ALL_AT_ONCE) if i == before + 1 else ALL_AT_ONCE
        most = min(int(last[i]) - i, int(last[j]) - j)
        while shared < most and keys[i + shared] == keys[j + shared]:
            shared += 1
        lcp[at] = shared
        before = i
    return lcp


def repeats(sa: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """By position: length of the longest repeat that begins there, the largest LCP interval of its suffix."""
    out = np.zeros(len(sa), np.int64)
    out[sa] = np.maximum(lcp, np.append(lcp[1:], 0))
    return out


def covered(longest: np.ndarray, least: int, width: int | None = None) -> np.ndarray:
    """Elements within the union of the repeats of at least `least` elements (each cut to width, if given)."""
    at = np.flatnonzero(longest >= least)
    n = len(longest) + 1
    begins, ends = np.bincount(at, minlength=n), np.bincount(at + (longest[at] if width is None else width), minlength=n)
    return np.cumsum(begins - ends)[:-1] > 0


def per_doc(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def duplicate_lines(raw: np.ndarray, at: np.ndarray, prefix: np.ndarray, w: Words) -> np.ndarray:
    """By text: lines with a word that are equal to an earlier line of it."""
    n = len(at) - 1
    cut = np.flatnonzero(raw == 10)
    start = np.concatenate([at[:-1], cut + 1])
    end = np.concatenate([cut, at[1:]])
    doc = np.concatenate([np.arange(n), np.searchsorted(at, cut, "right") - 1])
    by = np.argsort(start, kind="stable")
    # Of a text's lines the first starts with it and the last ends with it; sorted ends match sorted starts.
    start, doc, end = start[by], doc[by], np.sort(end)
    some = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, doc = start[some], end[some], doc[some]
    key = digested(raw, start, end, span_hash(prefix, start, end)) ^ mixed(doc.astype(U64) + U64(1))
    _, kept = np.unique(key, return_index=True)
    return np.bincount(doc, minlength=n) - np.bincount(doc[kept], minlength=n)


def measure(column: pa.Array, rules: Rules) -> dict[str, np.ndarray]:
    raw, at = flat(column)
    prefix = prefix_hash(raw)
    w = words(raw, at, prefix=prefix)
    out = {
        "n_words": np.diff(w.first),
        "word_chars": per_doc(((raw & 0xC0) != 0x80) & ~SPACE[raw], at),
        "n_symbols": per_doc(SYMBOL[raw], at),
        "n_dup_lines": duplicate_lines(raw, at, prefix, w),
    }
    n_words = out["n_words"]
    key, doc, first = mixed(w.hash ^ mixed(w.doc.astype(U64) + U64(1))), w.doc, w.first
    del prefix, w  # the suffix array needs the room
    longest = repeats(*suffix_array(key, np.repeat(first[1:], n_words)))
    most = np.zeros(len(n_words), np.int64)
    np.maximum.at(most, doc, longest)
    out["n_repeat_words"] = per_doc(covered(longest, 3, 3), first)
    out["n_covered_words"] = per_doc(covered(longest, rules.min_repeat), first)
    out["longest_repeat"] = most
    out["base_failed"] = (n_words < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_words_percent * n_words)
    out["kept"] = ~(out["base_failed"] | (100 * out["n_covered_words"] > rules.max_covered_percent * n_words) | (most > rules.max_longest_repeat))
    return out


FIELDS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_covered_words bigint, longest_repeat bigint, base_failed boolean, kept boolean"


def quality(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdict of every whole text, a row for each row of docs.

    The base rules look at the number of words and at words in 3-word windows found twice. The verdict's own
    part is the suffix array of the text's words: its LCP intervals give the maximal repeats; those of at least
    min_repeat words are united into spans. Too large a covered part or too long a single repeat rejects.
    Null and empty texts have no words, so they fail the base rules. Ids may be null or repeat. Other columns,
    whatever their names, are not read; an empty table gives no rows. No shuffle;
    memory goes with the longest text, and texts are handled some megabytes at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 1):
            got = measure(batch.column(1), rules)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, got.values())], ["id", *got])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, {FIELDS}").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """The rows of docs whose text passes, with all their columns (whatever their names) as they were."""
    at, schema = docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, at):
            yield batch.filter(pa.array(measure(batch.column(at), rules)["kept"]))

    return docs.mapInArrow(run, schema)
