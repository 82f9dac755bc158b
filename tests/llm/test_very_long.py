"""Very long texts: whole results, and memory in proportion to the text."""

import tracemalloc

import numpy as np

from spanforge.llm import quality


def test_lcp_equals_brute_force():
    rng = np.random.default_rng(1)
    for symbols, n in ((2, 300), (3, 80), (40, 200), (1, 120)):
        key = rng.integers(0, symbols, n).astype(np.uint64)
        ends = sorted({n, *rng.integers(1, n, 2).tolist()})
        last = np.repeat(ends, np.diff([0, *ends]))
        key = key + np.searchsorted(ends, np.arange(n), "right").astype(np.uint64) * np.uint64(100)
        sa, lcp = quality.suffix_array(key, last)
        suffixes = sorted((key[i : last[i]].tolist(), i) for i in range(n))
        assert [s for s, _ in suffixes] == [key[i : last[i]].tolist() for i in sa.tolist()]
        for k in range(1, n):
            a, b = (key[sa[x] : last[sa[x]]] for x in (k - 1, k))
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            assert lcp[k] == (differ[0] if len(differ) else m)


def test_suffix_array_memory_does_not_grow_with_repeats():
    n = 400_000
    peaks = []
    for key in (np.full(n, 5, np.uint64), np.arange(n).astype(np.uint64)):
        tracemalloc.start()
        sa, lcp = quality.suffix_array(key, np.full(n, n))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert lcp.max() == 0 and peaks[0] < 140 * n
