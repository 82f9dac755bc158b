"""The BM25 ranking behind packing against the formula, all terms counted."""

import math
from collections import Counter

import numpy as np

from spanforge.llm import packing


def brute_scores(docs, query):
    mean, out = sum(map(len, docs)) / len(docs), []
    df = Counter(t for d in docs for t in set(d.tolist()))
    for d in docs:
        tf, total = Counter(d.tolist()), 0.0
        for t in set(query.tolist()):
            idf = math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5))
            total += idf * tf[t] * (packing.K1 + 1) / (tf[t] + packing.K1 * (1 - packing.B + packing.B * len(d) / mean))
        out.append(total)
    return out


def test_scores_equal_bm25_with_frequent_terms():
    rng = np.random.default_rng(3)
    # A few terms are in nearly all documents, some in about a third, most in few.
    docs = [np.concatenate([rng.choice(8, rng.integers(1, 9)), 10 + rng.choice(30, rng.integers(1, 12)), 50 + rng.choice(4000, rng.integers(1, 60))]).astype("<u2") for _ in range(200)]
    index = packing.Index(docs)
    assert len(index.rows) > 5 and index.few.any()
    for seed in (0, 17, 199):
        assert np.allclose(index.scores(seed), brute_scores(docs, docs[seed]), rtol=1e-4, atol=1e-4)
    assert np.allclose(index.scores(0, docs[0][:3]), brute_scores(docs, docs[0][:3]), rtol=1e-4, atol=1e-4)


def test_a_window_holds_the_best_unused_documents():
    rng = np.random.default_rng(4)
    docs = [(100 + rng.choice(300, 64)).astype("<u2") for _ in range(40)]
    packer = packing.Packer(256)
    windows = [w for i, d in enumerate(docs) for w in packer.add((i, 64), d, 0)] + list(packer.pack())
    used: set[int] = set()
    for window in windows:
        ids = [doc for (doc, _), *_ in window]
        seed = min(set(range(40)) - used)
        assert ids[0] == seed
        score = brute_scores(docs, docs[seed])
        best = sorted((i for i in range(40) if i not in used and i != seed), key=lambda i: -score[i])
        assert [round(score[i], 3) for i in ids[1:]] == [round(score[i], 3) for i in best[: len(ids) - 1]]
        used |= set(ids)
    assert len(used) == 40
