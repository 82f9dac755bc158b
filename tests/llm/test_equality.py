"""Texts that a polynomial hash modulo 2**64 takes for equal, whatever its base, are told apart."""

import random

import numpy as np

from spanforge.llm import quality, shingles, substrings, words


def thue_morse(a, b, n=1024):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


ONE, TWO = thue_morse("a", "b"), thue_morse("b", "a")


def test_such_words_are_told_apart():
    raw, at = words.flat(__import__("pyarrow").array([ONE, TWO, ONE]))
    assert len({int(x) for x in words.span_hash(words.prefix_hash(raw), at[:-1], at[1:])}) == 1  # what is meant
    h = words.words(raw, at).hash
    assert h[0] == h[2] != h[1]


def test_jaccard_components_and_quality(make):
    rows = [(1, ONE), (2, TWO), (3, ONE)]
    assert {r.doc_id: r.component_id for r in shingles.jaccard_components(make(rows)).collect()} == {1: 1, 2: 2, 3: 1}
    text = f"x y {ONE} " + " ".join(f"w{i}" for i in range(60)) + f" x y {TWO}\n{ONE}z\n{TWO}z\n{ONE}z"
    (r,) = quality.quality(make([(1, text)])).collect()
    assert (r.n_repeat_words, r.n_dup_lines) == (0, 1)


def test_suffix_dedup_keeps_what_differs(make):
    rnd = random.Random(4)
    rows = [(i, "".join(rnd.choice("cdef ") for _ in range(300)) + t) for i, t in enumerate((ONE, TWO))]
    got = substrings.removal(make(rows)).collect()
    want = {}
    texts = [t.encode() for _, t in rows]
    seen: dict = {}
    for i, t in enumerate(texts):
        for at in range(len(t) - 199):
            seen.setdefault(t[at : at + 200], []).append((i, at))
    for i, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for places in seen.values():
            for j, at in places if len(places) > 1 else []:
                if j == i:
                    gone[at : at + 200] = True
        want[i] = int(gone.sum())
    assert {r.doc_id: r.n_removed for r in got} == want
