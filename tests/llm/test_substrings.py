"""Substring removal with hot anchors and very long texts."""

import hashlib
import random

import pytest

from spanforge.llm import substrings
from tests.llm.test_duplicates import brute_removal


def noise(rnd, n):
    return "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))


@pytest.mark.parametrize(("least", "hot", "offsets"), [(64, 3, 8), (64, 3, 1), (70, 2, 16), (64, 0, 64)])
def test_hot_anchors_equal_brute_force(make, monkeypatch, least, hot, offsets):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "OFFSETS", offsets)
    rnd = random.Random(least)
    passage, few = noise(rnd, 70), noise(rnd, 60)
    rows = []
    for i in range(60):  # one passage in many contexts, some of which some share in part
        left, right = noise(random.Random(i % 7), 40), noise(random.Random(100 + i % 5), 40)
        rows.append((i, noise(rnd, 30) + left[i % 20 :] + passage[i % 9 : 60 + i % 11] + right[: 10 + i % 25] + noise(rnd, 30)))
    rows += [(100 + i, noise(rnd, 50) + few + noise(rnd, 50)) for i in range(30)]  # shorter than a window
    got = sorted((str(r[0]), *r[1:]) for r in substrings.removal(make(rows), least).collect())
    assert got == brute_removal(rows, least)
    assert any(r[2] for r in got) and any(not r[2] for r in got)


def test_a_gram_with_many_contexts(make):
    """20,000 rows hold a passage of 150 bytes between random bytes: no window repeats, and no task gets them all."""
    rnd = random.Random(1)
    passage = noise(rnd, 150)
    rows = [(i, noise(rnd, 60) + passage + noise(rnd, 60)) for i in range(20_000)] + [(30_000, "x" + passage + noise(rnd, 10))]
    rows += [(30_001 + i, "left side " * 3 + passage + " and the right side") for i in range(2)]
    got = {r.doc_id: r for r in substrings.removal(make(rows)).collect()}
    assert {i for i, r in got.items() if r.n_removed} == set()
    rows += [(40_000 + i, noise(rnd, 5) + "left side of it " * 3 + passage + " and the right side" + noise(rnd, 5)) for i in range(2)]
    got = {r.doc_id: r for r in substrings.removal(make(rows)).collect()}
    assert {i: r.n_removed for i, r in got.items() if r.n_removed} == {40_000: 217, 40_001: 217}


def test_very_long_texts(make):
    rnd = random.Random(2)
    part = noise(rnd, 300_000)
    long = noise(rnd, 4_000_000) + part + noise(rnd, 4_000_000)
    rows = [(1, long), (2, part), (3, noise(rnd, 5000) + part[1000:2000]), (4, None)]
    got = {r.doc_id: r for r in substrings.removal(make(rows)).collect()}
    assert (got[1].n_bytes, got[1].n_removed, got[1].n_spans) == (len(long), 300_000, 1)
    assert (got[2].n_removed, got[3].n_removed, got[4].n_removed) == (300_000, 1000, 0)
    assert got[2].kept_sha256 == got[4].kept_sha256 == hashlib.sha256(b"").hexdigest()


def test_cut_docs_keep_the_rest_of_texts(make):
    rnd = random.Random(3)
    passage = noise(rnd, 260)
    rows = [(1, "one " + passage + " two"), (2, passage), (None, "é" + passage + "x"), (4, "é" * 150), (5, "yé" + "é" * 149), (6, None), (6, ""), (7, "clean")]
    docs = make(rows, extra=True)
    got = sorted(((str(r.doc_id), r.text, r.n_chars) for r in substrings.cut_docs(docs).collect()), key=repr)
    assert got == sorted([("1", "one  two", 8), ("2", "", 0), ("None", "éx", 2), ("4", "", 0), ("5", "y", 1), ("6", None, None), ("6", "", 0), ("7", "clean", 5)], key=repr)
    assert substrings.cut_docs(make([])).count() == 0
