"""Projected tf-idf vectors without rows of terms, against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from spanforge import catalog
from spanforge.operators import lexical

WORD = re.compile(r"\w+")


def brute(rows):
    counts = {}
    for i, t in rows:
        counts.setdefault(i, Counter()).update(WORD.findall((t or "").lower()))
    df = Counter(t for c in counts.values() for t in c)
    out = {}
    for i, c in counts.items():
        v = np.zeros(32)
        for t, tf in c.items():
            w = (1 + math.log(tf)) * math.log1p((len(rows) - df[t] + 0.5) / (df[t] + 0.5))
            v += [w if x < "8" else -w for x in hashlib.md5(t.encode()).hexdigest()]
        if np.sqrt(v @ v) > 0:
            out[i] = v / np.sqrt(v @ v)
    return out


@pytest.mark.parametrize("most", [lexical.MOST_TERMS, 20, 0])
@pytest.mark.parametrize("repeated", [False, True])
def test_vectors_equal_the_formula_whatever_goes_to_all_tasks(spark, monkeypatch, most, repeated):
    monkeypatch.setattr(lexical, "STEP_TERMS", 50)
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Größe", "naïve", "x_1", "日本"]
    rows = [(i, " ".join(rnd.choice(words[: rnd.randint(1, len(words))]) for _ in range(rnd.randint(0, 40)))) for i in range(60)]
    rows += [(60, None), (61, "..."), (62, "only here"), (None, "w1 no id")]
    if repeated:
        rows += [(3, "w1 w2 twice"), (3, "w1"), (None, "another one w2"), (60, None)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    got = {r.id: r.vector for r in lexical.vectors(docs, lexical.vocabulary(docs), most=most).collect()}
    want = brute(rows)
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], atol=1e-12) for i in want)


def test_an_empty_corpus_has_no_vectors(spark):
    docs = spark.createDataFrame([], "id long, text string")
    assert lexical.vectors(docs, lexical.vocabulary(docs)).count() == 0


def test_tfidf_writes_no_rows_of_occurrences(spark, monkeypatch):
    names, staged = [], lexical.staged
    monkeypatch.setattr(lexical, "staged", lambda df, name: (names.append(name), staged(df, name))[1])
    assert catalog.QUERIES["tfidf_topk"](spark, "/root/testdata/sf0.001").count() > 0
    assert "occurrences" not in names
