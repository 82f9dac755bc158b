"""Shingle join, substring removal, vectors, pipeline against brute force, and on odd input."""

import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from spanforge.llm import components, shingles, substrings, suffixes, vectors

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed, n):
    rnd = random.Random(seed)
    return [("".join(rnd.choice("abcdefé") for _ in range(rnd.randint(2, 6)))) for _ in range(n)]


def near(ws, seed, changes):
    rnd, ws = random.Random(seed), list(ws)
    for _ in range(changes):
        ws[rnd.randrange(len(ws))] = f"w{rnd.randrange(10**6)}"
    return ws


def roots(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def brute_jaccard(rows):
    sets = []
    for _, t in rows:
        ws = [w.translate(UPPER) for w in WORD.findall(t or "")]
        sets.append({tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) > 4 else {tuple(ws)} if ws else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    links += [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][0] == rows[j][0]]  # one id is one node
    ids = [i for i, _ in rows]
    top = roots(len(rows), links)
    least = {}
    for i, r in zip(ids, top, strict=True):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return sorted((str(i), len(s), str(least[r])) for i, s, r in zip(ids, sets, top, strict=True))


def corpus(seed=1):
    base, family = prose(seed, 160), prose(seed + 1, 90)
    passage = prose(seed + 2, 60)
    rows = [(i, " ".join(near(base, i, i % 12))) for i in range(40)]
    rows += [(100 + i, " ".join(near(family, i, i % 4)).upper()) for i in range(30)]
    rows += [(200 + i, " ".join(prose(50 + i, 120) + passage + prose(90 + i, 50))) for i in range(30)]
    rows += [(300 + i, " ".join(prose(7, 12)[: 5 + i % 8])) for i in range(16)] + [(340 + i, "just four words here") for i in range(3)]
    rows += [(400, None), (401, ""), (402, " \n "), (403, "one"), (404, "ONE"), (405, " ".join(prose(9, 4000))), (406, " ".join(near(prose(9, 4000), 1, 90)))]
    rows += [(500, " ".join(base)), (500, " ".join(base)), (None, "nobody else has this text at all"), (None, None)]
    random.Random(seed).shuffle(rows)
    return rows


def test_texts_nearly_alike_make_no_rows_of_pairs(make, monkeypatch):
    base, other = prose(31, 150), prose(32, 150)
    rows = [(i, " ".join(near(base, i, 7))) for i in range(150)] + [(200 + i, " ".join(near(other, i, 7))) for i in range(90)]
    rows += [(300 + i, " ".join(near(near(base, i, 7), 900 + i, 2))) for i in range(0, 40, 4)]
    compared = []
    compare = shingles.Found.compare
    monkeypatch.setattr(shingles.Found, "compare", lambda self, pairs: (compared.append(pairs.count()), compare(self, pairs)))
    got = shingles.jaccard_components(make(rows)).collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == brute_jaccard(rows)
    assert compared[-1] < 10 * len(rows)  # the lists are shared by 100 components and more: thousands of pairs


@pytest.mark.parametrize("long", [32, 2])
def test_jaccard_join_equals_brute_force(make, monkeypatch, long):
    monkeypatch.setattr(shingles, "LONG", long)  # long lists are rare in small tables
    monkeypatch.setattr(shingles, "GIANT", long // 2)
    monkeypatch.setattr(shingles, "BLOCK", long)
    rows = corpus()
    got = shingles.jaccard_components(make(rows, extra=True)).collect()
    ours = sorted((str(r[0]), r[1], str(r[2])) for r in got)
    want = brute_jaccard([r for r in rows if r[0] is not None])
    assert [r for r in ours if r[0] != "None"] == want
    assert [r for r in ours if r[0] == "None"] == [("None", 0, "None"), ("None", 3, "None")]
    assert shingles.jaccard_components(make([])).count() == 0


def test_heavy_shingles_and_subsets_change_nothing(make, monkeypatch):
    rows = [r for r in corpus(5) if r[0] is not None]
    monkeypatch.setattr(shingles, "HEAVY", 0.02)
    monkeypatch.setattr(shingles, "LEAST_HEAVY", 3)
    assert sorted((str(r[0]), r[1], str(r[2])) for r in shingles.jaccard_components(make(rows)).collect()) == brute_jaccard(rows)
    monkeypatch.setattr(shingles.Threshold, "cost", lambda self, a: 0)  # subsets for all small sets
    assert sorted((str(r[0]), r[1], str(r[2])) for r in shingles.jaccard_components(make(rows)).collect()) == brute_jaccard(rows)


def test_prefixes_and_subsets_meet_every_link():
    rule = shingles.Threshold()
    for a in range(1, 60):
        for b in range(a, 60):
            if rule.least(b) <= a:
                assert rule.overlap(a, b) in rule.subsets(a) and rule.overlap(a, b) in rule.subsets(b)
                assert a - rule.overlap(a, b) + 1 <= rule.prefix(a)


def test_one_of_each(make):
    rows = [r for r in corpus(3) if r[0] not in (None, 500)]
    kept = shingles.one_of_each(make(rows, extra=True))
    assert kept.columns == make(rows, extra=True).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(i for i, _, c in brute_jaccard(rows) if i == c)


def test_components(spark):
    rnd = random.Random(4)
    links = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, 600 + i) for i in range(50)] + [(7, 7)]
    top = roots(700, links)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: top[i] for i in {x for a, b in links if a != b for x in (a, b)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_deep_shallow_sorts():
    rnd = random.Random(5)
    for _ in range(200):
        texts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(50))) for _ in range(rnd.randrange(1, 90))]
        order, common = suffixes.deep_shallow(texts, list(range(len(texts))))
        assert [texts[i] for i in order] == sorted(texts)
        assert all(common[k] == suffixes.shared(texts[order[k - 1]], texts[order[k]]) for k in range(1, len(order)))


def brute_removal(rows, least):
    seen: dict = {}
    raw = [(t or "").encode() for _, t in rows]
    for t in raw:
        for s in range(len(t) - least + 1):
            seen[t[s : s + least]] = seen.get(t[s : s + least], 0) + 1
    out = []
    for (i, _), t in zip(rows, raw, strict=True):
        cover = [False] * len(t)
        for s in range(len(t) - least + 1):
            if seen[t[s : s + least]] > 1:
                cover[s : s + least] = [True] * least
        runs = sum(c and not (k and cover[k - 1]) for k, c in enumerate(cover))
        kept = bytes(b for b, c in zip(t, cover, strict=True) if not c)
        out.append((str(i), len(t), sum(cover), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("least", [200, 64])
def test_removal_equals_brute_force(make, monkeypatch, least):
    monkeypatch.setattr(substrings, "SORT", 50)
    passage, other = " ".join(prose(1, 80)), " ".join(prose(2, 90))
    rows = [(i, " ".join(prose(10 + i, 60)) + passage[i : i + 150 + 10 * i] + " ".join(prose(40 + i, 30))) for i in range(25)]
    rows += [(50 + i, " ".join(near(prose(3, 150), i, i))) for i in range(8)]
    rows += [(70, other + "|" + other), (71, "ab" * 300), (72, "ab" * 90 + "c" + "ab" * 120), (73, "a" * 900), (74, passage), (74, passage), (75, passage[:199]), (76, None), (77, ""), (None, other[:250]), (78, "é" * 400), (79, "xé" + "é" * 150)]
    got = sorted((str(r[0]), *r[1:]) for r in substrings.removal(make(rows, extra=True), least).collect())
    assert got == brute_removal(rows, least)
    cut = substrings.cut_docs(make(rows, extra=True), least)
    assert cut.columns == make(rows, extra=True).columns and cut.count() == len(rows)
    assert substrings.removal(make([])).count() == 0


@pytest.mark.parametrize("block", [4096, 7])
def test_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 8))
    rows = [(i, (base[i % 12] + rng.normal(size=8) * (0.02 if i % 3 else 0.25)).tolist()) for i in range(150)]
    rows += [(200 + i, base[0].tolist()) for i in range(9)] + [(220, (base[0] * 7).tolist())]
    rows += [(300, None), (301, [0.0] * 8), (302, [float("nan")] + [1.0] * 7), (303, [None] + [1.0] * 7), (304, [1.0, 2.0]), (305, [2.0, 4.0]), (306, []), (307, [float("inf")] * 8)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' as class", "'y' as size")
    usable = [(i, np.array(v, float) if v and None not in v and np.isfinite(v).all() and any(v) else None) for i, v in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if usable[i][1] is not None and usable[j][1] is not None and len(usable[i][1]) == len(usable[j][1]) and usable[i][1] @ usable[j][1] / np.linalg.norm(usable[i][1]) / np.linalg.norm(usable[j][1]) >= 0.95]
    top = roots(len(rows), links)
    want = sorted((rows[i][0], sum(i in x for x in links), rows[top[i]][0], top[i] == i) for i in range(len(rows)))
    assert sorted(tuple(r) for r in vectors.near_duplicates(df).collect()) == want
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_pipeline_stages(make):
    rows = [r for r in corpus(8) if r[0] is not None]
    docs = make([*rows, (900, "bad " * 80)])
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(docs.sparkSession, now, "")
        assert after.columns == docs.columns, name
        now = docs.sparkSession.createDataFrame(after.collect(), docs.schema)
        assert now.count(), name
    good = {r.doc_id for r in corpus_pipeline.STAGES[0][1](docs.sparkSession, docs, "").collect()}
    assert 900 not in good and 405 in good and {200 + i for i in range(30)} <= good
    pieces = corpus_pipeline.STAGES[-1][1](docs.sparkSession, now, "").collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in now.collect()}
