"""Corpus scores, substrings, matches by path ends and tables of policies, against brute force."""

import fnmatch
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanforge.operators import lexical, retrieval, review, search, substring

WORD = re.compile(r"\w+")


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["Größe", "naïve", "x_1", "日本"]
    rows = [(i, " ".join(rnd.choice(words[: rnd.randint(2, len(words))]) for _ in range(rnd.randint(0, 25)))) for i in range(60)]
    rows += [(60, None), (61, "..."), (62, "w1, W1; w1")]
    return rows, spark.createDataFrame(rows, "id long, text string").repartition(3)


def test_bm25_equals_the_formula(spark, corpus):
    rows, docs = corpus
    asked = {100: "w1 w2 w2 größe", 101: "x_1 unknown", 102: "", 103: "日本 w1"}
    queries = spark.createDataFrame(list(asked.items()), "qid long, text string")
    pool = docs.select(F.col("id"), F.lit(0.5).alias("score"), F.lit("p").alias("path")).crossJoin(queries.select("qid"))
    counts = {i: Counter(WORD.findall((t or "").lower())) for i, t in rows}
    mean = sum(sum(c.values()) for c in counts.values()) / len(rows)
    df = Counter(t for c in counts.values() for t in c)
    want = {}
    for qid, text in asked.items():
        for i, c in counts.items():
            s = 0.0
            for t in set(WORD.findall(text.lower())):
                if c[t]:
                    s += math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
            want[qid, i] = s
    got = {(r.qid, r.id): r.score for r in lexical.reranker(docs, queries)(pool).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=2e-6) for k in want)


def test_vectors_of_like_texts_are_near(spark, corpus):
    rows, docs = corpus
    stats = lexical.statistics(docs)
    made = {r.id: r.vector for r in lexical.vectors(docs, stats).collect()}
    assert 60 not in made and 61 not in made and all(math.isclose(sum(x * x for x in v), 1) for v in made.values())
    again = lexical.vectors(spark.createDataFrame([(0, rows[5][1]), (1, "W1 w1 w1!")], "id long, text string"), stats)
    got = {r.id: r.vector for r in again.collect()}
    assert all(math.isclose(a, b) for a, b in zip(got[0], made[5], strict=True))
    assert math.isclose(sum(a * b for a, b in zip(got[1], made[62], strict=True)), 1)


def test_hybrid_takes_the_reranked_scores(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "b"), (3, [0.0, 1.0], "c")], "id long, embedding array<double>, path string")
    query = spark.createDataFrame([(7, [1.0, 0.0])], "qid long, query array<double>")
    docs = spark.createDataFrame([(1, "plain"), (2, "plain words"), (3, "rare words")], "id long, text string")
    rerank = lexical.reranker(docs, spark.createDataFrame([(7, "rare words")], "qid long, text string"))
    got = [(r.id, r["rank"]) for r in search.hybrid(corpus, query, None, rerank=rerank).orderBy("rank").collect()]
    assert got == [(3, 1), (2, 2), (1, 3)]


def test_substrings_equal_contains(spark, corpus):
    rows, docs = corpus
    texts = [*rows, (70, "mod a::b;\nuse a::bc"), (70, "::b"), (None, "::b"), (71, "é"), (72, ""), (73, "aé" * 4000 + "needle")]
    needles = [(0, "w1"), (1, "w1 w2"), (2, "::b"), (3, "::bc"), (4, "größe"), (5, "Größe"), (6, "é"), (7, ""), (8, None), (9, "absent here"), (10, "aéneedle"), (11, "aéaéaé"), (12, ";\nuse"), (2, "::b"), (13, ":")]
    d, n = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(needles, "qid long, needle string")
    want = sorted((q, i) for q, x in dict.fromkeys(needles) for i, t in texts if i is not None and t is not None and x is not None and x in t)
    for most in (substring.MOST_GRAMS, 1):
        got = sorted({(q, i): None for q, i in map(tuple, substring.search(substring.build(d), d, n.distinct(), most=most).collect())})
        assert got == sorted(set(want))
    found = substring.search(substring.build(d), d, spark.createDataFrame([(1, "::b")], "qid long, needle string")).collect()
    assert Counter(r.id for r in found) == {70: 2}
    few = substring.candidates(substring.build(d), spark.createDataFrame([(1, "rare needle")], "qid long, needle string"))
    assert few.count() == 0


def test_an_index_of_trigrams_can_be_kept(spark, corpus, tmp_path):
    _, docs = corpus
    index = substring.build(docs)
    index.save(f"file://{tmp_path}/grams")
    needles = spark.createDataFrame([(1, "w1 w2"), (2, "w10")], "qid long, needle string")
    assert sorted(map(tuple, substring.search(substring.Index.load(spark, f"file://{tmp_path}/grams"), docs, needles).collect())) == sorted(map(tuple, substring.search(index, docs, needles).collect()))


def test_paths_match_by_their_ends(spark):
    results = [(1, "src/a.py", 1), (1, "lib/b.py", 2), (1, "src/A.PY", 3), (2, "b.py", 1), (2, "ab.py", 2), (3, "x", 1), (4, "", 1), (1, None, 4)]
    gold = [(1, "a.py"), (1, "A.py"), (1, "repo/lib/b.py"), (1, "c.py"), (2, "b.py"), (3, None), (4, "z.py"), (5, "q.py")]
    r = spark.createDataFrame(results, "qid long, path string, rank long")
    g = spark.createDataFrame(gold, "qid long, expected string")
    want = {(q, p, k, e.lower()) for q, p, k in results for q2, e in gold if q == q2 and p is not None and e is not None and (p.lower().endswith(e.lower()) or e.lower().endswith(p.lower()))}
    found = retrieval.suffix_matches(r, g).collect()
    assert {tuple(x) for x in found} == want and len(found) == len(want)
    by = {x.qid: (x.reciprocal_rank, x.recall_at_3) for x in retrieval.judged_by_path(r, g).collect()}
    assert by == {1: (1.0, 0.666667), 2: (1.0, 1.0), 3: (0.0, 1.0), 4: (1.0, 1.0), 5: (0.0, 0.0)}
    assert {tuple(x) for x in retrieval.missing_by_path(r, g).collect()} == {(1, "c.py"), (5, "q.py")}


def test_policies_as_a_table_equal_fnmatch(spark):
    rnd = random.Random(8)
    paths = sorted({"/".join(rnd.choice(["src", "tests", "a", "b.py", "c[1].rs", "x]y", "", "long_name_of_a_folder"]) for _ in range(rnd.randint(1, 5))) for _ in range(300)})
    parts = ["*", "?", "src", "/", ".py", "[ab]", "[!a]", "[]x]", "[", "a", "long_name", "tests/", "]", "c[[]1"]
    patterns = sorted({"".join(rnd.choice(parts) for _ in range(rnd.randint(1, 6))) for _ in range(700)} | {"*", "**", "?", "", "src/a", "*[]abc]*"})
    rules = [(f"r{i}", "protected_write" if i % 3 else "unguarded_path", p, "warn", "m") for i, p in enumerate(patterns)] + [("n", "protected_write", None, "warn", "m"), ("i", "banned_import", "*", "warn", "m")]
    got = review.path_violations(spark.createDataFrame(rules, "id string, type string, pattern string, severity string, message string"), spark.createDataFrame([(p,) for p in paths] + [(None,)], "path string")).collect()
    want = {(r[0], p) for r in rules if r[1] != "banned_import" and r[2] is not None for p in paths if fnmatch.fnmatchcase(p, r[2])}
    assert {(r.policy_id, r.path) for r in got} == want and len(got) == len(want) > 1500
