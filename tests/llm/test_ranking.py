"""Ranked search against the formula, document by document."""

import math
import random
import re
from collections import Counter

from spanforge.llm import ranking

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k=20):
    counts = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    N, L = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            m, score = 100 - 25 + 25 * sum(c.values()) * N // L, 0
            for t in TERM.findall((text or "").translate(LOWER)):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def tables(make, spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(40)] + ["Ärger", "ÄRGER", "the", "The", "日本", "x_y", "don't"]
    docs = [(i, " ".join(rnd.choice(["the", *words]) for _ in range(rnd.randint(1, 40)))) for i in range(90)]
    docs += [(3, docs[3][1]), (5, docs[7][1]), (None, docs[9][1]), (None, docs[9][1]), (200, None), (201, ""), (202, "...!"), (203, "the " * 9000 + "w1")]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 9)))) for i in range(12)] + [(50, "w1 w1 w1 the"), (51, None), (52, "!"), (None, "w3 日本"), (53, "unheard of")]
    return docs, items, make(docs, extra=True), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as at", "'x' as term", "2 as doc_id")


def test_equals_the_formula(spark, make):
    docs, items, d, i = tables(make, spark)
    want = brute(docs, items)
    assert len({r[0] for r in want}) > 12 and len(want) > 200
    for most in (ranking.MOST_BYTES, 0):
        found = ranking.search(d, i, most_bytes=most)
        assert sorted(map(tuple, found.collect()), key=repr) == want


def test_items_too_many_to_send_are_joined_by_term(spark, make):
    docs, items, d, i = tables(make, spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, ranking.search(d, i, k=7).collect()), key=repr) == brute(docs, items, 7)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_empty_tables(spark, make):
    docs, items, d, i = tables(make, spark)
    assert ranking.search(d.limit(0), i).collect() == ranking.search(d, i.limit(0)).collect() == []


def test_long_texts_in_parts():
    text = b"abc, " * 300 + b"z" * 500
    assert len(list(ranking.parts(text, 64))) > 10
    assert sum((Counter(ranking.TERM.findall(p)) for p in ranking.parts(text, 64)), Counter()) == ranking.term_counts(text)


def test_sums_stay_where_the_scored_postings_are(spark, make):
    """Documents and items meet after the last large shuffle, and only k rows an item of a partition go on."""
    _, _, d, i = tables(make, spark)
    plan = ranking.search(d, i)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "WindowGroupLimit" in plan
