"""Indexed search: all of it where it is to be exact, measured where it is not."""

import numpy as np
import pytest

from spanforge import catalog
from spanforge.operators import knn, search

DATA = "/root/testdata/sf0.01"


def clustered(n, size=16, clusters=40, spread=0.25, seed=3):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(clusters, size))[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, size))


@pytest.fixture(scope="module")
def tables(spark):
    x = clustered(3000).round(3)
    rows = [(i, v.tolist(), f"p{i % 7}") for i, v in enumerate(x)]
    rows += [(3000, None, "p"), (3001, [], "p"), (3002, [0.0] * 16, "p"), (3003, [1.0, 2.0], "p"), (3004, rows[100][1], "p"), (3005, [float("nan")] * 16, "p")]
    corpus = spark.createDataFrame(rows, "id long, embedding array<double>, path string").repartition(3)
    queries = corpus.where("id % 100 = 0").selectExpr("id AS qid", "embedding AS query")
    return corpus, queries


def answers(rows, *columns):
    return sorted(tuple(r[c] for c in ("qid", "id", "score", "rank", *columns)) for r in rows)


def test_exact_equals_the_scan(tables, monkeypatch):
    corpus, queries = tables
    want = answers(search.nearest(corpus, queries, 8).collect())
    assert answers(knn.nearest(knn.build(corpus), queries, 8, exact=True).collect()) == want
    # With blocks of few rows and queries, and a single probe in the first round.
    monkeypatch.setattr(knn, "BLOCK_ROWS", 5)
    index = knn.build(corpus, list_rows=100)
    assert len(index.centroids) == 30 and index.blocks.max() > 5
    assert answers(knn.nearest(index, queries, 8, probes=1, exact=True).collect()) == want


def test_flags_tell_the_truth_and_recall_is_measured(tables):
    corpus, queries = tables
    index = knn.build(corpus, keep=("path",), list_rows=64)
    true = search.nearest(corpus, queries, 8)
    want = answers(true.collect())
    found = knn.nearest(index, queries, 8).collect()
    flagged = {r.qid for r in found if r.exact}
    assert flagged and [r for r in answers(found) if r[0] in flagged] == [r for r in want if r[0] in flagged]
    assert {r.path for r in found} > {"p1", "p2"}
    r = knn.recall(knn.nearest(index, queries, 8), true, ["qid", "id"]).first()
    assert r.queries == 30 and r.wanted == 240 and r.recall >= 0.9
    assert index.probes < len(index.centroids) / 3


def test_an_index_can_be_kept(spark, tables, tmp_path):
    corpus, queries = tables
    index = knn.build(corpus)
    index.save(f"file://{tmp_path}/index")
    again = knn.Index.load(spark, f"file://{tmp_path}/index")
    assert answers(knn.nearest(again, queries, 5).collect()) == answers(knn.nearest(index, queries, 5).collect())


def test_nothing_to_index_or_ask(spark, tables):
    corpus, queries = tables
    assert knn.nearest(knn.build(corpus.where("id = 3000")), queries, 5).collect() == []
    assert knn.nearest(knn.build(corpus), queries.limit(0), 5, exact=True).collect() == []
    few = knn.nearest(knn.build(corpus.where("id < 3")), queries, 5, exact=True).collect()
    assert {r.id for r in few} == {0, 1, 2}


def test_recall_over_the_query_set(spark):
    for data in (DATA, "/root/testdata/sf0.1"):
        r = catalog.QUERIES["vector_index_recall"](spark, data).first()
        assert r.recall >= 0.9 and r.wanted == 10 * r.queries
