"""Searches over a query set: each query is answered as if it were alone."""

from spanforge import catalog
from spanforge.operators import search

DATA = "/root/testdata/sf0.01"


def test_boost_counts_the_pool_of_its_own_query(spark):
    pool = spark.createDataFrame([(1, 1, "a", 0.5), (1, 2, "b", 0.4), (2, 1, "a", 0.3), (2, 3, "c", 0.2)], "qid long, id long, path string, score double")
    refs = spark.createDataFrame([("r", "IMPORTS", "m", "a"), ("r", "IMPORTS", "m", "b"), ("r", "IMPORTS", "n", "c")], "repo_id string, type string, dst string, src string")
    got = {(r.qid, r.path): r.score for r in search.boosted(pool, refs).collect()}
    assert got == {(1, "a"): 0.55, (1, "b"): 0.45, (2, "a"): 0.3, (2, "c"): 0.2}


def test_a_query_set_holds_the_single_query(spark):
    one = {(r.id, r.score, r["rank"]) for r in catalog.QUERIES["hybrid_search"](spark, DATA).collect()}
    every = catalog.QUERIES["hybrid_search_batch"](spark, DATA).collect()
    assert {(r.id, r.score, r["rank"]) for r in every if r.qid == 0} == one
    assert len({r.qid for r in every}) > 1


def test_docstrings_are_of_whole_texts(spark):
    rows = {r.doc_id: r.docstring for r in catalog.QUERIES["docstring_whole"](spark, DATA).collect()}
    assert max(map(len, rows.values())) > 120 and "" in rows.values()


def test_whole_registry_and_documents_are_read(spark):
    assert catalog.QUERIES["language_matrix_whole"](spark, DATA).count() == 26
    found = catalog.QUERIES["embed_hash_documents"](spark, DATA)
    assert found.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert {len(r.vector) for r in found.limit(50).collect()} == {64}


def test_blocks_give_what_one_matrix_gives(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet")
    queries = rows.where("vec_id % 100 = 0").selectExpr("vec_id AS qid", "embedding AS query")
    for search_for in (lambda **how: search.nearest(rows, queries, 5, "vec_id", **how), lambda **how: search.alike(rows, queries, 0.3, "vec_id", **how)):
        whole = sorted(map(tuple, search_for().collect()))
        assert whole and whole == sorted(map(tuple, search_for(most_bytes=800).collect()))


def test_rows_of_another_length_do_not_hide_the_others(spark):
    rows = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(9)] + [(9, [1.0, 0.0]), (10, None), (11, [0.0, 0.0])], "id long, embedding array<double>").coalesce(1)
    queries = spark.createDataFrame([(100, [2.0, 0.0]), (101, None)], "qid long, query array<double>")
    for most in (search.MOST_BYTES, 8):
        assert [(r.qid, r.id, r.score) for r in search.nearest(rows, queries, 3, most_bytes=most).collect()] == [(100, 9, 1.0)]
        assert sorted((r.qid, r.hits, r.best) for r in search.alike(rows, queries, 0.5, most_bytes=most).collect()) == [(100, 1, 1.0), (101, 0, None)]
