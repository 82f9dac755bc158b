"""Texts of some megabytes in every operator that hadn't such a test: whole results."""

import random
import zlib

import pytest

from spanforge.llm import mixing, packing, ranking, registry, sharding, shingles, tokens


@pytest.fixture(scope="module")
def words():
    rnd = random.Random(12)
    return ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(260_000)]


@pytest.fixture
def docs(make, words):
    long = " ".join(words)
    return long, make([(1, long), (2, " ".join(words[:-1] + ["other"])), (3, " ".join(words[:900])), (4, "short text of six words here"), (None, None)])


def test_token_counts_and_packing(docs):
    long, table = docs
    path = registry.tokenizer_path()
    want = {i: len(tokens.tokenizer(path).encode(t or "", add_special_tokens=False).ids) for i, t in ((r.doc_id, r.text) for r in table.collect())}
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(table, path).collect()} == want and want[1] > 500_000
    pieces = packing.pack(table, path).collect()
    total: dict = {}
    for r in pieces:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {i: n + 1 for i, n in want.items()}


def test_near_copies_of_long_texts(docs):
    _, table = docs
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingles.jaccard_components(table).collect()}
    assert got[1][1] == got[2][1] == 1 and got[3] == (896, 3) and got[1][0] > 259_000 and got[4] == (2, 4) and got[None] == (0, None)


def test_sizes_of_long_texts(docs, words):
    long, table = docs
    sizes = {r.doc_id: r.size for r in mixing.mix(table).collect()}
    assert sizes == {1: 260_000, 2: 260_000, 3: 900, 4: 6, None: 0}
    rows = {r.doc_id: r for r in sharding.kd_shards(table, shards=3).collect()}
    assert rows[1].size == len(long) + 8 and rows[1].text_crc32 == zlib.crc32(long.encode()) and rows[1].shard != rows[2].shard


def test_long_texts_are_ranked_whole(spark, docs, words):
    _, table = docs
    items = spark.createDataFrame([(7, "other"), (8, words[-1])], "item_id long, text string")
    got = {(r.item_id, r.doc_id) for r in ranking.search(table, items).collect()}
    assert (7, 2) in got and (8, 1) in got


def test_equal_scores_go_to_the_place_in_the_shard():
    import numpy as np

    packer = packing.Packer(64)
    same = np.arange(16, dtype="<u2")
    windows = [w for i in range(8) for w in packer.add((i, 16), same, 0)] + list(packer.pack())
    assert [[doc for (doc, _), *_ in w] for w in windows] == [[0, 1, 2, 3], [4, 5, 6, 7]]
