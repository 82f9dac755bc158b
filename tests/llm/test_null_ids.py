"""Rows without an id are dealt by their texts; other tokenizers are encoded by the library."""

import numpy as np
import public_tokenizers

from spanforge.llm import mixing, packing, sharding


def test_null_ids_spread_over_shards(make):
    docs = make([(None, f"w{i} " * 20) for i in range(200)])
    got = mixing.mix(docs, block=4, shard_words=400).select("shard").distinct().count()
    assert got > 3
    rows = sharding.kd_shards(docs, shards=3, block_rows=10).collect()
    for k in range(3):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))


def test_packing_takes_any_tokenizer(make):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["two  spaces\n\nand lines", "x", None, "don't 12 \t é"]
    rows = packing.pack(make(list(enumerate(texts))), path, end_id=0, length=64, keep_ids=True).collect()
    for i, t in enumerate(texts):
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)])
        assert ids.tolist() == Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids + [0]
