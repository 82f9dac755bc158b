"""Token counts, quality rules, packing, mixing and sharding against brute force, and on odd input."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spanforge.llm import mixing, packing, quality, registry, sharding, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "a<|endoftext|>b <|startoftext|>"), (6, "İ é é x\u0085y\x1cz 日本 😀!! don't I'LL ½ ۱۲"), (None, "no id here"), (7, "same same"), (7, "same same"), (8, "x" * 30000), (9, "word " * 9000)]


def words_like(seed, n):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7))) + rnd.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def path():
    return registry.tokenizer_path()


def test_token_counts_equal_the_library(make, path):
    rows = ODD + [(100 + i, words_like(i, 200)) for i in range(20)]
    got = tokens.token_counts(make(rows, extra=True), path, limit=5).collect()
    t = tokens.tokenizer(path)
    want = sorted((str(i), len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows)
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 5) for r in got)
    assert tokens.token_counts(make([]), path).count() == 0


def test_other_tokenizers_fall_back_to_the_library(make):
    import public_tokenizers

    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        got = tokens.token_counts(make([(1, "Hello  world"), (2, None)]), public_tokenizers.path(name)).collect()
        assert sorted(r.n_tokens > 0 for r in got) == [False, True]


def brute_quality(text):
    ws = WORD.findall(text or "")
    c = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    cover = {j for i in range(len(ws) - 2) if c[tuple(ws[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    longest = [0] * len(ws)
    for i in range(len(ws)):
        for j in range(i + 1, len(ws)):
            n = 0
            while j + n < len(ws) and ws[i + n] == ws[j + n]:
                n += 1
            longest[i], longest[j] = max(longest[i], n), max(longest[j], n)
    spans = {k for i, n in enumerate(longest) if n >= 15 for k in range(i, i + n)}
    failed = len(ws) < 50 or 100 * len(cover) > 50 * len(ws)
    kept = not (failed or 100 * len(spans) > 30 * len(ws) or max(longest, default=0) > 200)
    return len(ws), sum(map(len, ws)), sum(x in "#*$%&|<>" for x in text or ""), dup, len(cover), failed, kept


def test_quality_equals_brute_force(make):
    part = words_like(5, 40)
    rows = [(1, None), (2, ""), (3, " \n \n"), (4, "a b c a b c"), (5, words_like(1, 80)), (6, f"{part} x y\n{words_like(2, 20)}\n{part} z"), (7, f"#a\n#a\n\n \n{words_like(3, 60)}\n#a"), (8, words_like(4, 300) + f" {part} " + words_like(6, 90) + f" {part}"), (None, "q " * 70), (5, words_like(1, 80))]
    got = {}
    for r in quality.quality(make(rows, extra=True)).collect():
        got.setdefault(str(r.doc_id), []).append((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept))
    for i, t in rows:
        assert brute_quality(t) in got[str(i)], i
    kept = quality.keep_good(make(rows, extra=True))
    assert kept.columns == make(rows, extra=True).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, t in rows if brute_quality(t)[-1])
    assert quality.quality(make([])).count() == 0


def test_packing_places_every_id_once(make, path):
    rows = ODD + [(100 + i, words_like(i % 7, 60 + 40 * i)) for i in range(40)]
    got = packing.pack(make(rows, extra=True), path, keep_ids=True, length=512).collect()
    t = tokens.tokenizer(path)
    want = Counter(str(i) + np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes().hex() for i, x in rows)
    by: dict = {}
    for r in got:
        by.setdefault((str(r.doc_id), r.doc_tokens), []).append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    singles = {k: v for k, v in by.items() if k[0] not in ("7",)}
    for (i, n), pieces in singles.items():
        pieces.sort(key=lambda r: r.start)
        whole = b"".join(r.ids for r in pieces)
        assert want[i + whole.hex()] and len(whole) == 4 * n
    assert sum(r.length for r in by[("7", 3)]) == 6  # both rows of the repeated id
    lengths: dict = {}
    for r in got:
        lengths.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in lengths.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == 512 or at & (at - 1) == 0
    assert packing.pack(make([]), path).count() == 0


def test_bm25_prefers_what_shares_terms():
    docs = [np.array(x, "<u2") for x in ([5, 6, 7, 8], [5, 6, 7, 9], [20, 21, 22, 23], [20, 21, 22, 24], [30, 31, 32, 33])]
    score = packing.Index(docs).scores(0)
    assert score[1] > score[2] == score[3] == score[4] == 0
    packer = packing.Packer(8)
    windows = [w for i, d in enumerate(docs) for w in packer.add((i, 4), d, 0)] + list(packer.rest())
    assert {x[0][0] for x in windows[0]} == {0, 1} and {x[0][0] for x in windows[1]} == {2, 3}


def brute_targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, fixed = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in fixed]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        for s in over:
            fixed[s] = 3.0 * sizes[s]
            left -= fixed[s]


def test_mixing_meets_its_targets(spark):
    rnd = random.Random(3)
    rows = [(i, words_like(i, rnd.randint(0, 80)), "en", rnd.choice(["a", "b", "c", "d", None, "é"]) if i % 10 else "tiny", 0) for i in range(400)]
    rows += [(500, None, "en", "a", None), (None, "no id", "en", "b", 0), (501, "x y", "en", "b", 0), (501, "x y", "en", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' as size", "'y' as rank")
    got = mixing.mix(docs, block=4, shard_words=500).collect()
    sizes: Counter = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = brute_targets(sizes)
    taken: Counter = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 24, (s, t, taken[s])
    again = mixing.mix(docs, block=4, shard_words=500).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_sainte_lague_equals_the_highest_quotients(spark):
    rnd = random.Random(1)
    for n in (1, 7, 60):
        shares = [rnd.randint(0, 300) for _ in range(9)]
        df = spark.createDataFrame([(i, x, n) for i, x in enumerate(shares)], "i int, share long, n long")
        got = {r.i: r.won for r in mixing.seats(df, [], "share", "n", "i", "won").collect()}
        quotients = sorted(((-x / (2 * k - 1), i) for i, x in enumerate(shares) if x for k in range(1, n + 1)))[:n]
        assert got == {i: sum(j == i for _, j in quotients) for i in range(9)}


def test_mixed_docs_take_effect(make):
    docs = make([(i, words_like(i, 30)) for i in range(60)])
    taken = {r.doc_id: r.taken for r in mixing.mix(docs, block=4).collect()}
    words: Counter = Counter()
    for r in mixing.mixed_docs(docs, block=4).collect():
        words[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert {k: v for k, v in taken.items() if v} == dict(words)


def test_kd_shards_are_even(spark):
    rnd = random.Random(2)
    rows = [(i, "copy of one text" if i % 3 == 0 else words_like(i, rnd.randint(1, 120)), rnd.choice(["en", "de", None]), f"s{rnd.randint(0, 5)}", 0) for i in range(3000)]
    rows += [(4000, None, None, None, None), (4001, "", "en", "s1", 0), (4001, "", "en", "s1", 0), (None, "x", "en", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' as node", "'y' as shard")
    got = sharding.kd_shards(docs, block_rows=20).collect()
    assert len(got) == len(rows)
    shards: dict = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r)
    total = sum(r.size for r in got)
    for k in range(24):
        assert abs(sum(r.size for r in shards[k]) - total / 24) < total / 24 * 0.05
        assert sorted(r.slot for r in shards[k]) == list(range(len(shards[k])))
    crc = Counter((r.doc_id, r.size, r.text_crc32) for r in got)
    assert crc == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sharding.kd_shards(docs.limit(0)).count() == 0
