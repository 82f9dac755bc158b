"""Best-fit packing: the library's ids, exact places, few sequences."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers

from spanforge.llm import bestfit, bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6))) for _ in range(n))


def test_ids_equal_the_library(spark):
    rnd = random.Random(5)
    some = [" ", " ", "\n", "\t", "\r", "a", "Bc", "'s", "'", "'ll", "1", "29", ".", "é", "÷", "ß", "中", " ", "　", "\x1c", "\x85", "<|endoftext|>", "😀", "\x00", " "]
    encode, width = bpe.encoder(PATH)
    for _ in range(3000):
        text = "".join(rnd.choice(some) for _ in range(rnd.randint(0, 12)))
        assert np.frombuffer(encode(text.encode()), width).tolist() == bpe.tokenizer(PATH).encode(text, add_special_tokens=False).ids, text
    long = (prose(rnd, 400) + "\n\n  xé ") * 3
    parts = list(bpe.parts(long.encode(), 100))
    assert len(parts) > 20 and b"".join(parts) == long.encode()
    assert b"".join(map(encode, parts)) == encode(long.encode())


def check(rows, docs, length=2048):
    """Every id in exactly one piece, cut only where it must be, places without gaps; the number of sequences."""
    want = Counter()
    for doc_id, text in docs:
        ids = bpe.tokenizer(PATH).encode(text or "", add_special_tokens=False).ids + [0]
        cuts = [0, *range(len(ids) % length or length, len(ids) + 1, length)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for at in by.values():
        end = 0
        for offset, size in sorted(at):
            assert offset == end
            end += size
        assert end <= length
    return len(by)


def test_packs_all_rows(make):
    rnd = random.Random(1)
    docs = [(i, prose(rnd, int(min(rnd.lognormvariate(4.5, 1), 3000)))) for i in range(300)]
    docs += [(7, docs[7][1])] * 3 + [(None, docs[9][1])] * 40 + [(None, None), (400, ""), (401, prose(rnd, 9000))]
    rows = bestfit.pack(make(docs, extra=True), PATH).collect()
    total = sum(r.length for r in rows)
    assert check(rows, docs) <= math.ceil(total / 2048) * 1.02 + 1
    rows = bestfit.pack(make(docs[:40]), PATH, length=64, keep_ids=True).collect()
    check(rows, docs[:40], 64)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    assert bestfit.pack(make([]), PATH).collect() == []


def test_knapsack_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        price = np.where(rng.random(40) < 0.3, rng.random(40), -1.0)
        best, choice = bestfit.knapsack(price)
        want = [0.0] * 40
        for room in range(1, 40):
            want[room] = max([want[room - 1], *(price[s] + want[room - s] for s in range(1, room + 1) if price[s] > 0)])
        assert np.allclose(best, want)
        made = bestfit.chosen(choice, 39)
        assert bestfit.filled(tuple(made.items())) <= 39 and math.isclose(sum(price[s] * k for s, k in made.items()), best[39])


def test_the_program_is_rounded_near_its_bound():
    rng = np.random.default_rng(3)
    for lengths, off in ((rng.lognormal(4, 1, 20000), 1.004), (rng.integers(30, 50, 3000), 1.05), (np.full(1000, 97), 1.0), (rng.integers(1, 256, 5000), 1.03), (np.array([1]), 1.0)):
        counts = Counter(np.clip(lengths.astype(int), 1, 255).tolist())
        amounts, bound = bestfit.solve(counts, 256)
        groups = bestfit.rounded(counts, amounts, 256)
        held = Counter()
        for config, k in groups:
            assert bestfit.filled(config) <= 256
            for size, often in config:
                held[size] += often * k
        assert held == counts
        assert bound - 1e-6 <= sum(k for _, k in groups) <= math.ceil(bound * off) + 1, (bound, sum(k for _, k in groups))


def test_places_of_every_rank():
    groups = [(((5, 2), (3, 1)), 3), (((5, 1),), 2), (((3, 4),), 1)]
    places = bestfit.Places(groups)
    sequence, offset = places.of(np.array([5] * 8 + [3] * 7), np.array([*range(8), *range(7)]))
    assert sorted(zip(sequence.tolist(), offset.tolist(), strict=True)) == sorted([(s, o) for s in range(3) for o in (0, 5, 10)] + [(3, 0), (4, 0)] + [(5, o) for o in (0, 3, 6, 9)])
