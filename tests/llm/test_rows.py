"""Pipeline stages on rows that share an id or have none: each row counts."""

import random
import re
from collections import Counter

from spanforge.llm import mixing, shingles, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdef") for _ in range(rnd.randint(3, 6))) for _ in range(n))


def mixed_rows():
    return [(i, prose(i, 30)) for i in range(30)] + [(7, prose(200 + i, 30)) for i in range(3)] + [(8, prose(300, 30))] * 3 + [(None, prose(400 + i, 30)) for i in range(9)] + [(None, None)]


def test_mixed_docs_take_each_row_by_its_own_decision(make):
    docs = make(mixed_rows(), extra=True)
    want: Counter = Counter()
    for r in mixing.mix(docs, block=4).collect():
        want[r.doc_id] += r.taken
    out = mixing.mixed_docs(docs, block=4)
    assert out.columns == docs.columns
    got: Counter = Counter()
    times: Counter = Counter()
    for r in out.collect():
        got[r.doc_id] += len(WORD.findall(r.text or ""))
        times[r.doc_id, r.text] += 1
        assert r.n_chars == (None if r.text is None else len(r.text))
    assert {k: v for k, v in want.items() if v} == dict(got) and got[None]
    rows = Counter(mixed_rows())
    for (i, t), n in times.items():  # whole texts come 3 times a row at most
        assert n <= 3 * max(rows[i, t], 1)


def test_mixed_docs_do_not_depend_on_the_partitioning(make):
    docs = make(mixed_rows())
    one, two = (sorted(map(str, mixing.mixed_docs(docs.repartition(n), block=4).collect())) for n in (1, 3))
    assert one == two


def test_one_of_each_decides_by_row(make):
    base, lone = prose(1, 80), [prose(500 + i, 60) for i in range(5)]
    near = base + " another"
    rows = [(20, base), (20, base), (21, near)]  # one group, two rows of it alike
    rows += [(None, near), (None, lone[0]), (None, lone[1])]  # a near copy, and clean texts without an id
    rows += [(30, lone[2]), (30, lone[3]), (31, lone[3])]  # one id, two texts, one of them copied
    rows += [(None, lone[4]), (None, lone[4]), (None, None), (40, "")]
    docs = make(rows, extra=True)
    kept = shingles.one_of_each(docs)
    assert kept.columns == docs.columns
    want = [(20, base), (None, lone[0]), (None, lone[1]), (30, lone[2]), (30, lone[3]), (None, lone[4]), (None, None), (40, "")]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(want)
    cut = substrings.cut_docs(docs.sparkSession.createDataFrame(kept.collect(), docs.schema))
    assert base in {r.text for r in cut.collect()}  # repeated rows no longer cut each other out
    assert shingles.one_of_each(make([])).count() == 0
