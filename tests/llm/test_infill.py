"""Fill-in-the-middle against a row-by-row version and an exact round trip."""

import hashlib
import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from spanforge.llm import infill


def brute(doc_id, text, seed=7, rate=100, spm_rate=50):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    form = "spm" if h4 % 100 < spm_rate else "psm"
    return n, form, len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"


TEXTS = ["", "\n", "\n\n\n", "a", "a\n", "é\nß中\n😀", "<P", ">x\n<", "<P>", "a<S>b", "x<M>\n", "<", "P>", "<X>\n<Q>", "a\r\nb c\n", "<P\n>", "x" * 3000 + "\n" + "y" * 2000]


def rows():
    out = [(i, t) for i, t in enumerate(TEXTS * 3)]
    return [*out, (1, "a\nb\nc\n"), (1, "a\nb\nc\n"), (None, "q\nr\n"), (None, None), (99, None), (100, "l\n" * 5000)]


def test_equals_rows_one_by_one(make):
    for how in ({}, {"seed": 3, "rate": 40, "spm_rate": 80}):
        out = infill.restored(infill.fill_in_middle(make(rows(), extra=True), **how)).collect()
        got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out), key=repr)
        assert got == sorted(((i, *brute(i, t, **how)) for i, t in rows()), key=repr)
        assert sorted(r.restored for r in out) == sorted(t or "" for _, t in rows())
        assert len({r.form for r in out}) == 3


def test_empty_table(make):
    assert infill.restored(infill.fill_in_middle(make([]))).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="<>PSM\nxé😀", max_size=30), min_size=1, max_size=8), st.integers(0, 3))
def test_the_kernel_on_slices_of_a_batch(texts, skip):
    import numpy as np

    array = pa.array([t.encode() for t in texts], pa.binary())[skip:]
    if not len(array):
        return
    digests = [hashlib.sha256(f"7:{i}".encode()).hexdigest() for i in range(len(array))]
    h = np.array([[int(d[8 * i : 8 * i + 8], 16) for d in digests] for i in range(4)])
    n, form, prefix, middle, output = infill.cut(array, h, 100, 50)
    for i, text in enumerate(texts[skip:]):
        want = brute(i, text)
        assert (n[i], infill.FORMS[form[i]], output[i].as_py().decode()) == (want[0], want[1], want[4])
        assert form[i] == 0 or (prefix[i], middle[i]) == want[2:4]
    assert infill.joined(output, form).to_pylist() == array.to_pylist()
