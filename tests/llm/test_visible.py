"""Text of formulas, drawings, maps and of visible descendants of unseen elements is kept."""

import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import pytest

from spanforge.llm import html

PAGES = {
    "a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding=t>no</annotation></math> b": "a x=2 b",
    "a<math display=block><mtext>q</mtext><mphantom><mi>no</mi></mphantom></math>b": "a\nq\nb",
    "a <svg><title>no</title><desc>no</desc><defs><text>no</text></defs> stray <path d='M0'/><g><text>one</text><text>two <tspan>2</tspan></text></g></svg> b": "a one two 2 b",
    "<svg><defs/><circle r=1 /><text>seen</text><text visibility=hidden>no</text><text display='none'>no</text></svg>c": "seen c",
    "<svg><foreignObject><p>inside</p></foreignObject></svg>x": "inside\n\nx",
    "<svg><path><p>after an open svg": "after an open svg",
    "<map name=m><area href=x><p>in a map</p></map>": "in a map",
    "<div style='visibility:hidden'>no<p style='visibility: visible'>yes<q>a</q></p><input type=submit value=no><q>no</q></div>b": "yes“a”\n\nb",
    "<table style='visibility:hidden'><tr><td>no<td style='visibility:visible'>v</table>": "v",
    "<ol><li style='visibility:hidden'>no<li>two</ol>": "2. two",
    "<div style='display:none'>no<b style='visibility:visible'>no</b></div>c": "c",
    "<filter>f</filter> <desc>d</desc>": "f d",
}


@pytest.mark.parametrize(("page", "text"), PAGES.items())
def test_visible_text_is_kept(page, text):
    assert html.render(page)[1] == text


def test_the_title_is_of_the_page():
    assert html.render("<html style='visibility:hidden'><svg><title>no</title></svg><title>T</title>x")[0] == "T"


MORE = {
    "<p style='display:none;display:block'>seen</p><p style='display:block;display:none'>no</p>": "seen",
    "<p style='display:none !important;display:block'>no</p><p hidden style='display:block'>author</p><i hidden>no</i>": "author",
    "<table><tr><td>日本<td>x<tr><td>abcd<td>y<tr><td>é́<td>z</table>": "日本  x\nabcd  y\né́     z",
    "<table><tr><td>a</td>between</tr></table>": "between\na",
    "<a t= 'x>y' u=\n\"<p>\" it's>l</a>": "l",
}


@pytest.mark.parametrize(("page", "text"), MORE.items())
def test_more_rendering(page, text):
    assert html.render(page)[1] == text


def test_many_quotes_take_time_in_proportion():
    page = "<a b='x' c=\"y\" d='" * 50_000 + "<a" + " it's" * 100_000
    began = time.perf_counter()
    html.render(page)
    assert time.perf_counter() - began < 10  # copying the page at each quote took minutes


INLINE, BLOCKS, UNSEEN = ("b", "i", "span", "em"), ("div", "section", "p", "article"), ("script", "style", "template")


def random_tree(rnd, depth):
    """A tree as nested lists: a word, or (tag, attributes, children)."""
    out = []
    for _ in range(rnd.randint(1, 4)):
        kind = rnd.random()
        if depth == 0 or kind < 0.4:
            out.append(f"w{rnd.randrange(10**6)}")
        elif kind < 0.6:
            out.append((rnd.choice(INLINE), rnd.choice(["", "", " hidden"]), [x for x in random_tree(rnd, depth - 1) if isinstance(x, str) or x[0] in INLINE]))
        elif kind < 0.9:
            children = random_tree(rnd, depth - 1)
            tag = rnd.choice(BLOCKS)
            if tag == "p":
                children = [x for x in children if isinstance(x, str) or x[0] in INLINE]
            out.append((tag, rnd.choice(["", "", "", " style='display:none'"]), children))
        else:
            out.append((rnd.choice(UNSEEN), "", ["no"]))
    return out


def serial(tree):
    return " ".join(x if isinstance(x, str) else f"<{x[0]}{x[1]}>{serial(x[2])}</{x[0]}>" for x in tree)


def lines_of(tree, lines):
    """Brute force: every block breaks the line before and after it, other words are joined by spaces."""
    for x in tree:
        if isinstance(x, str):
            lines[-1].append(x)
        elif x[1] or x[0] in UNSEEN:
            continue
        elif x[0] in BLOCKS:
            lines.append([])
            lines_of(x[2], lines)
            lines.append([])
        else:
            lines_of(x[2], lines)
    return lines


def test_random_pages_equal_brute_force():
    rnd = random.Random(6)
    for _ in range(500):
        tree = random_tree(rnd, 4)
        want = [" ".join(x) for x in lines_of(tree, [[]]) if x]
        assert [x for x in html.render(serial(tree))[1].split("\n") if x] == want, serial(tree)


class Words(HTMLParser):
    """Text outside of elements that are not shown, by the standard library."""

    def __init__(self):
        super().__init__()
        self.skip, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title", "template")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title", "template")

    def handle_data(self, data):
        if not self.skip:
            self.words += re.findall(r"[^\W_]{2,}", data)


def test_generated_pages_keep_their_words(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()
    for r in pages:
        parser = Words()
        parser.feed(r.html or "")
        got = Counter(re.findall(r"[^\W_]{2,}", html.render(r.html)[1]))
        want = Counter(parser.words)
        assert not want - got, (want - got, r.html[:500])
