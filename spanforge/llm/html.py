"""Layout-aware rendering of HTML to text."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from html import unescape
from unicodedata import combining, east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame

from spanforge.llm.shared import steps


def names(text: str) -> frozenset[str]:
    return frozenset(text.split())


#: Element names by their part in HTML's rules.
VOID = names("area base br col embed hr img input link meta param source track wbr")
RAW = names("script style textarea title xmp iframe noembed noframes")
HIDDEN = names("head script style template noscript rp iframe noembed noframes object audio video canvas datalist param source track meta link base title colgroup col")
HEAD = names("head title base link meta style script template noscript")
BLOCK = names("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul xmp listing plaintext textarea caption")
SPACED = names("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul xmp listing")
CLOSE_P = names("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul xmp listing plaintext dd dt li")
#: Within svg and math: what only describes, is referred to, or notes in another way what is shown; elements whose
#: content is HTML again; and HTML elements that end the drawing or formula.
UNDRAWN = names("title desc defs metadata symbol clippath mask marker pattern lineargradient radialgradient filter annotation annotation-xml")
HTML_AGAIN = names("foreignobject desc title mi mo mn ms mtext annotation-xml")
BREAKOUT = names("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var")
HEADINGS = names("h1 h2 h3 h4 h5 h6")
#: A start tag of the key closes open elements of the first set, up to one of the second.
IMPLIED = {
    "li": (names("li"), names("ul ol menu dir table td th")),
    "dt": (names("dt dd"), names("dl table td th")),
    "dd": (names("dt dd"), names("dl table td th")),
    "option": (names("option"), names("select datalist optgroup")),
    "optgroup": (names("option optgroup"), names("select")),
    "tr": (names("tr td th caption colgroup"), names("table thead tbody tfoot")),
    "td": (names("td th"), names("tr table")),
    "th": (names("td th"), names("tr table")),
    "thead": (names("thead tbody tfoot tr td th caption colgroup"), names("table")),
    "tbody": (names("thead tbody tfoot tr td th caption colgroup"), names("table")),
    "tfoot": (names("thead tbody tfoot tr td th caption colgroup"), names("table")),
    "caption": (names("caption"), names("table")),
    "rt": (names("rt rp"), names("ruby")),
    "rp": (names("rt rp"), names("ruby")),
}
#: End tags of other elements don't reach beyond these.
WALLS = names("table td th caption html template button object")
TABLE_PARTS = names("table thead tbody tfoot tr td th caption")

TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
GAP = re.compile(r"[ \t\n\r\f]+")
DISPLAY = re.compile(r"(?i)(?:^|;)\s*display\s*:\s*([a-z-]+)\s*(!\s*important)?")
VISIBILITY = re.compile(r"(?i)(?:^|;)\s*visibility\s*:\s*(visible|initial|hidden|collapse)")
SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
KEEP_SPACE = re.compile(r"(?i)(?:^|;)\s*white-space\s*:\s*(?:pre|break-spaces)")
#: Kinds of input whose value isn't shown as text.
VALUELESS = names("hidden password checkbox radio file image range color")
#: Elements nested deeper become siblings, as in browsers; a table column is padded to this at most.
DEEPEST, WIDEST, GUTTER = 400, 80, "  "


class Node:
    """An element; veiled: its own text is not visible, foreign: its children are of svg or math."""

    __slots__ = ("tag", "attributes", "children", "veiled", "foreign")

    def __init__(self, tag: str, attributes: dict[str, str], veiled: bool = False, foreign: str = "") -> None:
        self.tag, self.attributes, self.children, self.veiled, self.foreign = tag, attributes, [], veiled, foreign


def opens_value(html: str, first: int, at: int) -> bool:
    """Whether the character at `at` follows an equals sign, white space between."""
    at -= 1
    while at >= first and html[at] in " \t\n\r\f":
        at -= 1
    return at >= first and html[at] == "="


def tokens(html: str, drawn: Callable[[], bool] = lambda: False) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): kinds are text, raw (text as it stands), start and end.

    drawn tells whether the place that has been reached is within svg or math, where `<![CDATA[` begins text."""
    at, n = 0, len(html)
    while at < n:
        cut = html.find("<", at)
        if cut < 0:
            yield "text", html[at:], ""
            return
        if cut > at:
            yield "text", html[at:cut], ""
        if html.startswith("<!--", cut):
            end = html.find("-->", cut + 2)
            at = n if end < 0 else end + 3
        elif html.startswith("<![CDATA[", cut) and drawn():
            end = html.find("]]>", cut)
            yield "raw", html[cut + 9 : n if end < 0 else end], ""
            at = n if end < 0 else end + 3
        elif html.startswith(("<!", "<?"), cut):
            end = html.find(">", cut)
            at = n if end < 0 else end + 1
        elif m := TAG.match(html, cut):
            end = m.end()
            unclosed = ""  # quotes that don't come again, so that the page is searched to its end for each once only
            while (s := STOP.search(html, end)) and s[0] != ">":
                close = -1 if s[0] in unclosed else html.find(s[0], s.end())
                unclosed += s[0] if close < 0 else ""
                # A quote that opens no value, or never closes, is an ordinary character.
                end = close + 1 if close >= 0 and opens_value(html, m.end(), s.start()) else s.end()
            at = s.end() if s else n
            name = m[1].lower()
            if html[cut + 1] == "/":
                yield "end", name, ""
                continue
            yield "start", name, html[m.end() : at - 1]
            if name == "plaintext":
                yield "raw", html[at:], ""
                return
            if name in RAW:
                end = re.compile(rf"(?i)</{re.escape(name)}(?=[\s/>]|$)").search(html, at)
                stop = end.start() if end else n
                yield ("text" if name in ("textarea", "title") else "raw"), html[at:stop], ""
                at = stop
        else:
            yield "text", "<", ""
            at = cut + 1


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def veiled(tag: str, a: dict[str, str], parent: Node) -> bool:
    """Visibility is inherited, and a descendant can set it back."""
    own = VISIBILITY.findall(a["style"])[-1:] if "style" in a else []
    if not own and parent.foreign and "visibility" in a:
        own = [a["visibility"].strip()]
    value = own[0].lower() if own else "hidden" if tag == "mphantom" else ""
    return value in ("hidden", "collapse") or value not in ("visible", "initial") and parent.veiled


def tree(html: str) -> Node:
    root = Node("html", {})
    stack = [root]

    def close(which: frozenset[str], upto: frozenset[str]) -> None:
        """Pop to the outermost open element of `which` that stands above the nearest of `upto`."""
        found = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in upto:
                break
            if stack[i].tag in which:
                found = i
        if found:
            del stack[found:]

    for kind, name, rest in tokens(html, lambda: bool(stack[-1].foreign)):
        if kind in ("text", "raw") and stack[-1].tag != "title" and (stack[-1].veiled or stack[-1].foreign == "svg" and all(x.tag != "text" for x in stack)):
            continue
        if kind == "text":
            stack[-1].children.append(unescape(name) if "&" in name else name)
        elif kind == "raw":
            stack[-1].children.append(name)
        elif kind == "start":
            if name in ("html", "body") and any(x.tag == name for x in stack):
                continue
            while stack[-1].foreign and name in BREAKOUT:
                stack.pop()
            if name not in HEAD:
                close(names("head"), frozenset())  # a head ends where the body's content begins
            if name in CLOSE_P:
                close(names("p"), WALLS | {"li", "dd", "dt"} if name not in ("li", "dd", "dt") else WALLS)
            if name in HEADINGS and stack[-1].tag in HEADINGS:
                stack.pop()
            if name in IMPLIED:
                close(*IMPLIED[name])
            if name in ("button", "a", "nobr") and any(x.tag == name for x in stack):
                close(frozenset([name]), WALLS - {name})
            a, parent = attributes(rest) if rest.strip(" /\n\t\r\f") else {}, stack[-1]
            foreign = name if name in ("svg", "math") else "" if name in HTML_AGAIN else parent.foreign
            node = Node(name, a, veiled(name, a, parent), foreign)
            parent.children.append(node)
            closed = (parent.foreign or foreign) and SELF_CLOSED.search(rest)
            if name not in VOID and not closed and len(stack) < DEEPEST:
                stack.append(node)
        else:
            if name == "br" or name == "p" and not any(x.tag == "p" for x in stack):
                stack[-1].children.append(Node(name, {}))
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == name or name in HEADINGS and stack[i].tag in HEADINGS:
                    del stack[i:]
                    break
                if stack[i].tag in WALLS and (name not in TABLE_PARTS or stack[i].tag == "table"):
                    break
    return root


def displayed(style: str) -> str:
    """The value of display that holds: the last one, or the last important one; empty if there is none."""
    found = DISPLAY.findall(style)
    return ([v for v, important in found if important] or [v for v, _ in found] or [""])[-1].lower()


def shown(node: Node, parent: Node | None) -> bool:
    a = node.attributes
    if node.tag in HIDDEN:
        return False
    display = displayed(a["style"]) if a and "style" in a else ""
    if display == "none" or "hidden" in a and not display:  # an author's display overrides the attribute
        return False
    if parent is not None and parent.foreign and (node.tag in UNDRAWN or a.get("display", "").strip().lower() == "none"):
        return False
    if node.tag == "dialog" and "open" not in a:
        return False
    return not (parent is not None and parent.tag == "details" and "open" not in parent.attributes and node.tag != "summary")


class Page:
    """Lines of text: words flow into the current line, blocks break it, margins collapse to one empty line."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = self.space = False
        self.mark = ""

    def text(self, text: str, keep: bool) -> None:
        if keep:
            first, *rest = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            self.word(first)
            for line in rest:
                self.newline()
                self.word(line)
            return
        if not (bare := text.strip(" \t\n\r\f")):
            self.space = self.space or bool(text)
            return
        self.space = self.space or text[0] in " \t\n\r\f"
        self.word(GAP.sub(" ", bare))
        self.space = text[-1] in " \t\n\r\f"

    def word(self, text: str) -> None:
        if text:
            if self.space and self.now:
                self.now.append(" ")
            self.space = False
            self.now.append(text)

    def newline(self) -> None:
        """End the current line, even an empty one."""
        self.put("".join(self.now))
        self.now, self.space = [], False

    def put(self, line: str) -> None:
        if self.mark and line.strip():
            line, self.mark = self.mark + line, ""
        if self.gap and line.strip():
            if self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = False
        self.lines.append(line.rstrip())

    def block(self, spaced: bool) -> None:
        if self.now:
            self.newline()
        self.space = False
        self.gap = self.gap or spaced

    def done(self) -> list[str]:
        self.block(False)
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        while lines and not lines[0]:
            lines.pop(0)
        return lines


def indented(lines: list[str], first: str, rest: str) -> list[str]:
    return [(rest if i else first) + x if x else x for i, x in enumerate(lines)]


def flow(node: Node, page: Page, keep: bool, depth: int) -> None:
    for child in node.children:
        if isinstance(child, str):
            if node.tag != "details" or "open" in node.attributes:
                page.text(child, keep)
        elif shown(child, node):
            element(child, page, keep, depth)


def inner(node: Node, keep: bool, depth: int) -> list[str]:
    page = Page()
    flow(node, page, keep, depth)
    return page.done()


def element(node: Node, page: Page, keep: bool, depth: int) -> None:
    tag, a = node.tag, node.attributes
    if tag == "br":
        page.newline()
    elif tag == "input":
        shows = a.get("value") if a.get("type", "").lower() not in VALUELESS else None
        if shows and not node.veiled:
            page.text(shows, False)
    elif tag == "q" and not node.veiled:
        page.word("“")
        flow(node, page, keep, depth)
        page.space = False
        page.word("”")
    elif node.foreign == "svg" and (tag == "text" or tag == "tspan" and a.keys() & {"x", "y", "dy"}):
        page.space = True  # a label of its own
        flow(node, page, keep, depth)
        page.space = True
    elif tag == "table":
        page.block(True)
        for line in table(node, depth + 1):
            page.put(line)
        page.block(True)
    elif tag in ("ul", "ol", "menu", "dir"):
        page.block(depth == 0)
        down = tag == "ol" and "reversed" in a
        items = sum(not isinstance(c, str) and c.tag == "li" for c in node.children) if down else 1
        number = int(a["start"]) if re.fullmatch(r"-?\d{1,9}", a.get("start", "")) else items
        for child in node.children:
            if isinstance(child, str):
                page.text(child, keep)
            elif shown(child, node):
                if child.tag != "li":
                    element(child, page, keep, depth + 1)
                    continue
                value = child.attributes.get("value", "")
                number = int(value) if re.fullmatch(r"-?\d{1,9}", value) else number
                mark = f"{number}. " if tag == "ol" else "- "
                page.block(False)
                for line in indented(inner(child, keep, depth + 1), mark, " " * len(mark)):
                    page.put(line)
                number += -1 if down else 1
        page.block(depth == 0)
    elif tag in ("blockquote", "dd"):
        page.block(tag in SPACED)
        for line in indented(inner(node, keep, depth), "  ", "  "):
            page.put(line)
        page.block(tag in SPACED)
    else:
        block = tag in BLOCK or tag == "math" and a.get("display", "").lower() == "block"
        if block:
            page.block(tag in SPACED)
        if tag in ("pre", "listing", "textarea") and node.children and isinstance(node.children[0], str):
            node.children[0] = re.sub(r"^\r?\n", "", node.children[0])
        keep = keep or tag in ("pre", "listing", "textarea", "xmp", "plaintext") or "style" in a and bool(KEEP_SPACE.search(a["style"]))
        flow(node, page, keep, depth)
        if block:
            page.block(tag in SPACED)


def wide(text: str) -> int:
    """Columns that a text takes: two for wide characters, none for marks that join the one before."""
    return len(text) if text.isascii() else sum(0 if combining(c) else 2 if east_asian_width(c) in "WF" else 1 for c in text)


def span(a: dict[str, str], name: str, most: int) -> int:
    value = a.get(name, "1").strip()
    return min(most, max(1, int(value))) if re.fullmatch(r"\d{1,9}", value) else 1


def table(node: Node, depth: int) -> list[str]:
    """Rows of cells in columns that are padded to the widest cell of the column, up to WIDEST; nothing is cut."""
    captions: list[str] = []
    rows: list[list[tuple[int, list[str]]]] = []
    below: dict[int, int] = {}  # rows that a cell above still covers, by column

    def row(cells: Node) -> None:
        out, column = [], 0
        for cell in cells.children:
            if isinstance(cell, str):
                if cell.strip():
                    captions.extend(" ".join(x.split()) for x in [cell])
                continue
            if not shown(cell, cells):
                continue
            while below.get(column, 0) > 0:
                column += 1
            out.append((column, inner(cell, False, depth)))
            wide, high = span(cell.attributes, "colspan", 1000), span(cell.attributes, "rowspan", 65534)
            if high > 1:
                below.update({c: high for c in range(column, column + wide)})
            column += wide
        for c in list(below):
            below[c] -= 1
            if below[c] <= 0:
                del below[c]
        rows.append(out)

    def part(x: Node) -> None:
        for child in x.children:
            if isinstance(child, str):
                if child.strip():  # text outside the cells stands before the table
                    captions.append(" ".join(child.split()))
            elif shown(child, x):
                if child.tag == "tr":
                    row(child)
                elif child.tag in ("thead", "tbody", "tfoot"):
                    part(child)
                elif child.tag in ("td", "th"):
                    one = Node("tr", {})
                    one.children.append(child)
                    row(one)
                else:
                    captions.extend(inner(child, False, depth))

    part(node)
    width: dict[int, int] = {}
    for cells in rows:
        for i, (column, lines) in enumerate(cells):
            if i + 1 < len(cells):
                width[column] = max(width.get(column, 0), *(min(WIDEST, wide(x)) for x in lines or [""]))
    left: dict[int, int] = {}
    total = 0
    for column in sorted(set(width) | {c for cells in rows for c, _ in cells}):
        left[column] = total
        total += width.get(column, 0) + len(GUTTER) if width.get(column) else 0
    out = captions
    for cells in rows:
        for i in range(max((len(x) for _, x in cells), default=0)):
            line = ""
            for column, lines in cells:
                if i < len(lines) and lines[i]:
                    line += GUTTER if wide(line) > left[column] - len(GUTTER) and line else ""
                    line += " " * (left[column] - wide(line)) + lines[i]
            out.append(line.rstrip())
    return out


def title(node: Node) -> str | None:
    todo = [node]
    while todo:
        x = todo.pop()
        if x.tag == "title":
            return " ".join("".join(c for c in x.children if isinstance(c, str)).split())
        todo += [c for c in reversed(x.children) if isinstance(c, Node) and c.tag not in ("svg", "body")]
    return None


def render(html: str | None) -> tuple[str | None, str]:
    """Title and visible text of a page; null or without markup: as plain inline text."""
    root = tree(html or "")
    page = Page()
    flow(root, page, False, 0)
    return title(root), "\n".join(page.done())


@functools.cache
def deep() -> None:
    import sys

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10 * DEEPEST))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, title (null if none), text, n_chars and n_lines of every page.

    Null and empty pages give an empty text. Ids may be null or repeat, and rows that are alike give rows that are
    alike; other columns, whatever their names, are not read. Text between the cells of a table stands before the
    table, where browsers put it. An empty table gives no rows. No shuffle; time and memory go with the length of a page, and a very long one is
    a step of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deep()
        for batch in steps(batches, 1):
            got = [render(x) for x in batch.column(1).to_pylist()]
            texts = [t for _, t in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in got], pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())], ["id", "title", "text", "n_chars", "n_lines"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(pages[id_col].alias("id"), pages[html_col].alias("html")).mapInArrow(run, f"id {kind}, title string, text string, n_chars bigint, n_lines bigint").withColumnRenamed("id", id_col)
