"""Reports of small results (F23, K17): text from rows that already fit a screen."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that a report shows unless more are asked for; it says how many it leaves out.
MOST_ROWS = 200


def first_rows(rows: DataFrame, most: int) -> tuple[list, int]:
    """The first rows, and how many there are besides."""
    got = rows.limit(most + 1).collect()
    return got[:most], 0 if len(got) <= most else rows.count() - most


def diagram(edges: DataFrame, focus: str, most: int = MOST_ROWS) -> str:
    """A Mermaid graph of the edges (src, dst, type), the focus marked; a comment says how many are left out."""
    rows, more = first_rows(edges.select("src", "dst", "type").distinct().orderBy("src", "dst", "type"), most)
    clean = lambda x: "".join(c for c in x if c.isalnum())
    nodes = sorted({x for r in rows for x in (r["src"], r["dst"])})
    quote = lambda x: x.replace('"', "'")
    lines = ["```mermaid", "graph TD", *[f'    {clean(n)}["{quote(n)}"]' for n in nodes], *[f"    {clean(r['src'])} -->|{r['type']}| {clean(r['dst'])}" for r in rows]]
    if focus in nodes:
        lines.append(f"    style {clean(focus)} stroke-width:3px")
    if more:
        lines.append(f"    %% {more} more edges")
    return "\n".join([*lines, "```"])


def search_report(results: DataFrame, snippet: int = 300, most: int = MOST_ROWS) -> str:
    """Numbered results with their score and the begin of their text, if there is one; the last line says how many
    are left out."""
    rows, more = first_rows(results.orderBy("rank"), most)
    text = "text" in results.columns
    lines = [f"{r['rank']}. {r['path']} ({r['score']:.4f})" + (f"\n   {(r['text'] or '')[:snippet]}" if text else "") for r in rows]
    return "\n".join([*lines, *([f"... and {more} more"] if more else [])]) or "No results."


def to_json(results: DataFrame, most: int | None = None) -> str:
    """All rows, or the first ones if that is asked for."""
    return "[" + ",".join((results if most is None else results.limit(most)).toJSON().collect()) + "]"
