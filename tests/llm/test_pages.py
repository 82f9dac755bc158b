"""HTML rendering on known pages, WARC archives by a round trip."""

import gzip
import hashlib
from pathlib import Path

import pytest

from spanforge.llm import html, shared, warc

PAGES = {
    "<p>a <b>b</b>c<p>d": "a bc\n\nd",
    "<ul><li>x<li>y<ol start=3><li>1<li>2</ol></ul>tail<br>z": "- x\n- y\n  3. 1\n  4. 2\n\ntail\nz",
    "<table><tr><td>aa<td>b<tr><td>c<td>dd<td>e</table>": "aa  b\nc   dd  e",
    "<table><tr><th rowspan=2>R<td>1<tr><td>2</table>": "R  1\n   2",
    "<table><tr><td colspan=2>wide one<td>z<tr><td>a<td>b<td>c</table>": "wide one     z\na         b  c",
    "a<div style='display: none'>no</div><span hidden>no</span><div style='visibility:hidden'>no</div>b": "a\nb",
    "<script>var x='</p>'</script><style>p{}</style><template>t</template>x": "x",
    "<pre>\n a\n  b</pre>": " a\n  b",
    "<details><summary>S</summary>hid</details><details open><summary>T</summary>seen</details>": "S\nT\nseen",
    "&lt;x&gt; 5 < 6 &amp; &copy;": "<x> 5 < 6 & ©",
    "<a href='x>y'>l</a> <a title=\"'\">m</a>": "l m",
    "<h1>H</h1>\n<div>a<div>b</div>c</div>": "H\n\na\nb\nc",
    "<blockquote>q<p>r</blockquote>s": "  q\n\n  r\n\ns",
    "plain  text\n\nhere": "plain text here",
    "<b>never closed": "never closed",
    "<a b='x": "",
    "": "",
    "<dl><dt>t<dd>d</dl>": "t\n  d",
    "<q>said</q> <input type=submit value=Go><input type=hidden value=no>": "“said” Go",
    "<head><title>T</title><p>body": "body",
    "x<!-- <b>no</b> -->y<!doctype html>z": "xyz",
}


@pytest.mark.parametrize(("page", "text"), PAGES.items())
def test_rendering(page, text):
    assert html.render(page)[1] == text


def test_titles_and_depth():
    html.deep()
    assert html.render("<title> A &amp;\n B </title>x") == ("A & B", "x")
    assert html.render("<div>" * 5000 + "deep")[1] == "deep"
    assert html.render("<table><tr><td>" * 300 + "deep")[1] == "deep"
    assert html.render("<p>" + "word " * 200_000)[1].count("word") == 200_000


def test_extract(spark):
    rows = [(1, "<p>x", "u"), (2, None, "u"), (None, "", "u"), (1, "<p>x", "u")]
    df = spark.createDataFrame(rows, "page_id long, html string, url string").selectExpr("*", "'c' as text", "'d' as id")
    got = sorted((str(r.page_id), r.text, r.n_chars, r.n_lines) for r in html.extract(df).collect())
    assert got == [("1", "x", 1, 1), ("1", "x", 1, 1), ("2", "", 0, 0), ("None", "", 0, 0)]
    assert html.extract(df.limit(0)).count() == 0


def test_warc_round_trip(spark):
    big, other = "<p>" + "é" * 80, "<p>" + "o" * 150
    rows = [(i, f"http://x/{i} a\nb" if i % 3 else None, big if i % 4 == 0 else other if i % 4 == 1 else f"page {i} " * (i % 30)) for i in range(60)]
    rows += [(100, "u", None), (101, "u", ""), (102, "u", "short"), (103, "u", "short"), (None, "u", big), (104, "u", big), (104, "u", big), (105, "u", "long" * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as digest", "'y' as kind")
    folder = shared.stage_path(spark, "warc")
    files = warc.write(df, folder, roll_bytes=1500).collect()
    assert len(files) > 4 and sum(f.records for f in files) == len(rows)
    local = Path(folder.removeprefix("file:"))
    assert not [p for p in local.iterdir() if p.name.startswith("_temporary")]
    for f in files:
        raw = (local / f.name).read_bytes()
        assert hashlib.sha256(raw).hexdigest() == f.file_sha256 and gzip.decompress(raw).count(b"WARC/1.1\r\n") == f.records
    got = warc.read(spark, folder, payload=True).collect()
    first: dict = {}
    for i, _, p in rows:
        if i is not None and len((p or "").encode()) >= 100:
            first[p] = min(i, first.get(p, i))
    want = sorted((str(i), len((p or "").encode()), hashlib.sha256((p or "").encode()).hexdigest(), "revisit" if p in first and first[p] != i else "response", str(first[p]) if p in first and first[p] != i else "None") for i, _, p in rows)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == want
    assert all(hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in got if r.record_type == "response")
    again = shared.stage_path(spark, "warc")
    assert sorted((f.name, f.file_sha256) for f in warc.write(df.orderBy("html"), again, roll_bytes=1500).collect()) == sorted((f.name, f.file_sha256) for f in files)
    empty = shared.stage_path(spark, "warc")
    assert warc.write(df.limit(0), empty).count() == 0 and warc.read(spark, empty).count() == 0


def test_damage_is_found(spark):
    df = spark.createDataFrame([(1, "u", "x" * 500)], "page_id long, url string, html string")
    folder = shared.stage_path(spark, "warc")
    name = warc.write(df, folder).first().name
    path = Path(folder.removeprefix("file:")) / name
    raw = gzip.decompress(path.read_bytes()).replace(b"xxxx", b"xxxy", 1)
    path.write_bytes(gzip.compress(raw))
    with pytest.raises(Exception, match="damaged"):
        warc.read(spark, folder).collect()


def test_reruns_give_equal_archives(spark):
    """With more rows than range partitioning samples, after other jobs, and from other partitions."""
    from pyspark.sql import functions as F

    df = spark.range(100_000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 5 == 0, F.lit(7)).otherwise(F.col("id") * 7919 % 100_003).alias("page_id"), F.concat(F.lit("http://x/"), "id").alias("url"), F.repeat(F.md5(F.col("id").cast("string")), 2).alias("html"))
    made = []
    for rows in (df, df.orderBy(F.xxhash64("url")).repartition(7)):
        spark.range(10).count()
        folder = shared.stage_path(spark, "warc")
        made.append(sorted(map(tuple, warc.write(rows, folder, roll_bytes=1 << 18, level=1, part_bytes=1 << 20).collect())))
    assert made[0] == made[1] and sum(f[1] for f in made[0]) == 100_000
    parts = {}
    for name, records, *_ in made[0]:
        parts[name[:11]] = parts.get(name[:11], 0) + records
    assert 5 < len(parts) < 10 and max(parts.values()) < 25_000  # null ids and the hot id are split


def test_two_step_search(spark):
    from pyspark.sql import functions as F

    for n in (0, 1, 2, 5, 40):
        bounds = [f"{2 * i + 1:03}" for i in range(n)]
        got = spark.range(90).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("k")).select("k", warc.place(F.col("k"), bounds).alias("p")).collect()
        assert all(r.p == sum(b <= r.k for b in bounds) for r in got)
