"""Fill-in-the-middle: documents cut at two line ends and written in another order, whole batches at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.shared import steps

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

#: Classes of bytes.
NEWLINE, CONTINUES, OPENS, LETTER, CLOSES = 1, 2, 4, 8, 16


def classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[ord("\n")] = NEWLINE
    table[0x80:0xC0] = CONTINUES  # all but the first byte of a code point
    table[ord("<")], table[ord(">")] = OPENS, CLOSES
    table[[ord(c) for c in "PSM"]] = LETTER
    return table


CLASSES = classes()


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of texts without nulls, the offsets from 0; nothing is copied but a shift of the offsets."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def spans(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    """The runs of bytes between neighbouring offsets, as an array that shares data."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(data)])


def markers(kinds: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, row) of each marker: three neighbouring bytes of these classes within one row."""
    at = np.flatnonzero((kinds[:-2] & OPENS).astype(bool) & (kinds[1:-1] & LETTER).astype(bool) & (kinds[2:] & CLOSES).astype(bool))
    row = np.searchsorted(offsets, at, "right") - 1
    inside = at + 3 <= offsets[row + 1]
    return at[inside], row[inside]


def counts_before(mask: np.ndarray) -> np.ndarray:
    """How many are set before each place, and in all."""
    out = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=out[1:], dtype=np.int32)
    return out


def cut(texts: pa.Array, h: np.ndarray, rate: int, spm_rate: int) -> tuple[np.ndarray, ...]:
    """(lines, form, prefix characters, middle characters, output): of all rows of a batch at once.

    h: four rows of hashes. Forms: 0 plain, 1 psm, 2 spm.
    """
    offsets, data = buffers(texts)
    start, end = offsets[:-1], offsets[1:]
    kinds = CLASSES[data]
    # A line begins where a row does and after each line end; the running count is set back at each row's start.
    begins = np.zeros(len(data), bool)
    begins[1:] = (kinds[:-1] & NEWLINE).astype(bool)
    begins[start[start < end]] = True
    lines = counts_before(begins)
    n = (lines[end] - lines[start]).astype(np.int64)
    plain = (n == 0) | (h[2] % 100 >= rate)
    plain[markers(kinds, offsets)[1]] = True
    form = np.where(plain, 0, np.where(h[3] % 100 < spm_rate, 2, 1))

    one, two = h[0] % (n + 1), h[1] % (n + 1)
    cuts = np.empty((len(n), 3), np.int32)  # where the prefix, the middle and the row end
    del begins
    for i, k in enumerate((np.minimum(one, two), np.maximum(one, two))):
        # The place before which k + 1 lines of the row have first begun starts line k + 1; past the last, the row ends.
        cuts[:, i] = np.minimum(np.searchsorted(lines, (lines[start] + k + 1).astype(np.int32)) - 1, end)
    cuts[:, 2] = end
    cuts[plain, :2] = end[plain, None]
    points = counts_before((kinds & CONTINUES) == 0)
    prefix_chars = points[cuts[:, 0]] - points[start]
    middle_chars = points[cuts[:, 1]] - points[cuts[:, 0]]
    del lines, points, kinds

    part = spans(np.concatenate([[0], cuts.reshape(-1)]), data)  # prefix, middle and suffix of each row in turn
    base = np.arange(len(n)) * 3
    spm = form == 2
    first, second = (part.take(pa.array(base + np.where(spm, a, b))) for a, b in ((2, 0), (0, 2)))
    sign = lambda x, y: pa.array([b"", x, y], pa.binary()).take(pa.array(form))
    output = pc.binary_join_element_wise(sign(PREFIX, SUFFIX), first, sign(SUFFIX, PREFIX), second, sign(MIDDLE, MIDDLE), part.take(pa.array(base + 1)), pa.scalar(b"", pa.binary()))
    return n, form, prefix_chars, middle_chars, output


def joined(output: pa.Array, form: np.ndarray) -> pa.Array:
    """The texts again, from the outputs and their forms (0 plain, 1 psm, 2 spm)."""
    offsets, data = buffers(output)
    at, row = markers(CLASSES[data], offsets)
    at = at[form[row] > 0]
    if len(at) != 3 * int((form > 0).sum()):
        raise ValueError("an output without its three markers")
    # Six bounds a row: before and after each marker; plain rows have all of them at their end.
    edges = np.repeat(offsets[1:, None], 6, axis=1)
    at = at.reshape(-1, 3)
    edges[form > 0] = np.stack([at, at + 3], axis=2).reshape(-1, 6)
    part = spans(np.concatenate([[0], np.column_stack([edges, offsets[1:]]).reshape(-1)]), data)
    base = np.arange(len(form)) * 7
    # Runs 0 (a plain row's text), 2, 4 and 6 of a row hold text, 1, 3 and 5 the markers.
    order = np.array([[0, 2, 4, 6], [2, 6, 4, 0], [4, 6, 2, 0]])[form]
    return pc.binary_join_element_wise(*[part.take(pa.array(base + order[:, i])) for i in range(4)], pa.scalar(b"", pa.binary()))


FORMS = ["plain", "psm", "spm"]


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): each text cut into prefix, middle and suffix at line ends.

    Where to cut, whether (in `rate` of a hundred cases) and in which order follow from the SHA-256 of the seed and the
    id, so reruns agree. One numpy kernel for all rows of an Arrow batch: bytes get classes, line starts come from
    neighbouring bytes, running counts set back at each row pick the cuts, which become the offsets of an array of
    parts that shares the texts' buffer.

    Null and empty texts, and those that hold a marker, are plain: the text as it is, with null counts of characters.
    A null id counts as the empty string; repeated rows are cut alike. Other columns are not read. An empty table gives
    no rows. A batch is about 1 MB, a longer text one of its own, in memory of some 20 times its bytes.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_col].cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(4)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 1):
            texts = batch.column(1).cast(pa.binary())
            texts = pc.fill_null(texts, b"") if texts.null_count else texts
            hashes = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6)])
            n, form, prefix, middle, output = cut(texts, hashes, rate, spm_rate)
            plain = form == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(FORMS).take(pa.array(form)), *[pa.array(x.astype(np.int64), mask=plain) for x in (prefix, middle)], output.cast(pa.string())],
                ["id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), *h).mapInArrow(work, schema).withColumnRenamed("id", id_col)


def restored(rows: DataFrame, name: str = "restored") -> DataFrame:
    """rows (form, output and others) with the text that was cut, rebuilt from these two alone."""
    kept = [c for c in rows.columns if c != "output"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = len(kept)
        for batch in steps(batches, at):
            form = pc.index_in(batch.column(kept.index("form")), value_set=pa.array(FORMS)).to_numpy(zero_copy_only=False)
            text = joined(batch.column(at).cast(pa.binary()), form)
            yield pa.RecordBatch.from_arrays([*batch.columns, text.cast(pa.string())], [*kept, "output", name])

    out = rows.select(*kept, "output")
    return out.mapInArrow(work, out.withColumn(name, F.lit("")).schema)


def digests(rows: DataFrame, **of: Column) -> DataFrame:
    """rows with the SHA-256 of columns, in hexadecimal digits, in place of their texts."""
    return rows.select(*[c for c in rows.columns if c not in ("output", "restored")], *[F.sha2(c.cast("binary"), 256).alias(n) for n, c in of.items()])


#: The same in SQL, with seed 7.
SQL = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    c AS (SELECT *, len(u)::BIGINT AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || h[i:i + 7])::BIGINT) AS k FROM d),
    p AS (SELECT *, least(k[1] % (n + 1), k[2] % (n + 1)) AS a, greatest(k[1] % (n + 1), k[2] % (n + 1)) AS b,
      CASE WHEN n = 0 OR regexp_matches(t, '<[PSM]>') THEN 'plain' WHEN k[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c),
    x AS (SELECT *, array_to_string(u[1:a], '') AS f, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM p)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(f)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
      sha256(CASE form WHEN 'psm' THEN '<P>' || f || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || f || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM x
"""
