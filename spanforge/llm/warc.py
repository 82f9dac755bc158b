"""WARC archives: a deterministic sharded writer, and a reader that checks what it reads."""

from __future__ import annotations

import hashlib
import math
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.shared import drop, partitions, stage, steps

#: Names of the format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_HEADER = "Spanforge-Page-Id"
#: Payload bytes of a part, which one task writes; parts at most, beyond which they grow; split candidates for each part.
PART_BYTES, MOST_PARTS, FINE = 16 << 20, 1 << 14, 8
#: Spark's names of file systems that pyarrow knows by another.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}
MANIFEST = "name string, records bigint, bytes bigint, file_sha256 string, first_id bigint, last_id bigint"
READ = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, file string"


def file_system(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """pyarrow's file system and path of a folder as Spark names it (hdfs, viewfs, s3a, abfss, gs, file)."""
    scheme, mark, rest = folder.partition("://")
    return pyarrow.fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + mark + rest)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'page {page_id}'.encode()).digest()[:16], version=5)}>"


def header_value(text: str) -> str:
    """One line: control characters and spaces are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """The record of a page: its payload, or for a revisit only the headers, with a new digest of the block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {header_value(url) if url else 'about:blank'}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if page_id is not None:
        lines.append(f"{ID_HEADER}: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"Spanforge-Refers-To-Page-Id: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Roll:
    """Files of one part: each grows under a temporary name to about roll_bytes and then takes its final name.

    The final name is fixed by the part's number and the file's, and so is the content, so an attempt that
    repeats a lost one replaces its files by equal ones. A name counts only once the manifest lists it.
    """

    def __init__(self, folder: str, part: int, roll_bytes: int, level: int) -> None:
        self.fs, self.folder = file_system(folder)
        self.part, self.roll_bytes, self.level = part, roll_bytes, level
        self.number, self.file, self.done = 0, None, []

    def begin(self, part: int) -> None:
        """Another part: its files are numbered anew."""
        self.close()
        self.part, self.number = part, 0

    def add(self, page_id: int | None, data: bytes) -> None:
        if self.file is None:
            self.name = f"part-{self.part:06d}-{self.number:05d}.warc.gz"
            self.temporary = posixpath.join(self.folder, f"_temporary-{self.name}-{uuid.uuid4().hex}")
            self.file, self.digest, self.size, self.records, self.first = self.fs.open_output_stream(self.temporary, compression=None), hashlib.sha256(), 0, 0, page_id
        packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        data = packer.compress(data) + packer.flush()
        self.file.write(data)
        self.digest.update(data)
        self.size, self.records, self.last = self.size + len(data), self.records + 1, page_id
        if self.size >= self.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.fs.move(self.temporary, posixpath.join(self.folder, self.name))
            self.done.append((self.name, self.records, self.size, self.digest.hexdigest(), self.first, self.last))
            self.file, self.number = None, self.number + 1

    def drop(self) -> None:
        if self.file is not None:
            self.file.close()
            self.fs.delete_file(self.temporary)


def order_key(page_id: Column, url: Column, payload: Column) -> Column:
    """Text in the order of the records: null ids, then ids; equal ids by a hash of url and payload.

    Rows of one key are alike but for collisions of 64 bits.
    """
    number = F.when(page_id.isNull(), F.lit("0")).otherwise(F.concat(F.when(page_id < 0, "1").otherwise("2"), F.lpad(F.hex(page_id), 16, "0")))
    return F.concat(number, F.lit(":"), F.lpad(F.hex(F.xxhash64(url, payload)), 16, "0"))


def place(key: Column, bounds: list[str]) -> Column:
    """How many of the sorted bounds are not above the key, by a search in two steps."""
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds)) + 1
    rows = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    upto = lambda some: F.size(F.filter(some, lambda b: b <= key))
    text = lambda some: F.array(*map(F.lit, some))
    row = upto(text([r[0] for r in rows])) - 1
    return F.when(row < 0, 0).otherwise(row * width + upto(F.get(F.array(*map(text, rows)), row))).cast("int")


def bounds_of(told: DataFrame, part_bytes: int) -> list[str]:
    """The keys at which parts begin, but for the first: the same for the same rows, however they are partitioned.

    Candidates are the keys that a hash picks, FINE for each part; the bytes between them are summed, and
    neighbours are put together up to a part's bytes. No sample is drawn.
    """
    rows, total = told.agg(F.count(F.lit(1)), F.sum("n")).first()
    parts = min(MOST_PARTS, -(-(total or 0) // part_bytes))
    if parts < 2:
        return []
    picked = told.where(F.pmod(F.xxhash64("key", F.lit(2)), F.lit(max(1, rows // (FINE * parts)))) == 0).select("key").distinct()
    candidates = sorted(r[0] for r in picked.collect())
    sums = {r["at"]: r["bytes"] for r in told.groupBy(place(F.col("key"), candidates).alias("at")).agg(F.sum("n").alias("bytes")).collect()}
    goal, held, out = total / parts, sums.get(0, 0), []
    for i, key in enumerate(candidates):
        if held and held + sums.get(i + 1, 0) / 2 > goal:
            out.append(key)
            held = 0
        held += sums.get(i + 1, 0)
    return out


def digests_of(pages: DataFrame, least: int) -> tuple[DataFrame, str]:
    """(key, page_id, digest, n, refers_to) of every record, staged, without payloads.

    The least id of each digest is a sum made map-side; only digests that occur twice take part in the join, so a
    payload that a third of the pages share is no large row or group anywhere.
    """
    n = F.octet_length("payload")
    every, path = stage(pages.select("key", "page_id", F.sha2("payload", 256).alias("digest"), n.alias("n")), "digests")
    first = every.where(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("times")).where("times > 1 and refers_to is not null")
    found = every.join(first.select("digest", "refers_to"), "digest", "left")
    refers = F.when((F.col("n") >= least) & (F.col("page_id").isNull() | (F.col("page_id") > F.col("refers_to"))), F.col("refers_to"))
    told, told_path = stage(found.select("key", "digest", "n", refers.alias("refers_to")), "told")
    drop(pages.sparkSession, path)
    return told, told_path


def write(pages: DataFrame, folder: str, least: int = 100, roll_bytes: int = 64 << 20, level: int = 6, date: str = "2024-01-01T00:00:00Z", part_bytes: int = PART_BYTES, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record for each row of pages under folder; returns the manifest, which is also kept there.

    Rows are sorted by id in parts of about part_bytes, whose bounds are worked out exactly, so names, sizes and
    digests of all files depend on the rows alone, not on the session, its settings or the partitioning. Files
    follow one another in id order. Of the records with equal payloads of `least` bytes or more those with the
    smallest id are responses, the others revisits of it; smaller payloads are all responses.

    Null payloads count as empty, a null url is about:blank, a null id comes first and is never the smallest,
    rows with the same id give records each, in the order of a hash of url and payload. Rows alike in all three
    stay in one part. An empty table gives an empty manifest. Other columns are not read. Tasks hold one payload
    at a time; a lost task is repeated with the same names and bytes.
    """
    spark = pages.sparkSession
    none, page_id = F.lit(None), pages[id_col].cast("long")
    url, payload = pages[url_col].cast("string"), F.coalesce(pages[payload_col].cast("binary"), F.lit(b""))
    keyed = pages.select(order_key(page_id, url, payload).alias("key"), page_id.alias("page_id"), url.alias("url"), payload.alias("payload"))
    told, told_path = digests_of(keyed, least)
    bounds = bounds_of(told, part_bytes)
    # What is known of a record stands before it in the same part, so payloads are shuffled once, hashed once and never joined.
    first = told.select("key", F.lit(0).alias("kind"), none.cast("long").alias("page_id"), none.cast("string").alias("url"), none.cast("binary").alias("payload"), "digest", "refers_to").distinct()
    rows = keyed.select("key", F.lit(1).alias("kind"), "page_id", "url", "payload", none.cast("string").alias("digest"), none.cast("long").alias("refers_to"))
    dealt = rows.unionByName(first).withColumn("part", place(F.col("key"), bounds)).repartitionById(len(bounds) + 1, F.col("part"))
    ordered = dealt.sortWithinPartitions("part", "key", "kind", "url", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, part, at, known = Roll(folder, 0, roll_bytes, level), None, None, {}
        try:
            for batch in steps(batches, 4):
                for key, kind, page_id, url, payload, digest, refers_to, part_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if part_ != part:
                        out.begin(part_)
                        part = part_
                    if key != at:
                        at, known = key, {}
                    if not kind:
                        known[digest] = refers_to
                        continue
                    digest = next(iter(known)) if len(known) == 1 else hashlib.sha256(payload).hexdigest()
                    out.add(page_id, record(page_id, url, payload, digest, known[digest], date))
            out.close()
        except BaseException:
            out.drop()
            raise
        if out.done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out.done, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], [x.split()[0] for x in MANIFEST.split(", ")])

    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/_manifest-temporary")
    if not fs.rename(path(f"{folder}/_manifest-temporary"), path(f"{folder}/_manifest")):
        raise OSError(f"the manifest can't be committed to {folder}; is there one already?")
    drop(spark, told_path)
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def members(file, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, one by one."""
    unpack, parts, left = zlib.decompressobj(31), [], b""
    while data := left or file.read(size):
        parts.append(unpack.decompress(data))
        left = unpack.unused_data
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []
    if b"".join(parts):
        raise ValueError("the file ends within a record")


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if lines[0] != VERSION.strip():
        raise ValueError(f"not a record: {lines[0][:20]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n" or fields["warc-block-digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
        raise ValueError(f"{fields['warc-record-id']} is damaged")
    return fields, block


def read(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """A row for each record of the archives that the manifest lists, with its payload if asked for.

    Digests and lengths are worked out anew from what was read and compared with the headers; a revisit has
    those of the payload it refers to. Files are read as streams, a record at a time.
    """
    files = manifest(spark, folder).select("name", "file_sha256")
    schema = READ + (", payload binary" if payload else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in schema.split(", ")]
        fs, root = file_system(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(posixpath.join(root, name), compression=None) as file:
                    for data in members(file):
                        f, block = parsed(data)
                        head, _, body = block.partition(b"\r\n\r\n")
                        length = int(re.search(rb"(?i)\r\nContent-Length: *(\d+)", head + b"\r\n")[1])
                        digest, kind = f["warc-payload-digest"].removeprefix("sha256:"), f["warc-type"]
                        if kind == "response" and (len(body), hashlib.sha256(body).hexdigest()) != (length, digest):
                            raise ValueError(f"{name}: {f['warc-record-id']}'s payload is damaged")
                        number = lambda k: int(f[k]) if k in f else None  # noqa: B023, E731
                        rows.append((number(ID_HEADER.lower()), f["warc-target-uri"], kind, length, digest, number("spanforge-refers-to-page-id"), name, body if kind == "response" else None)[: len(names)])
                        held += len(body) if payload else 100
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds)], names)  # noqa: B905
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds)], names)  # noqa: B905

    return files.repartition(partitions(spark), "name").mapInArrow(run, schema)
