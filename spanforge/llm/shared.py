"""Folders that all executors share, staged tables, and Arrow batches cut to a byte size."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles at a time; a longer text is a step of its own.
STEP_BYTES = (1 << 20) - 64

ARROW_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a local one of our own if all of Spark runs in
    this process (tests); on a cluster that is an error, as executors would not see one another's files."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = spark.conf.get("spanforge.test.shared.dir", None)
        if not found:
            found = "file://" + tempfile.mkdtemp(prefix="spanforge-")
            spark.conf.set("spanforge.test.shared.dir", found)
    return found.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/spanforge/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most ARROW_BYTES while this holds: long texts and sets make large rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(ARROW_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stage(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it again, which cuts its lineage; also the path, for drop()."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    staged_paths(spark).add(path)
    with small_batches(spark):
        df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str, collect: bool = False) -> None:
    """Delete staged tables that nothing reads any more.

    Spark deletes the shuffle files behind them once the driver's garbage is collected, which may be half an hour
    later; with collect that is asked for at once, where much has been shuffled.
    """
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        staged_paths(spark).discard(path)
    if collect:
        jvm.System.gc()


_staged: dict[str, set[str]] = {}


def staged_paths(spark: SparkSession) -> set[str]:
    """Tables that this application has staged and not yet deleted."""
    return _staged.setdefault(spark.sparkContext.applicationId, set())


def clear(spark: SparkSession) -> None:
    """Delete all that is still staged: to be called once the results that read it have been written."""
    drop(spark, *list(staged_paths(spark)), collect=True)


def partitions(spark: SparkSession, least: int = 1) -> int:
    """The session's number of shuffle partitions: the operators never choose a fixed one."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def steps(batches: Iterator[pa.RecordBatch], column: int, step_bytes: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text in one stays near step_bytes; each row stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at, total = 0, 0
        for row, n in enumerate(lengths.tolist()):
            if total and total + n > step_bytes:
                yield batch.slice(at, row - at)
                at, total = row, 0
            total += n
        yield batch.slice(at)


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """The columns of docs in one struct `row`, so that no name clashes with those that are added."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in more.items()])


def unpacked(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs again, some of them replaced."""
    return rows.select(*[(changed[c] if c in changed else F.col("row").getField(c)).alias(c) for c in docs.columns])


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """(row, at) as a staged table, with its path: `at` tells each row from all others, whatever its id.

    The numbers are only fixed once written, so whoever reads rows more than once needs the table.
    """
    return stage(packed(docs, at=F.monotonically_increasing_id()), name)
