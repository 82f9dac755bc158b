"""Tables written to the folder that driver and executors share: they cut lineage, and their sizes are known."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[tuple[str, str]]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, one of our own if all of Spark runs in this
    process; on a cluster that is an error, as executors would not see one another's files."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = spark.conf.get("spanforge.local.shared.dir", None)
        if not found:
            found = "file://" + tempfile.mkdtemp(prefix="spanforge-")
            spark.conf.set("spanforge.local.shared.dir", found)
    return found.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new folder's name; what is written there goes with clear()."""
    path = f"{shared_dir(spark)}/spanforge/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(("", path))
    return path


def staged(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """df written once and read again; with `by`, as a table partitioned by these columns."""
    spark = df.sparkSession
    path = place(spark, name)
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, by: list[str], buckets: int | None = None, order: bool = True) -> DataFrame:
    """df as a table whose rows lie in buckets by these columns, with `order` sorted within: joins by them need no
    exchange on its side as long as the other side has as many partitions. One file a bucket."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, table = place(spark, name), f"spanforge_{re.sub(r'[^a-z0-9]', '_', name.lower())}_{uuid.uuid4().hex}"
    writer = df.repartition(n, *by).write.bucketBy(n, *by)
    (writer.sortBy(*by) if order else writer).option("path", path).saveAsTable(table)
    _written.setdefault(spark.sparkContext.applicationId, []).append((table, path))
    return spark.table(table)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has written so; to be called once their results are."""
    jvm = spark.sparkContext._jvm
    for table, path in _written.pop(spark.sparkContext.applicationId, []):
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
