"""Source files, diffs and other inputs as tables."""

from __future__ import annotations

import os
import re
import subprocess

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from spanforge.functions.paths import extension, is_ignored
from spanforge.sources.languages import registry, supported


@F.pandas_udf(StringType())
def lenient_text(raw: pd.Series) -> pd.Series:
    """UTF-8 with bad bytes left out."""
    return raw.map(lambda b: None if b is None else bytes(b).decode(errors="ignore"))


def source_files(spark: SparkSession, root: str, repo_id: str, tracked: list[str] | None = None) -> DataFrame:
    """(repo_id, path, content, language) of a folder's files that are neither ignored nor of an unknown kind (S2-S5);
    of tracked ones only, if they are given (S1)."""
    rows = _sources(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root), root, repo_id)
    if tracked is None:
        return rows
    return rows.join(spark.createDataFrame([(p,) for p in tracked], "path string"), "path", "left_semi").select(*rows.columns)


def named_files(spark: SparkSession, root: str, repo_id: str, paths: list[str]) -> DataFrame:
    """The same of the named files that are there; no others are listed or opened. For a bounded number of names."""
    jvm = spark.sparkContext._jvm
    places = [jvm.org.apache.hadoop.fs.Path(root, p) for p in paths]
    system = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = [p.toString() for p in places if system.exists(p)]
    if not there:
        return spark.createDataFrame([], "repo_id string, path string, content string, language string")
    escaped = [re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in there]
    return _sources(spark.read.format("binaryFile").load(escaped), root, repo_id)


def _sources(found: DataFrame, root: str, repo_id: str) -> DataFrame:
    base = root.split("://", 1)[-1].split(":", 1)[-1].rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), "^/?" + base.replace(".", r"\.").lstrip("/") + "/", "")
    ext = F.lower(extension(path))
    language = F.coalesce(*[F.when(ext == e, n) for e, n in registry().items()])
    kept = found.withColumn("_p", path).where(~is_ignored(F.col("_p")) & F.lower(extension(F.col("_p"))).isin(supported()))
    return kept.select(F.lit(repo_id).alias("repo_id"), F.col("_p").alias("path"), lenient_text("content").alias("content"), language.alias("language"))


def head_commit(root: str, seconds: int = 30) -> str | None:
    """The commit that is checked out; null without version control."""
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], cwd=root, capture_output=True, text=True, timeout=seconds, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def tracked_files(root: str, seconds: int = 30) -> list[str] | None:
    """Paths under version control; null if the folder isn't the top of a checkout, or if it fails."""
    if not os.path.exists(os.path.join(root, ".git")):
        return None
    try:
        return subprocess.run(["git", "ls-files", "-z"], cwd=root, capture_output=True, text=True, timeout=seconds, check=True).stdout.split("\0")[:-1]
    except (OSError, subprocess.SubprocessError):
        return None


def working_diff(root: str, staged: bool = False, base: str | None = None, seconds: int = 30) -> str:
    """Text of the working tree's diff, of what is staged, or from a base."""
    what = [f"{base}...HEAD"] if base else ["--staged"] if staged else []
    return subprocess.run(["git", "diff", *what], cwd=root, capture_output=True, text=True, timeout=seconds, check=True).stdout


def changed_letters(spark: SparkSession, root: str, old: str, new: str = "HEAD", seconds: int = 30) -> DataFrame:
    """(letter, path, new_path) between two commits, for change_operations."""
    out = subprocess.run(["git", "diff", "--name-status", "-M", "-z", old, new], cwd=root, capture_output=True, text=True, timeout=seconds, check=True).stdout.split("\0")[:-1]
    rows, i = [], 0
    while i < len(out):
        two = out[i][0] in "RC"
        rows.append((out[i][0], out[i + 1], out[i + 2] if two else None))
        i += 3 if two else 2
    return spark.createDataFrame(rows, "letter string, path string, new_path string")


def split_diffs(diffs: DataFrame, column: str = "diff") -> DataFrame:
    """A row (path, section) for each file of unified diffs."""
    part = diffs.select(F.explode(F.split(column, r"(?m)^(?=diff --git )")).alias("section")).where(F.col("section").startswith("diff --git "))
    last = F.element_at(F.split(F.regexp_extract("section", r"^(diff --git .*)", 1), " "), -1)
    return part.select(F.regexp_replace(last, "^[ab]/", "").alias("path"), "section")


def gold_set(spark: SparkSession, path: str) -> DataFrame:
    """Queries with what they should find."""
    kind = "queries array<struct<id string, query string, category string, expected_paths array<string>, expected_concepts array<string>, notes string>>"
    return spark.read.schema(kind).option("multiLine", True).json(path).select(F.inline("queries"))
