"""Predicates and parts of file paths as column expressions."""

from __future__ import annotations

import re
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names that decide which files are looked at.
IGNORED_DIRS = """.git .svn .hg node_modules vendor bower_components __pycache__ venv .venv env .env dist build
*.egg-info .eggs .tox .nox .pytest_cache .mypy_cache .ruff_cache .pytype .hypothesis .idea .vscode .vs .eclipse
.settings *.swp *.swo *~ target out bin obj .cache .tmp tmp temp .DS_Store Thumbs.db .beads .claude .cursor .next
.nuxt .output coverage htmlcov .coverage .nyc_output""".split()
IGNORED_FILES = ".DS_Store Thumbs.db .mcp.json .env .env.local *.pyc *.pyo *.pyd *.log *.pid *.lock".split()
LOCK_FILES = "Cargo.lock package-lock.json yarn.lock pnpm-lock.yaml uv.lock poetry.lock Gemfile.lock composer.lock Pipfile.lock go.sum".split()
LOCK_EXTENSIONS = ".lock .sum".split()
BINARY_EXTENSIONS = ".png .jpg .jpeg .gif .pdf .zip .pyc .so .dll .exe .bin".split()
TEST_DIRS = "tests __tests__ test spec __test__".split()
CRITICAL = "auth payment billing security core main".split()
VENDOR = "setuptools pip pkg_resources distlib wheel".split()


def modules_to_skip() -> list[str]:
    """Standard library modules of this interpreter, and vendored packaging tools; pass a list of your own to pin it."""
    return sorted({*sys.stdlib_module_names, *VENDOR})


def skip_list(spark: SparkSession, listed: str | None = None) -> DataFrame:
    """(name) of modules to skip: those of a text file with a name a line, which pins them, else this interpreter's; and
    the vendored tools (S15, U3)."""
    if listed is None:
        return spark.createDataFrame([(m,) for m in modules_to_skip()], "name string")
    lines = spark.read.text(listed).select(F.trim("value").alias("name")).where("name <> '' and not startswith(name, '#')")
    return lines.unionByName(spark.createDataFrame([(m,) for m in VENDOR], "name string")).distinct()


def without_skipped(rows: DataFrame, name: str, skipped: DataFrame) -> DataFrame:
    """Rows whose name's first dotted part isn't in the list (name), a table (P5); null names stay."""
    first = F.substring_index(rows[name], ".", 1)
    return rows.join(skipped.select(F.col("name").alias("_skipped")).distinct(), first == F.col("_skipped"), "left_anti")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """With its dot; names that only begin with dots have none."""
    return F.regexp_extract(basename(path), r"^\.*[^.].*(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    """File name without extension; for mod, lib and main that of the folder (F8)."""
    name = F.regexp_replace(basename(path), r"(?<=[^.])\.[^.]*$", "")
    parent = F.when(F.instr(path, "/") > 0, F.element_at(F.split(path, "/"), -2)).otherwise("")
    return F.when(name.isin("mod", "lib", "main"), parent).otherwise(name)


def is_test(path: Column) -> Column:
    """Test by file name or folder."""
    low = F.lower(path)
    return basename(low).rlike(r"^test_|_test\.py$|\.(spec|test)\.(js|ts|jsx|tsx)$") | F.arrays_overlap(F.split(low, "/"), F.array(*map(F.lit, TEST_DIRS)))


def is_ignored(path: Column) -> Column:
    """A folder on the way is ignored by its literal name, or the file by name or ending (S3)."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    name = basename(path)
    out = F.arrays_overlap(folders, F.array(*map(F.lit, IGNORED_DIRS))) | name.isin([x for x in IGNORED_FILES if x[0] != "*"])
    for x in IGNORED_FILES:
        if x[0] == "*":
            out = out | name.endswith(x[1:])
    return out


def is_lock(path: Column) -> Column:
    return basename(path).isin(LOCK_FILES) | extension(path).isin(LOCK_EXTENSIONS)


def is_binary(path: Column) -> Column:
    return F.lower(extension(path)).isin(BINARY_EXTENSIONS)


def is_critical(path: Column) -> Column:
    return F.lower(path).rlike("|".join(CRITICAL))


def is_skipped_module(name: Column, skipped: list[str]) -> Column:
    """First dotted part is in the list (P5)."""
    return F.substring_index(name, ".", 1).isin(skipped)


def inside(root: str, path: Column) -> Column:
    """No way out of root: not absolute elsewhere, and never more `..` than folders before it."""
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    depth = F.aggregate(F.split(full, "/"), F.array().cast("array<string>"), lambda a, x: F.when(x.isin("", "."), a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(depth, "/")).startswith(root.rstrip("/") + "/")


def glob_regex(pattern: str) -> str:
    """Java regular expression of a shell pattern in which `*` also crosses slashes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append("(?s:.*)")
        elif c == "?":
            out.append("(?s:.)")
        elif c == "[" and (end := pattern.find("]", i + 1 + (pattern[i : i + 1] == "!"))) > 0:
            inner = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[{'^' + inner[1:] if inner[0] == '!' else ('\\' + inner if inner[0] == '^' else inner)}]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return f"^{''.join(out)}$"
