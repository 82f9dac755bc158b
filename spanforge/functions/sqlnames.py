"""The functions for queries in SQL: expressions under names, and file summaries as a table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from spanforge.functions.paths import TEST_DIRS

#: What the expressions of hashing.py (F1-F3), text.py (F5, F7, F11, X8) and paths.py (P4, F8) say, in SQL.
FUNCTIONS = {
    "stable_uuid": ("a STRING, b STRING", "STRING", r"regexp_replace(sha2(concat_ws(':', a, b), 256), '^(.{8})(.{4})(.{4})(.{4})(.{12}).*$', '$1-$2-$3-$4-$5')"),
    "short_id": ("a STRING, b STRING", "STRING", "left(sha2(concat_ws(':', a, b), 256), 16)"),
    "point_id": ("t STRING", "STRING", r"CASE WHEN t RLIKE '^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$' THEN lower(t) ELSE regexp_replace(md5(t), '^(.{8})(.{4})(.{4})(.{4})(.{12}).*$', '$1-$2-$3-$4-$5') END"),
    "token_estimate": ("t STRING", "BIGINT", "length(t) div 4"),
    "head_tail": ("t STRING", "STRING", r"CASE WHEN length(t) > 2000 THEN concat(left(t, 990), '\n...[TRUNCATED]...\n', right(t, 990)) ELSE t END"),
    "diagram_id": ("t STRING", "STRING", r"regexp_replace(t, '[^\\p{L}\\p{N}]', '')"),
    "is_test": ("path STRING", "BOOLEAN", r"substring_index(lower(path), '/', -1) RLIKE '^test_|_test\\.py$|\\.(spec|test)\\.(js|ts|jsx|tsx)$' OR arrays_overlap(split(lower(path), '/'), array(" + ", ".join(f"'{d}'" for d in TEST_DIRS) + "))"),
}


class FileSummaries:
    """SELECT * FROM file_summaries(TABLE(nodes)): a text for each file, as parsing.summaries makes it.

    nodes: repo_id, path, type, kind, name, start_line, and others of no account; a row of type `source` has a file's
    docstring as its name. A name may also be a list of names in order, for nodes alike in all else: a row for each list costs
    Python much less than a row for each node. The function says itself that files go apart and their nodes in order, so no caller must; it
    keeps the first imports and as much of the definitions as the text may hold, whatever a file has.
    """

    IMPORTS, MOST = 20, 4000

    @staticmethod
    def analyze(nodes: AnalyzeArgument) -> AnalyzeResult:
        if not nodes.isTable:
            raise ValueError("file_summaries takes TABLE(...)")
        missing = {"repo_id", "path", "type", "kind", "name", "start_line"} - set(nodes.dataType.names)
        if missing:
            raise ValueError(f"file_summaries needs the columns {', '.join(sorted(missing))}")
        kind = nodes.dataType["repo_id"].dataType
        schema = StructType().add("repo_id", kind).add("path", StringType()).add("summary", StringType())
        order = [OrderingColumn(c) for c in ("start_line", "name", "kind")]
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("repo_id"), PartitioningColumn("path")], orderBy=order)

    def __init__(self) -> None:
        self.file, self.imports, self.defines, self.room, self.doc = None, [], [], self.MOST, None

    def eval(self, row: Row) -> None:
        self.file = (row["repo_id"], row["path"])
        kind, name = row["type"], row["name"]
        names = [name] if name is None or isinstance(name, str) else list(name)
        if kind == "import":
            self.imports += names[: self.IMPORTS - len(self.imports)]
        elif kind == "definition":
            word = "class " if "class" in (row["kind"] or "") else "def "
            for each in names:
                if self.room <= 0:
                    break
                self.defines.append(word + each)
                self.room -= len(word) + len(each) + 2
        elif kind == "source":
            self.doc = names[0] if names else None

    def terminate(self) -> Iterator[tuple]:
        if self.file:
            repo, path = self.file
            lines = [f"File: {path}"] + ([f"Imports: {', '.join(self.imports)}"] if self.imports else []) + ([f"Defines: {', '.join(self.defines)}"] if self.defines else []) + ([self.doc] if self.doc else [])
            yield repo, path, "\n".join(lines)[: self.MOST]


def register(spark: SparkSession) -> None:
    """Make the functions known to spark.sql in this session."""
    for name, (arguments, returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")
    spark.udtf.register("file_summaries", udtf(FileSummaries))
