"""Syntax nodes of source files (X1-X10, E1, E3, V6, V11): the one place where rows need Python."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.hashing import stable_uuid
from spanforge.functions.text import docstring
from spanforge.sources import syntax

NODES = "repo_id string, path string, type string, kind string, name string, content string, start_line int, end_line int, error string"

#: For other languages than Python and those of syntax.py: patterns of definitions, imports and calls, by family.
FAMILIES = {
    "c-like": (r"\b(class|struct|enum|interface|trait|fn|func|function|fun|def|type)\s+([A-Za-z_]\w*)", r"^\s*(?:import|use|using|#include|require)\s+[\"'<(]?([\w./:@-]+)", r"\b([A-Za-z_][\w.]*)\s*\("),
    "words": (r"\b(def|class|module|function|defmodule|data|let)\s+([A-Za-z_]\w*)", r"^\s*(?:import|require|open|load)\s+[\"'(]?([\w./:]+)", r"\b([A-Za-z_][\w.]*)\s*\("),
}
WORDS = {"ruby", "lua", "elixir", "haskell", "ocaml", "bash"}
NOT_CALLS = {"if", "for", "while", "switch", "return", "catch", "function", "func", "fn", "def", "elif", "match", "sizeof", "with"}


def python_nodes(content: str) -> Iterator[tuple]:
    """Definitions, imports (the first name of each statement) and calls, in the order of the source."""
    lines = content.split("\n")
    found = []
    for node in ast.walk(ast.parse(content)):
        if isinstance(node, ast.ClassDef):
            entry = ("definition", "class_definition", node.name)
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            entry = ("definition", "function_definition", node.name)
        elif isinstance(node, ast.Import):
            entry = ("import", "import_statement", node.names[0].name)
        elif isinstance(node, ast.ImportFrom):
            entry = ("import", "import_from_statement", "." * node.level + (node.module or ""))
        elif isinstance(node, ast.Call):
            entry = ("call", "call", ast.get_source_segment(content, node.func) or "")
        else:
            continue
        if entry[2]:
            text = "\n".join(lines[node.lineno - 1 : node.end_lineno])
            found.append((node.lineno, node.col_offset, -node.end_lineno, *entry, text, node.lineno, node.end_lineno))
    for f in sorted(found, key=lambda f: f[:3]):
        yield f[3:]


def pattern_nodes(content: str, language: str) -> Iterator[tuple]:
    define, use, call = (re.compile(p) for p in FAMILIES["words" if language in WORDS else "c-like"])
    for number, line in enumerate(content.split("\n"), 1):
        named = set()
        for m in define.finditer(line):
            named.add(m[2])
            yield "definition", m[1], m[2], line, number, number
        if m := use.match(line):
            yield "import", "import", m[1], line, number, number
            continue
        for m in call.finditer(line):
            if m[1] not in NOT_CALLS and m[1] not in named:
                yield "call", "call", m[1], line, number, number


#: Characters of a file that its summary looks at.
HEAD = 500


def parse(files: DataFrame, heads: bool = False) -> DataFrame:
    """Nodes of (repo_id, path, content, language); a file that can't be parsed gives a row with its error (Q11).

    With heads, a row of type `source` for each file, too: its language as kind and the begin of its text, so that one
    pass over the files is enough for all that is made of them.
    """
    columns = [x.split()[0] for x in NODES.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for repo, path, content, language in part[["repo_id", "path", "content", "language"]].itertuples(index=False):
                if heads:
                    rows.append((repo, path, "source", language, None, None if content is None else content[:HEAD], None, None, None))
                if content is None or language is None:
                    continue
                try:
                    nodes = python_nodes(content) if language == "python" else syntax.nodes(content, language) if language in syntax.LANGUAGES else pattern_nodes(content, language)
                    rows += [(repo, path, *n, None) for n in nodes]
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append((repo, path, "error", None, None, None, None, None, str(e)))
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({"start_line": "Int32", "end_line": "Int32"})

    return files.select("repo_id", "path", "content", "language").mapInPandas(run, NODES)


def file_id() -> Column:
    return stable_uuid("repo_id", "path")


def node_ids(nodes: DataFrame) -> DataFrame:
    """Adds the ids of files and of nodes, which are the same in every run."""
    return nodes.withColumn("file_id", file_id()).withColumn("id", stable_uuid("repo_id", "path", "name", "kind"))


def exports(nodes: DataFrame) -> DataFrame:
    """Definitions as (path, name, usp); source text is not part of it."""
    return nodes.where("type = 'definition'").select("repo_id", "path", "name", F.concat_ws(":", "path", "name").alias("usp"), "start_line")


def imports(nodes: DataFrame) -> DataFrame:
    return nodes.where("type = 'import'").select("repo_id", "path", F.col("name").alias("module"), "start_line")


def summaries(files: DataFrame, nodes: DataFrame, most: int = 4000) -> DataFrame:
    """A text for each file: its path, up to 20 imports, what it defines, and its docstring."""
    place = F.struct("start_line", "name", "kind")
    listed = nodes.groupBy("repo_id", "path").agg(F.sort_array(F.collect_list(F.when(F.col("type") == "import", place))).alias("i"), F.sort_array(F.collect_list(F.when(F.col("type") == "definition", place))).alias("d"))
    both = files.join(listed, ["repo_id", "path"], "left")
    i = F.transform(F.slice("i", 1, 20), lambda x: x["name"])
    d = F.transform("d", lambda x: F.concat(F.when(x["kind"].contains("class"), "class ").otherwise("def "), x["name"]))
    doc = docstring(F.col("content"))
    text = F.concat_ws("\n", F.concat(F.lit("File: "), "path"), F.when(F.size("i") > 0, F.concat(F.lit("Imports: "), F.array_join(i, ", "))), F.when(F.size("d") > 0, F.concat(F.lit("Defines: "), F.array_join(d, ", "))), F.when(doc != "", doc))
    return both.select("repo_id", "path", F.substring(text, 1, most).alias("summary"))


def hash_vector(text: str, size: int) -> np.ndarray:
    """A unit vector made from the text's SHA-256, the same in every process (Q2)."""
    raw = b"".join(hashlib.sha256(f"{i}:{text}".encode()).digest() for i in range(-(-size // 8)))
    x = np.frombuffer(raw, "<u4")[:size].astype(np.float64) / 2**31 - 1
    return (x / np.linalg.norm(x)).astype(np.float32)


def embedder(size: int = 64, model: Callable[[list[str]], np.ndarray] | None = None) -> Callable[[Column], Column]:
    """A column function from text to vector; without a model the hash vector."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        filled = texts.fillna("").tolist()
        return pd.Series(list(model(filled)) if model else [hash_vector(t, size) for t in filled])

    return embed


def lexical_reranker(query: str) -> Callable[[DataFrame], DataFrame]:
    """Scores by the part of the query's words that a text has: a stand-in with a model's interface."""
    wanted = sorted(set(query.lower().split()))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: sum(w in t.lower() for w in wanted) / max(1, len(wanted)))

    return lambda pool: pool.withColumn("score", score("text"))
