"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_estimate(text: Column) -> Column:
    """A token for every four characters, rounded down."""
    return F.floor(F.length(text) / 4)


def head_tail(text: Column, most: int = 2000, separator: str = "\n...[TRUNCATED]...\n", reserve: int = 20) -> Column:
    """Long texts keep equal parts of their begin and end."""
    half = (most - reserve) // 2
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, half), F.lit(separator), F.right(text, F.lit(half)))).otherwise(text)


def docstring(content: Column, within: int = 500) -> Column:
    """Text in the first pair of triple double quotes, else single ones, of the begin of a file; else empty."""
    head = F.substring(content, 1, within)
    double = F.regexp_extract(head, '(?s)"""(.*?)"""', 1)
    single = F.regexp_extract(head, "(?s)'''(.*?)'''", 1)
    found = F.when(head.rlike('(?s)""".*?"""'), double).otherwise(single)
    return F.regexp_replace(found, r"^\s+|\s+$", "")


def diagram_id(text: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "")


def repo_id(url: Column) -> Column:
    """owner/name at the end of a remote's address; null if there is none."""
    return F.nullif(F.regexp_extract(F.regexp_replace(url, r"\.git$", ""), r"[:/]([^/:]+/[^/:]+)$", 1), F.lit(""))


def payload(text: Column, meta: Column) -> Column:
    """What is kept beside a vector: the text and the caller's entries, of which an own `text` wins."""
    own = F.coalesce(meta, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return F.when(F.map_contains_key(own, "text"), own).otherwise(F.map_concat(F.create_map(F.lit("text"), text), own))


def reply_field(reply: Column, path: str, default: Column) -> Column:
    """A field of a JSON reply, or its default."""
    return F.coalesce(F.get_json_object(reply, path), default)
