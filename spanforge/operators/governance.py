"""Governance records and their bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# By record, each field's least and most length, or the words it may be; fields with least 0 may be null.
BOUNDS: dict[str, dict[str, tuple[int, int] | tuple[str, ...]]] = {
    "domain": {"id": (1, 256), "name": (1, 256), "description": (0, 2048)},
    "concept": {"id": (1, 256), "name": (1, 256), "domain_id": (1, 256)},
    "precept": {"id": (1, 256), "description": (1, 4096), "source_system": (1, 256), "author": (1, 512), "classification": ("MUST", "MUST_NOT", "SHOULD", "SHOULD_NOT", "MAY"), "operational_constraint": ("block", "require", "allow", "bypass", "warn")},
    "state": {"id": (1, 256), "name": (1, 256), "cfg_condition": (1, 2048)},
    "intent": {"id": (1, 256), "category": ("Security", "Opt", "Diag", "Governance", "Other")},
    "policy_rule": {"id": (1, 256), "type": ("banned_import", "unguarded_path", "protected_write"), "pattern": (1, 4096), "severity": ("block", "warn", "audit"), "message": (1, 2048), "precept_id": (0, 256)},
    "tactic": {"id": (1, 256), "function_name": (1, 512), "file_path": (1, 1024)},
}
REQUEST = {"query": (1, 1000), "limit": (1, 100), "repo": (0, 512), "depth": (1, 3), "node_id": (1, 512)}


def rejected(rows: DataFrame, record: str) -> DataFrame:
    """(id, field, reason) of each field that breaks its bounds; a good record gives no row."""
    faults = []
    for field, bound in BOUNDS[record].items():
        c = F.col(field)
        if isinstance(bound[0], str):
            reason = F.when(c.isNull(), "missing").when(~c.isin(list(bound)), "unknown value")
        else:
            reason = F.when(c.isNull(), "missing" if bound[0] else None).when(F.length(c) < bound[0], "too short").when(F.length(c) > bound[1], "too long")
        faults.append(F.when(reason.isNotNull(), F.struct(F.lit(field).alias("field"), reason.alias("reason"))))
    return rows.select("id", F.explode(F.array_compact(F.array(*faults))).alias("f")).select("id", "f.field", "f.reason")


def check_request(**fields) -> None:
    """Bounds of what a caller may ask (P14): lengths of texts, sizes of numbers."""
    for name, value in fields.items():
        least, most = REQUEST[name]
        size = len(value) if isinstance(value, str) else value
        if value is None and least == 0:
            continue
        if size is None or not least <= size <= most:
            raise ValueError(f"{name} must be {'between' if not isinstance(value, str) else 'of a length between'} {least} and {most}")
