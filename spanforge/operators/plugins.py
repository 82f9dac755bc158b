"""Registries, handlers by type, stages and checks of what is plugged in."""

from __future__ import annotations

import threading
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Registry:
    """Factories by name, safe to use from several threads."""

    def __init__(self, kind: str) -> None:
        self.kind, self._made, self._lock = kind, {}, threading.Lock()

    def register(self, name: str, factory: Callable) -> None:
        with self._lock:
            if name in self._made:
                warnings.warn(f"{self.kind} {name} is replaced", stacklevel=2)
            self._made[name] = factory

    def create(self, name: str, *args, **options):
        with self._lock:
            factory = self._made.get(name)
        if factory is None:
            raise ValueError(f"unknown {self.kind} {name}; there are: {', '.join(self.names()) or 'none'}")
        return factory(*args, **options)

    def names(self) -> list[str]:
        with self._lock:
            return sorted(self._made)


def processed(nodes: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(type, id, status) of each node (type, id, ...): its type's handler runs on all nodes of the type; nodes of
    other types, or of none, fail."""
    known = F.coalesce(F.col("type").isin(list(handlers)), F.lit(False))
    out = nodes.where(~known).select("type", "id", F.lit("failed").alias("status"))
    for kind, handler in handlers.items():
        out = out.unionByName(handler(nodes.where(F.col("type") == kind)).select("type", "id", F.lit("success").alias("status")))
    return out


def staged(rows: DataFrame, *stages: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One stage after the other."""
    for stage in stages:
        rows = rows.transform(stage)
    return rows


def missing_methods(thing: object, protocol: type) -> list[str]:
    """Public methods of the protocol that a thing lacks."""
    wanted = [n for n in vars(protocol) if not n.startswith("_") and callable(getattr(protocol, n))]
    return sorted(n for n in wanted if not callable(getattr(thing, n, None)))
