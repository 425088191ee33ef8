"""Registry of runnable queries: operator id, Spark form and, where one can be written, the SQL form."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Entry:
    name: str
    operator: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


_ENTRIES: dict[str, Entry] = {}


def query(operator: str, sql: str | None = None):
    """Register a query under ``<id>_<function name>``."""

    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        name = f"{operator.lower().replace('-', '')}_{fn.__name__}"
        if name in _ENTRIES:
            raise ValueError(f"query {name} registered twice")
        _ENTRIES[name] = Entry(name, operator, fn, sql)
        return fn

    return keep


def entries() -> dict[str, Entry]:
    from . import load_all

    load_all()
    return dict(_ENTRIES)
