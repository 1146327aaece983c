"""Registry that pairs a Spark query with the SQL that states its result."""

from __future__ import annotations

import importlib
import textwrap
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuskit.catalog.inputs import COMMON_TABLES, Inputs

_MODULES = (
    "scalars", "sources_sinks", "manual", "code", "clones", "joins",
    "chunking", "retrieval", "windows", "analytics", "quality", "notes", "streams",
)
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_loaded = False


def query(key: str, sql: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` under ``key`` with its SQL twin.

    The twin may name any stand-in of ``COMMON_TABLES``; the needed
    definitions are put in front of it as common table expressions.
    """

    def wrap(fn):
        if key in _QUERIES:
            raise ValueError(f"duplicate query {key}")
        _QUERIES[key] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            _SQL[key] = textwrap.dedent(sql)
        return fn

    return wrap


def with_common_tables(sql: str) -> str:
    """Prefix ``sql`` with the stand-in definitions it refers to (``@name``)."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in COMMON_TABLES:
            if f"@{name}@" in text and name not in needed:
                visit(COMMON_TABLES[name])
                needed.append(name)

    visit(sql)
    parts = [f"{n} AS MATERIALIZED ({COMMON_TABLES[n]})" for n in needed]
    body = sql.strip()
    if parts:
        head = ",\n".join(parts)
        if body.upper().startswith("WITH RECURSIVE"):
            body = f"WITH RECURSIVE {head},\n{body[len('WITH RECURSIVE'):]}"
        elif body.upper().startswith("WITH"):
            body = f"WITH {head},\n{body[len('WITH'):]}"
        else:
            body = f"WITH {head}\n{body}"
    for name in COMMON_TABLES:
        body = body.replace(f"@{name}@", name)
    return body


def _load() -> None:
    global _loaded
    if not _loaded:
        for name in _MODULES:
            importlib.import_module(f"corpuskit.catalog.{name}")
        _loaded = True


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return {key: with_common_tables(sql) for key, sql in _SQL.items()}
