"""Data-quality expectations: each gives rows ``check, subject, value, ok``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _result(rows: DataFrame, check: str, subject: Column, value: Column, ok: Column) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), subject.alias("subject"), value.cast("double").alias("value"), ok.alias("ok"))


def _long(counts: DataFrame, check: str, names: list[str], ok) -> DataFrame:
    """One-row counts to one row per name."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("subject"), F.col(n).cast("double").alias("value")) for n in names]))
    rows = counts.select(cells.alias("c")).select("c.*")
    return rows.select(F.lit(check).alias("check"), "subject", "value", ok(F.col("value")).alias("ok"))


def required_fields(rows: DataFrame, fields: list[str]) -> DataFrame:
    """No required field is NULL or empty."""
    counts = rows.agg(*[F.count_if(F.col(f).isNull() | (F.col(f).cast("string") == "")).alias(f) for f in fields])
    return _long(counts, "required_fields", fields, lambda v: v == 0)


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def token_range(rows: DataFrame, tokens: Column, low: int, high: int, by: str) -> DataFrame:
    """Rows below and above the allowed token counts, per kind."""
    return rows.groupBy(by).agg(F.count_if(tokens < low).alias("too_small"), F.count_if(tokens > high).alias("too_large"), F.max(tokens).alias("largest"))


def short_texts(rows: DataFrame, text: str, least: int = 10) -> DataFrame:
    counts = rows.agg(F.count_if(F.length(F.trim(text)) < least).alias(text))
    return _long(counts, "short_texts", [text], lambda v: v == 0)


def presence(rows: DataFrame, column: str, expected: list[str]) -> DataFrame:
    """Which expected values occur."""
    counts = rows.agg(*[F.count_if(F.col(column) == v).alias(v) for v in expected])
    cells = F.explode(F.array(*[F.struct(F.lit(v).alias("name"), (F.col(v) > 0).alias("present")) for v in expected]))
    return counts.select(cells.alias("c")).select("c.*")


def minimum_counts(tables: dict[str, DataFrame], least: dict[str, int]) -> DataFrame:
    """Row count of each table against its minimum."""
    out = None
    for name, rows in tables.items():
        n = F.count("*")
        part = _result(rows.agg(n.alias("n")), "minimum_counts", F.lit(name), F.col("n"), F.col("n") >= least.get(name, 1))
        out = part if out is None else out.unionByName(part)
    return out


def line_numbers(symbols: DataFrame) -> DataFrame:
    """Symbols whose lines do not start at 1 or later, or end before they start."""
    return symbols.where((F.col("line_start") < 1) | (F.col("line_end") < F.col("line_start")))


def pair_minimum(pair_counts: DataFrame, expected: list[tuple[str, str, int]]) -> DataFrame:
    """Known repository pairs have at least so many clone pairs."""
    parts = []
    for a, b, least in expected:
        hit = (F.col("repo_a") == F.lit(min(a, b))) & (F.col("repo_b") == F.lit(max(a, b)))
        n = F.coalesce(F.sum(F.when(hit, F.col("pairs"))), F.lit(0))
        parts.append(F.struct(F.lit(f"{a}|{b}").alias("subject"), n.cast("double").alias("value"), (n >= least).alias("ok")))
    row = pair_counts.agg(*[p.alias(f"p{i}") for i, p in enumerate(parts)])
    return row.select(F.explode(F.array(*[F.col(f"p{i}") for i in range(len(parts))])).alias("c")).select(F.lit("pair_minimum").alias("check"), "c.*")


def note_shape(notes: DataFrame, key: str) -> DataFrame:
    """Whether notes start with frontmatter and hold a link."""
    c = F.col("content")
    return notes.select(key, c.startswith("---").alias("has_frontmatter"), (c.contains("[[") & c.contains("]]")).alias("has_links"))


def failure_rate(rows: DataFrame, failed: Column, by: str, warn: float = 0.02, stop: float = 0.05) -> DataFrame:
    """Share of failed files and what it means: ``ok``, ``warn`` or ``stop``."""
    rate = F.count_if(failed) / F.count("*")
    return rows.groupBy(by).agg(F.count("*").alias("files"), F.count_if(failed).alias("failed"), F.round(rate, 6).alias("rate"),
                                F.when(rate > stop, "stop").when(rate >= warn, "warn").otherwise("ok").alias("verdict"))
