"""JSON, date and display functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_LIMIT = 32768


def json_object_in(text: Column) -> Column:
    """First flat JSON object inside free text, else the whole text."""
    found = F.regexp_extract(text, r"\{[^{}]+\}", 0)
    return F.when(found != "", found).otherwise(text)


def frontmatter(**fields: Column | list) -> Column:
    """YAML head of a note.

    A value is a string column, an array column wrapped in a list
    (``[column]``) or, for numbers, a tuple ``(column,)``.
    """
    lines = [F.lit("---")]
    for name, value in fields.items():
        if isinstance(value, list):
            items = F.filter(value[0], lambda x: x.isNotNull())
            body = F.array_join(F.transform(items, lambda x: F.concat(F.lit("  - "), x)), "\n")
            lines.append(F.when(F.size(items) > 0, F.concat(F.lit(f"{name}:\n"), body)).otherwise(f"{name}: []"))
        elif isinstance(value, tuple):
            lines.append(F.concat(F.lit(f"{name}: "), value[0].cast("string")))
        else:
            safe = F.replace(F.coalesce(value, F.lit("")), F.lit('"'), F.lit('\\"'))
            lines.append(F.concat(F.lit(f'{name}: "'), safe, F.lit('"')))
    return F.concat(F.concat_ws("\n", *lines, F.lit("---")), F.lit("\n"))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Seconds with microseconds; clock times are subtracted as they are, in no time zone."""
    return (later - earlier).cast("decimal(20,6)")


def days_between(later: Column, earlier: Column) -> Column:
    return seconds_between(later.cast("timestamp_ntz"), earlier.cast("timestamp_ntz")).cast("double") / 86400


def score_of(distance: Column, metric: str = "cosine") -> Column:
    """Relevance from a distance: ``1-d`` for cosine, ``1-d/2`` for squared L2."""
    scaled = distance if metric == "cosine" else distance / 2
    return F.greatest(F.lit(0.0), F.lit(1.0) - scaled)


def duration_text(ms: Column) -> Column:
    """``1.23s`` above 999 ms, else ``123ms``."""
    return F.when(ms > 999, F.format_string("%.2fs", ms / 1000)).otherwise(
        F.concat(F.floor(ms + 0.5).cast("string"), F.lit("ms")))


def eta_text(seconds: Column) -> Column:
    minutes, rest = F.floor(seconds / 60), seconds % 60
    return (
        F.when(seconds.isNull() | (seconds <= 0), "—")
        .when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s")))
        .otherwise(F.concat(minutes.cast("string"), F.lit("m"),
                            F.when(rest > 0, F.concat(rest.cast("string"), F.lit("s"))).otherwise("")))
    )


def light(value: Column, warn: float = 60, danger: float = 85) -> Column:
    return F.when(value < warn, "safe").when(value < danger, "warning").otherwise("danger")


def percent_text(value: Column) -> Column:
    return F.concat(F.round(value * 100, 0).cast("int").cast("string"), F.lit("%"))


def log_class(event: Column) -> Column:
    """Display class of a log event; the first match wins."""
    e = F.lower(event)
    node = e.contains("node") | e.contains("retrieve") | e.contains("generate") | e.contains("validate")
    return (
        F.when(node, "node").when(e.contains("start"), "startup").when(e.contains("pca"), "pca")
        .when(e.contains("query"), "query").when(e.contains("error"), "error").otherwise("other")
    )


def error_line(line: Column) -> Column:
    return line.contains("ERROR") | line.contains("error")
