"""Summaries of chunks, vectors, files, jobs and the vault as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.formats import seconds_between
from corpuskit.functions.text import token_count
from corpuskit.plans.history import recent

# Weights of the health dimensions, texts that count as documented, queries that mean full activity.
HEALTH_WEIGHTS = {"coverage": 0.30, "freshness": 0.25, "documentation": 0.20, "activity": 0.15, "hallucination": 0.10}
DOCUMENTED_BYTES = 500
FULL_ACTIVITY = 10
# Remarks that mark open work.
TODO_PATTERN = r"\b(TODO|FIXME|HACK|DEPRECATED|XXX)\b[:\s]*(.*)"


def size_histogram(chunks: DataFrame, text: str = "content", width: int = 200) -> DataFrame:
    """Chunks per size bucket."""
    bucket = (F.floor(F.length(text) / width) * width).alias("bucket")
    return chunks.groupBy(bucket).agg(F.count("*").alias("count"))


def top_counts(rows: DataFrame, key: Column, n: int, name: str = "source", count: str = "chunk_count") -> DataFrame:
    return rows.groupBy(key.alias(name)).agg(F.count("*").alias(count)).orderBy(F.desc(count), name).limit(n)


def shares(rows: DataFrame, key: str) -> DataFrame:
    """Rows per key and their share of all rows."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.round(F.col("n") / total, 6))


def bounding_boxes(points: DataFrame, key: str = "repo", margin: float = 0.3) -> DataFrame:
    return points.groupBy(key).agg(*[
        f.alias(n) for n, f in (
            ("x_min", F.min("x") - margin), ("x_max", F.max("x") + margin), ("y_min", F.min("y") - margin), ("y_max", F.max("y") + margin))])


def code_todos(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """Open-work remarks with line number, kind and text."""
    lines = files.select(key, F.posexplode_outer(F.split("text", "\n")).alias("i", "raw"))
    kind = F.regexp_extract("raw", TODO_PATTERN, 1)
    return lines.where(kind != "").select(key, (F.col("i") + 1).alias("line"), kind.alias("kind"), F.trim(F.regexp_extract("raw", TODO_PATTERN, 2)).alias("remark"))


def file_index(files: DataFrame, symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """Lines, tokens, symbols and chunks of each file.

    Chunk ids stay in the chunk table (keyed by ``repo, file``); only their
    number and range are kept here.
    """
    keys = ["repo", "file"]
    sizes = files.select(*keys, F.size(F.split("text", "\n")).alias("lines"), token_count(F.col("text")).alias("tokens")).groupBy(*keys).agg(
        F.sum("lines").alias("line_count"), F.sum("tokens").alias("token_count"))
    named = symbols.groupBy(*keys).agg(F.count("*").alias("symbol_count"))
    cut = chunks.groupBy(*keys).agg(F.count("*").alias("chunk_count"), F.min("chunk_id").alias("first_chunk"), F.max("chunk_id").alias("last_chunk"))
    return sizes.join(named, keys, "left").join(cut, keys, "left").fillna(0, ["symbol_count", "chunk_count"])


def tag_index(rows: DataFrame, key: str, tags: Column) -> DataFrame:
    """One row per tag and tagged item; stays long because a tag may hold any number."""
    return rows.select(F.explode_outer(tags).alias("tag"), key).where("tag is not null")


def progress(log: DataFrame, by: str, total: int | Column) -> DataFrame:
    """Items done per ``by``, rate per second and seconds left, from a job's event log (``ts``)."""
    done = log.groupBy(by).agg(F.count("*").alias("done"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    return with_rate(done, total).select(by, "done", "per_second", "eta_s")


def with_rate(done: DataFrame, total: int | Column) -> DataFrame:
    """Counts (``done``, first and last time ``t0, t1``) with ``per_second`` and ``eta_s``; both NULL while no time has passed."""
    rate = F.col("done") / F.nullif(seconds_between(F.col("t1"), F.col("t0")).cast("double"), F.lit(0.0))
    whole = F.lit(total) if isinstance(total, int) else total
    return done.withColumn("per_second", F.round(rate, 6)).withColumn("eta_s", F.floor(F.greatest(F.lit(0), whole - F.col("done")) / rate))


def generation_stats(runs: DataFrame, key: str) -> DataFrame:
    """Tokens, tokens per second and cache hits (under 500 ms) of generation runs (``ms``, ``output``)."""
    tokens = token_count(F.col("output"))
    rows = runs.select(key, "ms", tokens.alias("output_tokens"), F.when(F.col("ms") > 0, F.round(tokens / (F.col("ms") / 1000), 1)).otherwise(0.0).alias("tokens_per_s"),
                       (F.col("ms") < 500).alias("cache_hit"))
    return rows


def health(
    files: DataFrame, indexed: DataFrame, history: DataFrame, failures: DataFrame, now: Column,
    freshness: Column | None = None, weights: dict[str, float] = HEALTH_WEIGHTS,
) -> DataFrame:
    """Health of the vault: five ratios and their weighted sum (0-100), one row.

    ``files`` has ``name, size``; ``indexed`` the distinct ``name`` of indexed
    sources; ``history`` has ``ts``; ``failures`` one row per failed answer.
    Without timestamps in the index freshness counts as one half.
    """
    counts = files.agg(F.count("*").alias("n_files"), F.count_if(F.col("size") > DOCUMENTED_BYTES).alias("documented"))
    n_indexed = indexed.agg(F.countDistinct("name")).scalar()
    n_recent = history.where(recent(F.col("ts"), now)).agg(F.count("*")).scalar()
    n_queries = history.agg(F.count("*")).scalar()
    n_failed = failures.agg(F.count("*")).scalar()
    files_or_null = F.nullif(F.col("n_files"), F.lit(0))
    scores = {
        "coverage": F.coalesce(n_indexed / files_or_null, F.lit(0.0)),
        "freshness": F.lit(0.5) if freshness is None else freshness,
        "documentation": F.coalesce(F.col("documented") / files_or_null, F.lit(0.0)),
        "activity": F.least(F.lit(1.0), n_recent / FULL_ACTIVITY),
        "hallucination": F.greatest(F.lit(0.0), 1 - F.coalesce(n_failed / F.nullif(n_queries, F.lit(0)), F.lit(0.0))),
    }
    rows = counts.select("n_files", "documented", *[s.alias(n) for n, s in scores.items()])
    total = sum((F.col(n) * w for n, w in weights.items()), F.lit(0.0))
    return rows.withColumn("score", F.round(total * 100, 1))
