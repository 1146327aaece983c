"""Joins over notes, index state, caches and map points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.functions.extract import citations
from corpuskit.functions.formats import days_between
from corpuskit.functions.text import full_hash, strip

# Kinds worth annotating and the shortest source that is.
ANNOTATED_KINDS = ("function", "method", "class")
MIN_ANNOTATED_CHARS = 30


def with_cache(symbols: DataFrame, cache: DataFrame) -> DataFrame:
    """Symbols with the cached columns of their content hash and a ``hit`` flag."""
    hashed = symbols.withColumn("content_hash", full_hash(F.col("source")))
    known = cache.withColumn("hit", F.lit(True))
    return hashed.join(known, "content_hash", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def annotation_state(symbols: DataFrame, cache: DataFrame) -> DataFrame:
    """What annotation has to do with each symbol; cached columns only where they apply."""
    rows = with_cache(symbols, cache)
    state = (
        F.when(~F.col("type").isin(*ANNOTATED_KINDS), "other_kind")
        .when(F.length(strip(F.col("source"))) < MIN_ANNOTATED_CHARS, "too_short")
        .when(F.col("hit"), "cached").otherwise("to_annotate")
    )
    cached = [c for c in cache.columns if c != "content_hash"]
    rows = rows.withColumn("state", state)
    for c in cached:
        rows = rows.withColumn(c, F.when(F.col("state") == "cached", F.col(c)))
    return rows


def index_drift(files: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    """Files as ``drifted`` (index over a day older), ``fresh`` or ``never_indexed``.

    ``files`` has ``mtime``; ``indexed`` has ``indexed`` (true) and ``indexed_at``,
    which counts as fresh when missing.
    """
    delta = days_between(F.col("mtime"), F.col("indexed_at"))
    status = (
        F.when(F.col("indexed").isNull(), "never_indexed").when(F.col("indexed_at").isNull(), "fresh")
        .when(delta > 1, "drifted").otherwise("fresh")
    )
    return files.join(indexed, key, "left").withColumn("status", status).withColumn(
        "delta_days", F.when(F.col("status") == "drifted", F.round(delta, 1)))


def work_queue(drift: DataFrame) -> DataFrame:
    """Files to index: stale ones (selected at once) and those never indexed."""
    stale = drift.where("status = 'drifted'").select("file", F.lit("stale").alias("kind"), F.lit(True).alias("selected"))
    never = drift.where("status = 'never_indexed'").select("file", F.lit("never_indexed").alias("kind"), F.lit(False).alias("selected"))
    return stale.unionByName(never)


def spotlight(points: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """Points with a flag for those among the (distinct) hits."""
    return points.join(hits.select(key).withColumn("spotlight", F.lit(True)), key, "left").withColumn(
        "spotlight", F.coalesce("spotlight", F.lit(False)))


def file_symbols(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files with their symbols in line order; files without symbols stay."""
    inside = Window.partitionBy("repo", "file").orderBy("line_start", "doc_id")
    placed = symbols.drop("language").withColumn("place", F.row_number().over(inside))
    return files.join(placed, ["repo", "file"], "left")


def broken_links(notes: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Links of notes that lead to no existing note."""
    targets = notes.select(key, F.explode_outer(citations(F.col("content"))).alias("target")).where("target is not null").distinct()
    return targets.join(names.select(F.col("name").alias("target")).distinct(), "target", "left_anti").select(key, "target")


def page_coverage(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Share of manual pages with a link into code."""
    linked = links.select("doc", "page").distinct().withColumn("linked", F.lit(1))
    return pages.select("doc", "page").join(linked, ["doc", "page"], "left").groupBy("doc").agg(
        F.count("*").alias("pages"), F.count("linked").alias("linked_pages"),
        F.round(F.count("linked") / F.count("*"), 6).alias("coverage"))


def side_by_side(runs: DataFrame, model_a: str, model_b: str) -> DataFrame:
    """Two models on the same prompts, with bars relative to the slower one."""
    def of(model, suffix):
        return runs.where(F.col("model") == model).select("prompt", F.col("ms").alias(f"ms_{suffix}"))

    both = of(model_a, "a").join(of(model_b, "b"), "prompt")
    slower = F.greatest("ms_a", "ms_b", F.lit(1.0))
    return both.select("prompt", "ms_a", "ms_b", *[
        F.round(100 * F.col(f"ms_{s}") / slower).cast("int").alias(f"bar_{s}") for s in ("a", "b")])
