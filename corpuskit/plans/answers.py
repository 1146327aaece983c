"""Generated answers: citation checks, retry, prompt assembly, token use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.functions.extract import citations
from corpuskit.functions.text import first_present, token_count

# The section an answer must end with, the tries it gets, the context and model limits.
SOURCES_SECTION = "## Stack Trace & Sources"
MAX_ATTEMPTS = 3
CONTEXT_TOKENS = 20_000
MODEL_TOKENS = 32_768


def _plain_links(text: Column) -> Column:
    """Targets of links that are exactly ``[[target]]``."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[\[((?:(?!\]\]).)+)\]\]"), F.lit(1)))


def cited_in_context(generations: DataFrame, contexts: DataFrame) -> DataFrame:
    """Generations with a link to a source of their context.

    Links are pulled out of the answer and joined by equality, so a context of
    any size is never compared source by source.
    """
    cited = generations.select("gen_id", "ctx_id", F.explode_outer(_plain_links(F.col("generation"))).alias("source"))
    return cited.join(contexts.select("ctx_id", "source").distinct(), ["ctx_id", "source"], "left_semi").select("gen_id").distinct()


def validate(generations: DataFrame, contexts: DataFrame, mode: str = "any") -> DataFrame:
    """First broken rule of each answer: ``bypass``, a violation, or ``pass``.

    ``mode="any"`` wants one citation from the context, ``mode="all"`` wants
    every citation from it.
    """
    have = contexts.select("ctx_id").distinct().withColumn("has_context", F.lit(True))
    if mode == "any":
        grounded = cited_in_context(generations, contexts)
    else:
        cited = generations.select("gen_id", "ctx_id", F.explode(citations(F.col("generation"))).alias("source")).distinct()
        stray = cited.join(contexts.select("ctx_id", "source").distinct(), ["ctx_id", "source"], "left_anti").select("gen_id").distinct()
        grounded = cited.select("gen_id").distinct().join(stray, "gen_id", "left_anti")
    g = F.col("generation")
    verdict = (
        F.when(F.col("has_context").isNull(), "bypass")
        .when(~g.contains(SOURCES_SECTION), "missing_sources_section")
        .when(~g.contains("[[") | ~g.contains("]]"), "missing_wikilinks")
        .when(F.col("grounded").isNull(), "hallucinated_source")
        .otherwise("pass")
    )
    return (
        generations.join(have, "ctx_id", "left").join(grounded.withColumn("grounded", F.lit(True)), "gen_id", "left")
        .withColumn("verdict", verdict).drop("has_context", "grounded")
    )


def needs_retry(verdict: Column, attempts: Column, max_attempts: int = MAX_ATTEMPTS) -> Column:
    return ~verdict.isin("pass", "bypass") & (attempts < max_attempts)


def ledger(validated: DataFrame) -> DataFrame:
    """Failed answers as ledger rows."""
    return validated.where(~F.col("verdict").isin("pass", "bypass")).select("gen_id", F.col("verdict").alias("violation"), "generation")


def budget_context(ranked: DataFrame, limit: int = CONTEXT_TOKENS) -> DataFrame:
    """Ranked context with the tokens each item may keep under ``limit`` in all.

    ``ranked`` has ``query_id``, ``rank``, ``content`` (a bounded list per query).
    """
    so_far = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = ranked.withColumn("tokens", token_count(F.col("content"))).withColumn("running", F.sum("tokens").over(so_far))
    used = F.least("tokens", F.lit(limit) - F.col("running") + F.col("tokens"))
    return rows.withColumn("kept_tokens", F.greatest(F.lit(0), used)).where("kept_tokens > 0")


def clip_tokens(text: Column, tokens: Column) -> Column:
    """Leading tokens of a text with the white space between them."""
    return F.when(token_count(text) <= tokens, text).otherwise(
        F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"\s*\S+"), F.lit(0)), F.lit(1), tokens), ""))


def assemble_context(ranked: DataFrame, limit: int = CONTEXT_TOKENS) -> DataFrame:
    """Context text of each query: named sources in rank order, within the budget."""
    source = first_present(F.col("file"), F.col("source"), default="Unknown")
    kept = budget_context(ranked, limit)
    block = F.concat(F.lit("--- SOURCE FILE: "), source, F.lit(" ---\n"), clip_tokens(F.col("content"), F.col("kept_tokens").cast("int")))
    blocks = F.sort_array(F.collect_list(F.struct("rank", block.alias("b"))))
    return kept.groupBy("query_id").agg(
        F.array_join(F.transform(blocks, lambda x: x["b"]), "\n").alias("context"), F.sum("kept_tokens").alias("context_tokens"),
        F.count("*").alias("sources"))


def token_breakdown(usage: DataFrame, key: str, limit: int = MODEL_TOKENS) -> DataFrame:
    """Long form of token use: segment, tokens, share of the model limit, advice.

    ``usage`` has ``system``, ``context``, ``chat_history`` and ``memory`` counts.
    """
    used = F.col("system") + F.col("context") + F.col("chat_history") + F.col("memory")
    segments = F.array(*[
        F.struct(F.lit(n).alias("segment"), F.col(n).cast("bigint").alias("tokens")) for n in ("system", "context", "chat_history", "memory")
    ] + [F.struct(F.lit("available").alias("segment"), F.greatest(F.lit(0), limit - used).cast("bigint").alias("tokens"))])
    used_pct = F.round(used * 100 / limit).cast("int")
    advice = F.when(used == 0, None).when(used_pct > 80, "reduce").otherwise("healthy")
    return usage.select(key, used_pct.alias("used_pct"), advice.alias("advice"), F.explode(segments).alias("s")).select(
        key, "used_pct", "advice", "s.*", F.round(F.col("s.tokens") * 100 / limit).cast("int").alias("pct"))
