"""Retrieval jobs over typed collections, a batch of queries at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.functions.formats import score_of
from corpuskit.functions.predicates import relevant
from corpuskit.functions.text import estimated_tokens
from corpuskit.operators.scan import top_rows
from corpuskit.operators.vectors import nearest

COLLECTIONS = ("trm_notes", "repo_code", "trm_tables", "trm_code", "trm_prose")
NOTES = "trm_notes"
# Collection -> (rows, threshold) of the context and briefing searches.
COMPONENT_CONTEXT = {"trm_notes": (5, 0.35), "trm_tables": (3, 0.30), "trm_code": (3, 0.35), "repo_code": (5, 0.40)}
BRIEFING = {"trm_notes": (4, 0.25), "repo_code": (6, 0.25), "trm_tables": (2, 0.25)}
LAYER_THRESHOLD, LAYER_PER_REPO, LAYER_KEPT = 0.30, 3, 2


def retrieve(vectors: DataFrame, queries: DataFrame, k: int = 8, collections=COLLECTIONS) -> DataFrame:
    """Best ``k`` of all collections, out of the best few of each."""
    share = max(3, k // len(collections) + 1)
    found = nearest(vectors, queries, dict.fromkeys(collections, share)).drop("rank")
    return top_rows(found, ["query_id"], [F.col("distance"), F.col("vec_id")], k).withColumn(
        "score", F.round(score_of(F.col("distance")), 3))


def with_injected(found: DataFrame, injected: DataFrame) -> DataFrame:
    """Queries with injected texts use those (score 1) instead of search results.

    ``injected`` has ``query_id``, ``i`` and ``content``.
    """
    searched = found.join(injected.select("query_id").distinct(), "query_id", "left_anti").select(
        "query_id", "rank", F.col("vec_id").cast("string").alias("source"), "score")
    given = injected.select("query_id", (F.col("i") + 1).alias("rank"), F.concat(F.lit("injected_"), "i").alias("source"), F.lit(1.0).alias("score"))
    return searched.unionByName(given)


def filtered_search(vectors: DataFrame, queries: DataFrame, max_tokens: int = 2000, collections=COLLECTIONS) -> DataFrame:
    """Ranked hits per query: the query's repository only in code, notes ahead of all else."""
    share = max(3, (max_tokens // 200) // max(1, len(collections)))
    found = nearest(vectors, queries, dict.fromkeys(collections, share), same="repo", same_in=("repo_code",)).drop("rank")
    order = [F.desc(F.col("grp") == NOTES), F.col("distance"), F.col("vec_id")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def within_budget(ranked: DataFrame, tokens: str, budget: int, key: str = "query_id") -> DataFrame:
    """Leading ranks whose tokens fit the budget; the first is always kept.

    Sums only grow with the rank, so the first row over budget ends the list.
    """
    so_far = Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("used", F.sum(tokens).over(so_far)).where((F.col("used") <= budget) | (F.col("rank") == 1))


def budgeted_search(vectors: DataFrame, queries: DataFrame, contents: DataFrame, max_tokens: int = 2000) -> DataFrame:
    """Filtered search cut to a token budget; ``contents`` has ``vec_id, content``."""
    hits = filtered_search(vectors, queries, max_tokens).join(contents, "vec_id")
    shown = F.when(F.col("grp") == NOTES, F.substring("content", 1, 400)).when(
        F.col("grp") == "repo_code", F.substring("content", 1, 120)).when(
        F.col("grp").isin("trm_tables", "trm_code"), F.substring("content", 1, 300)).otherwise(F.substring("content", 1, 200))
    return within_budget(hits.withColumn("shown", shown).withColumn("tokens", estimated_tokens(F.col("shown"))), "tokens", max_tokens)


def symbol_lookup(vectors: DataFrame, queries: DataFrame, exact_rows: int = 5, similar_rows: int = 3) -> DataFrame:
    """Symbols named exactly as asked (in the query's repository), else the nearest ones."""
    code = vectors.where(F.col("collection") == "repo_code")
    asked = queries.select("query_id", F.col("wanted").alias("symbol_name"), F.col("repo").alias("asked_repo"))
    named = code.select("vec_id", "symbol_name", "repo").join(asked, "symbol_name").where(
        F.col("asked_repo").isNull() | (F.col("asked_repo") == F.col("repo")))
    exact = top_rows(named, ["query_id"], [F.col("vec_id")], exact_rows).select("query_id", "vec_id", "rank", F.lit("exact").alias("how"))
    open_queries = queries.join(exact.select("query_id").distinct(), "query_id", "left_anti")
    similar = nearest(code, open_queries, {"repo_code": similar_rows}, same="repo").select(
        "query_id", "vec_id", "rank", F.lit("similar").alias("how"))
    return exact.unionByName(similar)


def quota_search(vectors: DataFrame, queries: DataFrame, rules: dict[str, tuple[int, float]]) -> DataFrame:
    """Best rows of each collection by its own quota, above its own threshold."""
    found = nearest(vectors, queries, {c: n for c, (n, _) in rules.items()})
    scored = found.withColumn("score", 1 - F.col("distance"))
    return scored.where(relevant(F.col("grp"), F.col("score"), rules))


def layered_search(vectors: DataFrame, queries: DataFrame, layers: dict[str, tuple[str, ...]], threshold: float = LAYER_THRESHOLD) -> DataFrame:
    """Best two hits per layer, out of the best three of each repository of the layer."""
    repos = sorted({r for names in layers.values() for r in names})
    code = vectors.where((F.col("collection") == "repo_code") & F.col("repo").isin(*repos))
    found = nearest(code, queries, dict.fromkeys(repos, LAYER_PER_REPO), group="repo").where(1 - F.col("distance") > threshold).drop("rank")
    member = F.filter(F.array(*[F.when(F.col("grp").isin(*names), F.lit(layer)) for layer, names in layers.items()]), lambda x: x.isNotNull())
    spread = found.withColumn("layer", F.explode(member))
    return top_rows(spread, ["query_id", "layer"], [F.col("distance"), F.col("vec_id"), F.col("grp")], LAYER_KEPT)


def first_by_file(ranked: DataFrame, key: str = "query_id", name: str = "filename") -> DataFrame:
    """Best-ranked row of each file per query, in rank order."""
    return ranked.groupBy(key, name).agg(F.min("rank").alias("rank"))
