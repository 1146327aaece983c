"""Exact nearest-neighbour search for a batch of queries.

Queries are a stated set: they are cut into blocks of a fixed number, and each
block travels to the vectors, which are read in place and never shuffled.
Scoring is one matrix product per block of a batch.  Every task keeps only its
own best ``k`` per query and group over all of its batches, and a window over
those few rows gives the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.operators.scan import top_rows
from corpuskit.session import materialize

QUERIES_PER_BLOCK = 2_048
VECTORS_PER_PRODUCT = 4_096
_DIGITS = 9  # distances closer than this rank by id


def _best(ids, groups, matrix, query_ids, queries, limits, metric, allowed) -> pd.DataFrame:
    """Best rows of one batch: per query and group up to the group's limit."""
    order = np.argsort(ids, kind="stable")
    ids, groups, matrix = ids[order], groups[order], matrix[order]
    if metric == "cosine":
        norms = np.outer(np.linalg.norm(queries, axis=1), np.linalg.norm(matrix, axis=1))
        # A vector without length points nowhere; it ranks last, as far as any can be.
        distance = np.where(norms > 0, 1.0 - (queries @ matrix.T) / np.where(norms > 0, norms, 1.0), 2.0)
    else:
        distance = (queries**2).sum(1)[:, None] + (matrix**2).sum(1)[None, :] - 2.0 * (queries @ matrix.T)
    distance = np.round(distance, _DIGITS)
    if allowed is not None:
        distance = np.where(allowed(order), distance, np.inf)
    out = []
    for group in pd.unique(groups):
        k = limits(group)
        if not k:
            continue
        here = np.flatnonzero(groups == group)
        part = distance[:, here]
        picks = np.argsort(part, axis=1, kind="stable")[:, :k]
        found = np.take_along_axis(part, picks, axis=1)
        rows, cols = np.nonzero(np.isfinite(found))
        out.append(pd.DataFrame({
            "query_id": query_ids[rows], "grp": group, "vec_id": ids[here[picks[rows, cols]]], "distance": found[rows, cols]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "grp": [], "vec_id": [], "distance": []})


def _first(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best ``k`` of each query and group."""
    ordered = found.sort_values(["distance", "vec_id"], kind="stable")
    return ordered[ordered.groupby(["query_id", "grp"], dropna=False).cumcount() < k]


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int | dict[str, int],
    *,
    group: str = "collection",
    metric: str = "cosine",
    same: str | None = None,
    same_in: tuple[str, ...] = (),
) -> DataFrame:
    """Best vectors per query and group: ``query_id, grp, vec_id, distance, rank``.

    ``vectors`` has ``vec_id``, ``embedding`` and the ``group`` column;
    ``queries`` has ``query_id`` and ``query_vec``.  ``k`` is one number or one
    per group (other groups are not searched).  With ``same`` a vector must
    agree with the query on that column (when the query has a value), in the
    groups ``same_in`` or in all.
    """
    if isinstance(k, dict):
        vectors = vectors.where(F.col(group).isin(*k))
    extra = [same] if same else []
    vectors = vectors.where(F.size("embedding") > 0).select("vec_id", F.col(group).alias("grp"), "embedding", *extra)
    queries = queries.select("query_id", "query_vec", *extra)
    schema = T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("grp", vectors.schema["grp"].dataType),
        T.StructField("vec_id", vectors.schema["vec_id"].dataType), T.StructField("distance", T.DoubleType())])

    def score(vec: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if vec.empty or ask.empty:
            return pd.DataFrame({f.name: [] for f in schema.fields})
        groups = vec["grp"].to_numpy()
        allowed = None
        if same:
            asked, held = ask[same].to_numpy(dtype=object), vec[same].to_numpy(dtype=object)
            free = np.array([a is None or a != a for a in asked])

            def allowed(order):
                match = asked[:, None] == held[order][None, :]
                outside = ~np.isin(groups[order], same_in) if same_in else np.zeros(len(order), bool)
                return match | free[:, None] | outside[None, :]

        return _best(
            vec["vec_id"].to_numpy(), groups, np.stack(vec["embedding"]).astype("float64"), ask["query_id"].to_numpy(),
            np.stack(ask["query_vec"]).astype("float64"), (k.get if isinstance(k, dict) else lambda _: k), metric, allowed)

    ceiling = k if isinstance(k, int) else max(k.values())
    def against(block: pd.DataFrame) -> DataFrame:
        shipped = vectors.sparkSession.sparkContext.broadcast(block)

        def in_place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = None
            for batch in batches:
                for start in range(0, len(batch), VECTORS_PER_PRODUCT):
                    found = score(batch.iloc[start : start + VECTORS_PER_PRODUCT], shipped.value)
                    best = found if best is None else pd.concat([best, found])
                    if len(best) > 2 * ceiling * len(shipped.value) + 100_000:
                        best = _first(best, ceiling)
            if best is not None:
                yield _first(best, ceiling)

        return vectors.mapInPandas(in_place, schema)

    found = vectors.sparkSession.createDataFrame([], schema)
    blocks = -(-queries.count() // QUERIES_PER_BLOCK)
    if blocks > 1:  # dealt by hash, so blocks have about that many queries; written once for all of them
        queries = materialize(queries.withColumn("__block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))), "query-blocks")
    for n in range(blocks):
        # One block at a time is on the driver.
        part = queries.where(F.col("__block") == n).drop("__block") if blocks > 1 else queries
        found = found.unionByName(against(part.toPandas()))
    ranked = top_rows(found, ["query_id", "grp"], [F.col("distance"), F.col("vec_id")], ceiling)
    if isinstance(k, dict):
        limit = F.when(F.lit(False), 0)
        for name, n in k.items():
            limit = limit.when(F.col("grp") == name, n)
        ranked = ranked.where(F.col("rank") <= limit)
    return ranked
