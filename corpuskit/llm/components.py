"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.session import materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``(node, root)`` of every node that ``edges (u, v)`` names; root: the smallest.

    Each round links every node to the smallest node it has seen.  A star of
    any size stays a table of pairs: its centre's row count is summed up before
    the shuffle and its join is one that Spark can split.  Every round is
    written to the shared folder, so lineage stays short and survives a lost
    executor.  Loops, repeated and reversed edges do no harm; no edges give no
    rows.
    """
    down = lambda a, b: [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]
    now = materialize(edges.where("u <> v").select(*down("u", "v")).distinct(), label)
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, label)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(*down("v", "m")).unionByName(low.select("u", F.col("m").alias("v")))
        now = materialize(small.distinct(), label)
        before, mark = mark, _mark(now)
        if before == mark:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
