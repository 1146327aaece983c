"""Running values over ordered groups of any size.

A plain window puts a whole group into one task.  Here a group is cut into
buckets along its order: each bucket is scanned by its own window, a one-row
summary per bucket is scanned once more, and what earlier buckets carry over is
joined back.  A group that holds a third of all rows is thus spread over as
many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET = "__bucket"


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    *,
    last: dict[str, Column] | None = None,
    before: dict[str, Column] | None = None,
    total: dict[str, Column] | None = None,
) -> DataFrame:
    """Add running columns to ``df``.

    ``keys`` name the group (no NULLs), ``order`` its total order, ``bucket``
    a value that never decreases along the order.

    * ``last``: latest non-NULL value up to and including the row
    * ``before``: latest non-NULL value before the row
    * ``total``: running sum including the row
    """
    last, before, total = last or {}, before or {}, total or {}
    seen = {**{n: (c, False) for n, c in last.items()}, **{n: (c, True) for n, c in before.items()}}
    base = df.withColumn(_BUCKET, bucket)
    for name, (value, _) in seen.items():
        base = base.withColumn(f"__v_{name}", value)
    for name, value in total.items():
        base = base.withColumn(f"__v_{name}", value)

    up_to = Window.partitionBy(*keys, _BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys, _BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = base
    for name, (_, strict) in seen.items():
        local = local.withColumn(f"__l_{name}", F.last(f"__v_{name}", True).over(ahead if strict else up_to))
    for name in total:
        local = local.withColumn(f"__l_{name}", F.sum(f"__v_{name}").over(up_to))

    position = F.struct(*order)
    summary = base.groupBy(*keys, _BUCKET).agg(
        *[F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), position)).alias(f"__s_{n}") for n in seen],
        *[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in total],
    )
    earlier = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *keys, _BUCKET,
        *[F.last(f"__s_{n}", True).over(earlier).alias(f"__c_{n}") for n in seen],
        *[F.sum(f"__s_{n}").over(earlier).alias(f"__c_{n}") for n in total],
    )
    joined = local.join(carried, [*keys, _BUCKET], "left")
    out = [F.col(c) for c in df.columns if c not in seen and c not in total]
    out += [F.coalesce(F.col(f"__l_{n}"), F.col(f"__c_{n}")).alias(n) for n in seen]
    out += [(F.coalesce(F.col(f"__l_{n}"), F.lit(0)) + F.coalesce(F.col(f"__c_{n}"), F.lit(0))).alias(n) for n in total]
    return joined.select(*out)


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int | Column, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of each group with their rank.

    Spark drops rows beyond ``n`` before the shuffle, so a hot group costs each
    map task at most ``n`` rows.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)
