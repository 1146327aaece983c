"""Mixing sources to target weights by entropy balancing.

Each source is to give a number of words.  Of all ways to repeat documents, at
most ``LIMIT`` times, that meet the numbers, entropy balancing takes the rates
closest to one (least relative entropy): a document of ``size`` words gets the
rate ``min(LIMIT, exp(lambda * size))``, where ``lambda`` is its source's.  The
lambdas solve a convex dual problem, one constraint a source, by Newton steps
inside a bracket: each step sums gradient and curvature over the distinct
sizes of every source, and the lambdas stay a table.

Rates become copies by rounding running sums from long documents to short ones,
so that what one size has too much the next has too little; what is then left
of a source's number is made up by a few copies more or less of one size or two.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.llm.sharding import running
from corpuskit.operators.scan import ordered_scan
from corpuskit.session import materialize

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: No document comes more often.
LIMIT = 3
#: Newton steps and rounds of making up at most; both end as soon as nothing changes.
STEPS, REPAIRS = 80, 12
#: A source's words are met to this share, or to half a word.
CLOSE = 1e-9
#: Distinct sizes in one bucket of a running sum.
SIZES = 256
WORD = r"[^\x20\x09-\x0D]+"

_SOURCE = ["none", "source"]


def _exact(value: Column) -> Column:
    """For sums that do not depend on the order of their terms."""
    return value.cast("decimal(30,6)")


def ordered_sources(cells: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """``none``, ``source``, ``total`` and ``weight`` per source; they take the weights by code point, NULL last."""
    totals = cells.groupBy(*_SOURCE).agg(
        F.sum(F.col("size") * F.col("n")).alias("total"), _sum(F.col("size").cast("double") * F.col("size") * F.col("n")).alias("squares"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    ranged = materialize(totals.repartitionByRange(*_SOURCE).withColumns({"range": F.spark_partition_id(), "all": F.lit(0)}), "mix-sources")
    numbered = ordered_scan(ranged, ["all"], _SOURCE, F.col("range"), total={"number": F.lit(1)})
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("number") - 1) % len(weights) + 1).cast("int"))
    return materialize(numbered.select(*_SOURCE, "total", "squares", "least", weight.cast("double").alias("weight")), "mix-weights")


def _sum(value: Column) -> Column:
    return F.sum(_exact(value)).cast("double")


def with_targets(sources: DataFrame, limit: int) -> DataFrame:
    """``sources`` with ``target``: shares of all words by weight, none above ``limit`` times the source's own.

    What a source cannot take goes to the others by weight until none is above.
    """
    cap = F.col("total") * limit
    level, full = None, -1
    while True:
        capped = F.lit(False) if level is None else F.col("weight") * level >= cap
        words, taken, weight, n = sources.agg(
            F.sum("total"), F.sum(F.when(capped, cap).otherwise(F.lit(0))), F.sum(F.when(capped, F.lit(0.0)).otherwise(F.col("weight"))), F.count_if(capped)).first()
        if not words or not weight or n == full:
            break
        level, full = (words - taken) / weight, n
    target = F.lit(0.0) if level is None else F.least(cap.cast("double"), F.col("weight") * level)
    return sources.withColumn("target", target)


def _start(sources: DataFrame, limit: int) -> DataFrame:
    """First lambdas (of sizes in units of the source's mean) and brackets; ``open`` where there is something to solve."""
    mean = F.col("squares") / F.col("total")
    unit = sources.withColumn("mean", F.when(F.col("total") > 0, mean).otherwise(F.lit(1.0)))
    want = F.log(F.col("target") / F.col("total"))
    spread = F.col("mean") / F.col("least")
    solve = (F.col("total") > 0) & (F.col("target") > 0) & (F.col("target") < F.col("total") * limit)
    return unit.select(
        *_SOURCE, "total", "target", "mean", F.when(solve, want).otherwise(F.lit(0.0)).alias("x"),
        F.when(solve, F.least(F.lit(0.0), want * spread)).otherwise(F.lit(0.0)).alias("low"), F.when(solve, F.lit(math.log(limit)) * spread).otherwise(F.lit(0.0)).alias("high"),
        solve.alias("open"), ((F.col("total") > 0) & (F.col("target") >= F.col("total") * limit)).alias("full"))


def rate(limit: int) -> Column:
    """The rate of a document of ``size`` words under its source's ``x``."""
    tilted = F.exp(F.least(F.col("x") * F.col("size") / F.col("mean"), F.lit(math.log(limit))))
    return F.when(F.col("full"), F.lit(float(limit))).otherwise(F.least(tilted, F.lit(float(limit))))


def balanced(cells: DataFrame, sources: DataFrame, limit: int) -> DataFrame:
    """``sources`` with the ``x`` that meets each target, by Newton steps on the dual."""
    now = materialize(_start(sources, limit), "mix-dual")
    for _ in range(STEPS):
        todo = now.where("open")
        if todo.isEmpty():
            break
        words = F.col("size") * F.col("n") * rate(limit)
        bend = F.when(F.col("x") * F.col("size") / F.col("mean") < math.log(limit), words * F.col("size") / F.col("mean")).otherwise(F.lit(0.0))
        sums = cells.join(todo, _SOURCE).groupBy(*_SOURCE).agg(_sum(words).alias("words"), _sum(bend).alias("bend"))
        over = F.col("words") - F.col("target")
        near = F.abs(over) <= F.greatest(F.lit(0.5), F.col("target") * CLOSE)
        moved = now.join(sums, _SOURCE, "left").withColumns({
            "low": F.when(over < 0, F.col("x")).otherwise(F.col("low")), "high": F.when(over > 0, F.col("x")).otherwise(F.col("high"))})
        step = F.col("x") - over / F.nullif(F.col("bend"), F.lit(0.0))
        inside = (step > F.col("low")) & (step < F.col("high"))
        stuck = F.col("high") - F.col("low") <= F.abs(F.col("x")) * 1e-15
        x = F.when(~F.col("open") | near, F.col("x")).when(inside, step).otherwise((F.col("low") + F.col("high")) / 2)
        now = materialize(moved.withColumns({"next": x, "open": F.col("open") & ~near & ~stuck}).select(
            *_SOURCE, "total", "target", "mean", F.col("next").alias("x"), "low", "high", "open", "full"), "mix-dual")
    return now


def rounded(cells: DataFrame, sources: DataFrame, limit: int) -> DataFrame:
    """``cells`` with ``rate`` and ``copies`` of all their documents together."""
    rated = cells.join(sources, _SOURCE).withColumns({"rate": rate(limit), "down": -F.col("size")})
    rated = materialize(rated.select(*_SOURCE, "size", "n", "down", "rate", _exact(F.col("n") * F.col("rate")).alias("share")), "mix-rates")
    # From long to short, so the sums are off by half a document of about that size.
    summed = ordered_scan(rated, _SOURCE, ["down"], F.floor(F.col("down") / SIZES), total={"upto": F.col("share")})
    whole = lambda c: F.floor(c + F.lit(0.5)).cast("long")
    copies = F.least(whole(F.col("upto")) - whole(F.col("upto") - F.col("share")), F.col("n") * limit)
    now = materialize(summed.select(*_SOURCE, "size", "n", "rate", copies.alias("copies")), "mix-copies")
    for find in (_one_size, _two_sizes):
        for _ in range(REPAIRS):
            took = now.groupBy(*_SOURCE).agg(F.sum(F.col("size") * F.col("copies")).alias("took"))
            gap = took.join(sources.where("not full").select(*_SOURCE, "target"), _SOURCE).select(*_SOURCE, (F.col("target") - F.col("took")).alias("gap"))
            best = materialize(find(now.where("size > 0"), gap.where("abs(gap) > 0.5"), limit), "mix-repairs")
            if best.isEmpty():
                break
            now = materialize(now.join(best, [*_SOURCE, "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0))).drop("more"), "mix-copies")
    return now


def _one_size(cells: DataFrame, gap: DataFrame, limit: int) -> DataFrame:
    """``more`` copies of the one ``size`` of a source that comes closest to its ``gap``."""
    may = F.when(F.col("gap") > 0, F.col("n") * limit - F.col("copies")).otherwise(F.col("copies"))
    move = F.least(may, F.round(F.abs("gap") / F.col("size")).cast("long"))
    tried = cells.join(gap, _SOURCE).withColumn("move", move).withColumn("left", F.abs(F.abs("gap") - F.col("move") * F.col("size")))
    more = (F.col("move") * F.signum("gap").cast("long")).alias("more")
    best = tried.where(F.col("left") + 1e-6 < F.abs("gap")).groupBy(*_SOURCE).agg(F.min(F.struct("left", "size", more)).alias("b"))
    return best.select(*_SOURCE, "b.size", "b.more")


def _two_sizes(cells: DataFrame, gap: DataFrame, limit: int) -> DataFrame:
    """A copy more of one size and one less of another whose difference comes closest to the ``gap``.

    Both lists of sizes lie on one line, one moved by the gap, and neighbours
    meet.  A source has at most ``sqrt(2 * its words)`` sizes to sort.
    """
    open_ = cells.join(gap, _SOURCE)
    at = lambda less: F.struct((F.col("size") + (F.col("gap") if less else 0)).alias("place"), F.lit(less).alias("less"), F.col("size").alias("size"))
    put = F.filter(F.array(F.when(F.col("copies") < F.col("n") * limit, at(False)), F.when(F.col("copies") > 0, at(True))), lambda x: x.isNotNull())
    line = open_.select(*_SOURCE, "gap", F.explode(put).alias("x")).select(*_SOURCE, "gap", "x.*")
    order = Window.partitionBy(*_SOURCE).orderBy("place", "less", "size")
    more = F.when(~F.col("less"), F.struct("place", "size"))
    near = line.withColumns({"before": F.last(more, True).over(order.rowsBetween(Window.unboundedPreceding, -1)), "after": F.first(more, True).over(order.rowsBetween(1, Window.unboundedFollowing))})
    pairs = near.where("less").select(*_SOURCE, "gap", "place", "size", F.explode(F.array("before", "after")).alias("m")).where("m is not null")
    left = F.abs(F.col("place") - F.col("m.place")).alias("left")
    best = pairs.select(*_SOURCE, "gap", F.struct(left, F.col("m.size").alias("add"), "size").alias("b")).where(F.col("b.left") + 1e-6 < F.abs("gap"))
    best = best.groupBy(*_SOURCE).agg(F.min("b").alias("b"))
    both = F.array(F.struct(F.col("b.add").alias("size"), F.lit(1).cast("long").alias("more")), F.struct(F.col("b.size").alias("size"), F.lit(-1).cast("long").alias("more")))
    return best.select(*_SOURCE, F.explode(both).alias("x")).select(*_SOURCE, "x.*")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often each row of ``docs`` goes into the mix.

    Returns ``id_col``, ``size`` (words of the text), ``source_size`` (of all
    rows of the source), ``target`` (words the source is to give), ``rate``,
    ``copies`` and ``taken`` (words the mix takes of the row).  Sources in the
    order of code points, NULL last, have ``weights`` one after another, and
    share as many words as there are; no source gives more than ``limit`` times
    its own, and no row comes more than ``limit`` times.

    A NULL, empty or blank text has size 0 and takes nothing.  A source without
    words has target 0.  Repeated rows are rows of their own, rows of one size
    and source take copies by the hash of their id, NULL ids stay.  Other
    columns are ignored, an empty table gives an empty table.  Sums are exact,
    so a second run gives the same.
    """
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    rows = materialize(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).isNull().alias("none"), source.alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "mix-rows")
    cells = materialize(rows.groupBy(*_SOURCE, "size").agg(F.count("*").alias("n")), "mix-cells")
    sources = balanced(cells, materialize(with_targets(ordered_sources(cells, weights), limit), "mix-targets"), limit)
    parts = rounded(cells, sources, limit).withColumns({"base": F.floor(F.col("copies") / F.col("n")), "extra": F.col("copies") % F.col("n")})
    parts = materialize(parts.join(sources.select(*_SOURCE, F.col("total").alias("source_size"), "target"), _SOURCE), "mix-parts")
    held = rows.join(parts, [*_SOURCE, "size"])
    # Only where the documents of a size differ in copies do they have to be numbered.
    even = held.where("extra = 0").withColumn("at", F.lit(0).cast("long"))
    uneven = running(held.where("extra > 0"), [*_SOURCE, "size"], F.lit(1), ["id"], rows.count(), "at")
    both = even.unionByName(uneven).withColumn("copies", F.col("base") + (F.col("at") < F.col("extra")).cast("long"))
    return both.select(F.col("id").alias(id_col), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
