"""Balanced label propagation: linked documents drift into common shards.

Documents that share a key are linked.  They start dealt out evenly; in each
round the members of a key (or of a piece of it, if it is larger than a
shard) want to go where most of them are.  What goes from one shard to another
is held to a quota: as much as comes the other way, and a part of the free
room.  Then whole groups are seated, the largest first: in the shard where most
of a group is, else where there is room for all of it; only a group that fits
nowhere is cut, into as few parts as it can.  Documents without links are dealt out last, into the room that is left,
so the counts of the shards end at most one apart.

Everything that grows with the corpus is a table; only the sums of flows
between shards, as many as pairs of shards, and the counts of groups by size and
shard come to the driver; there are at most about sqrt(2 * rows) sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.llm.components import components
from corpuskit.session import materialize

SHARDS = 8
ROUNDS = 8
#: Rows that one bucket of a numbering holds, about.
BUCKET = 4096


def running(df: DataFrame, by: list[str], amount: Column, order: list[str], rows: int, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``amount`` over the rows of ``by`` that come before.

    Rows come by the hash of ``order``, which makes buckets, then by ``order``.
    A group of any size is summed bucket by bucket.
    """
    width = max(64, rows // BUCKET)
    put = df.withColumns({"__b": F.pmod(F.xxhash64(*order), F.lit(width)), "__a": amount})
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = put.groupBy(*by, "__b").agg(F.sum("__a").alias("__s")).withColumn("__f", F.coalesce(F.sum("__s").over(before), F.lit(0)))
    inside = Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = put.join(sums.drop("__s"), [*by, "__b"])
    return summed.withColumn(name, F.col("__f") + F.coalesce(F.sum("__a").over(inside), F.lit(0))).drop("__b", "__a", "__f")


def quotas(flows: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many may go from ``i`` to ``j``: as many as come back, and shares of the room in ``j``."""
    out = {(i, j): min(n, flows.get((j, i), 0)) for (i, j), n in flows.items()}
    rest = {ij: n - out[ij] for ij, n in flows.items()}
    for j, free in enumerate(room):
        wanted = sum(n for (_, to), n in rest.items() if to == j)
        for i in range(len(room)):
            if n := rest.get((i, j), 0):
                out[i, j] += min(n, free * n // wanted)
    return {ij: n for ij, n in out.items() if n}


def _pairs(table: dict[tuple[int, int], int]) -> Column:
    return F.create_map(*[F.lit(x) for (i, j), n in table.items() for x in (i * 1000 + j, n)])


def _round(linked: DataFrame, full: list[int], rows: int) -> DataFrame | None:
    """``linked`` after one round, or None if nothing can move."""
    cells = materialize(linked.groupBy("key", "piece", "shard").agg(F.count("*").alias("n")), "shard-cells")
    sizes = dict(cells.groupBy("shard").agg(F.sum("n")).collect())
    room = [full[s] - sizes.get(s, 0) for s in range(len(full))]
    # All members must agree on the shard, so ties fall by a hash of key and shard.
    best = F.max(F.struct("n", F.xxhash64("key", "piece", "shard").alias("tie"), "shard"))["shard"]
    to = cells.groupBy("key", "piece").agg(best.alias("to"))
    moves = cells.join(to, ["key", "piece"]).where("shard <> to")
    flows = {(r[0], r[1]): r[2] for r in moves.groupBy("shard", "to").agg(F.sum("n")).collect()}
    allowed = quotas(flows, room)
    if not allowed:
        return None
    quota = F.coalesce(_pairs(allowed)[F.col("shard") * 1000 + F.col("to")], F.lit(0))
    passed = running(moves, ["shard", "to"], F.col("n"), ["key", "piece"], rows, "ahead")
    passed = passed.withColumn("may", F.least("n", quota - F.col("ahead"))).where("may > 0")
    passed = materialize(passed.select("key", "piece", "shard", "to", "n", "may"), "shard-moves")
    on = ["key", "piece", "shard"]
    whole, part = passed.where("may = n").select(*on, "to"), passed.where("may < n").select(*on, "to", "may")
    # At most one cell of each flow is cut by the quota; its rows are numbered.
    cut = running(linked.join(part, on), on, F.lit(1), ["row"], rows, "at").where("at < may").select("row", F.col("to").alias("cut_to"))
    moved = linked.join(whole, on, "left").join(cut, "row", "left")
    return materialize(moved.select("row", "key", "piece", F.coalesce("to", "cut_to", "shard").alias("shard")), "shard-labels")


def seats(counts: dict[tuple[int, int], int], full: list[int]) -> list[tuple[int, int, int, int, int, int, int]]:
    """Where groups go: ``(size, at, first, last, low, high, shard)``.

    ``counts`` has the number of groups by size and by the shard that most of a
    group is in.  Of the groups of ``size`` that are ``at`` a shard, those
    numbered from ``first`` to below ``last`` put their rows ``low`` to below
    ``high`` into ``shard``.
    """
    room, out = list(full), []
    for size in sorted({n for n, _ in counts}, reverse=True):
        here = {at: c for (n, at), c in counts.items() if n == size}
        done = {}
        for at, c in here.items():
            done[at] = min(c, room[at] // size)
            room[at] -= done[at] * size
            out.append((size, at, 0, done[at], 0, size, at))
        for at, c in here.items():
            while done[at] < c:
                to = max(range(len(room)), key=lambda t: room[t])
                if n := min(c - done[at], room[to] // size):
                    out.append((size, at, done[at], done[at] + n, 0, size, to))
                    room[to] -= n * size
                    done[at] += n
                    continue
                low = 0
                while low < size:
                    to = max(range(len(room)), key=lambda t: room[t])
                    n = min(size - low, room[to])
                    out.append((size, at, done[at], done[at] + 1, low, low + n, to))
                    room[to] -= n
                    low += n
                done[at] += 1
    return [r for r in out if r[2] < r[3]]


def _seated(linked: DataFrame, full: list[int], rows: int) -> DataFrame:
    """``linked`` with whole groups in shards, none of which holds more than ``full``."""
    spark = linked.sparkSession
    cells = linked.groupBy("key", "piece", "shard").agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", F.xxhash64("key", "piece", "shard").alias("tie"), "shard"))["shard"]
    groups = materialize(cells.groupBy("key", "piece").agg(F.sum("n").alias("size"), best.alias("at")), "shard-groups")
    plan = seats({(r[0], r[1]): r[2] for r in groups.groupBy("size", "at").count().collect()}, full)
    plan = spark.createDataFrame(plan, "size long, at int, first long, last long, low long, high long, to int")
    numbered = running(groups, ["size", "at"], F.lit(1), ["key", "piece"], rows, "number")
    placed = numbered.join(F.broadcast(plan), ["size", "at"]).where("number >= first and number < last")
    placed = materialize(placed.select("key", "piece", "size", "low", "high", "to"), "shard-seats")
    whole = placed.where("high - low = size").select("key", "piece", "to")
    parts = placed.where("high - low < size").select("key", "piece", "low", "high", "to")
    cut = running(linked.join(parts.select("key", "piece").distinct(), ["key", "piece"]), ["key", "piece"], F.lit(1), ["row"], rows, "index")
    cut = cut.join(parts, ["key", "piece"]).where("index >= low and index < high")
    seated = linked.join(whole, ["key", "piece"]).unionByName(cut.select(*linked.columns, "to"))
    return materialize(seated.select("row", "key", "piece", F.col("to").alias("shard")), "shard-labels")


def _joined(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` with a key for all that keys and ``edges (u, v)`` of rows link, directly or not."""
    keyed = rows.where("key is not null")
    first = keyed.groupBy("key").agg(F.min("row").alias("v"))
    known = edges.select("u", "v").join(rows.select(F.col("row").alias("u")), "u").join(rows.select(F.col("row").alias("v")), "v")
    roots = components(known.select("u", "v").unionByName(keyed.join(first, "key").select(F.col("row").alias("u"), "v")), "shard-links")
    return materialize(rows.select("row").join(roots.withColumnRenamed("node", "row"), "row", "left").withColumnRenamed("root", "key"), "shard-keys")


def balanced_shards(rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, edges: DataFrame | None = None) -> DataFrame:
    """``row``, ``shard`` and ``slot`` (gapless from 0 in its shard) of every row.

    ``rows`` has ``row`` (unique, not NULL) and ``key``; rows with the same key
    are linked, a NULL key links nothing.  ``edges (u, v)``, if given, link rows
    as well; what they join counts as one key.  A key is cut only if it is larger
    than a shard or fits into none whole.  The counts of the shards are at most
    one apart.  An empty table gives an empty table.
    """
    rows = rows if edges is None else _joined(rows, edges)
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
    total = rows.count()
    full = [total // shards + (s < total % shards) for s in range(shards)]
    many = sizes.where("key is not null and n > 1")
    linked = materialize(rows.select("row", "key").join(many.select("key"), "key"), "shard-linked")
    held = linked.count()
    # A key larger than a shard is cut into pieces that fill one, and a rest.
    limit = max(1, full[-1])
    large = running(linked.join(many.where(F.col("n") > limit).select("key"), "key"), ["key"], F.lit(1), ["row"], total, "at")
    pieces = large.select("row", F.floor(F.col("at") / limit).alias("piece"))
    start = running(linked, [], F.lit(1), ["row"], held, "at").join(pieces, "row", "left")
    linked = materialize(start.select("row", "key", F.coalesce("piece", F.lit(0)).alias("piece"), (F.col("at") % shards).cast("int").alias("shard")), "shard-labels")
    for _ in range(rounds if held else 0):
        after = _round(linked, full, held)
        if after is None:
            break
        linked = after
    linked = _seated(linked, full, held) if held else linked
    taken = dict(linked.groupBy("shard").count().collect())
    placed = running(linked.select("row", "shard"), ["shard"], F.lit(1), ["row"], held, "slot")
    alone = rows.select("row").join(linked.select("row"), "row", "left_anti")
    alone = running(alone, [], F.lit(1), ["row"], total, "at")
    shard, slot, start_at = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s in range(shards):
        room = full[s] - taken.get(s, 0)
        here = (F.col("at") >= start_at) & (F.col("at") < start_at + room)
        shard = F.when(here, F.lit(s)).otherwise(shard)
        slot = F.when(here, F.col("at") - start_at + taken.get(s, 0)).otherwise(slot)
        start_at += room
    return placed.select("row", "shard", "slot").unionByName(alone.select("row", shard.alias("shard"), slot.alias("slot")))


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its shard; equal texts are linked.

    Returns ``id_col``, ``size`` (UTF-8 bytes plus one), ``text_crc32``,
    ``shard`` and ``slot``.  A NULL text counts as empty.  Repeated rows are
    rows of their own, NULL ids stay, other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = materialize(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key")), "shard-rows")
    placed = balanced_shards(slim.select("row", "key"), shards, rounds)
    return slim.drop("key").join(placed, "row").select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")
