"""Prefix trie of conversations, rolled up along a centroid decomposition.

Every distinct sequence of first turns is a node; its parent is the sequence
without the last turn.  A node is known by its smallest member and its depth.
Sums over subtrees come from the parent edges by centroid decomposition: a
component is split at its centroid, the total of what lies below the centroid is
worked out at once and added to all nodes from the centroid up to the
component's top, and the components that are left, none heavier than half, go
the same way.  A trie of any depth and any width thus takes a number of rounds
that grows with the logarithm of its weight.

Two things make a round a few joins.  The members of a node and how far each
goes on give its weight below without a walk over the tree; and the nodes that
hold more than half of a component's weight are just those between its top and
its centroid.  What becomes of another node is read from one row: where the
conversation that names it stands one turn below the centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.operators.scan import ordered_scan
from corpuskit.session import materialize

#: Components of so many nodes at most are summed up in one task.
SMALL = 1024
#: Turns of a conversation in one bucket of a running value, and the range of ids in a part of a list.
BUCKET = 4096
#: Most turns that a rebuilt conversation takes from another, and how many ids share the other.
HEAD, FAMILY = 5, 100


def numbered_turns(turns: DataFrame) -> DataFrame:
    """``conv``, ``pos`` (from 1), ``h1``, ``h2`` (128 bits of role and text) and ``chars`` of every turn.

    Turns come by ``turn``, NULL first, then by the hash of role and text.  Rows
    are dealt out by ranges of that order, so a conversation of any length is
    numbered by many tasks.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("at"), F.xxhash64(F.lit(1), role, text).alias("h1"),
        F.xxhash64(F.lit(2), role, text).alias("h2"), F.length(text).cast("long").alias("chars"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    # Equal rows may come in any order.
    ranged = materialize(slim.repartitionByRange("conv", "at", "h1", "salt").withColumn("range", F.spark_partition_id()), "trie-turns")
    placed = ordered_scan(ranged, ["conv"], ["at", "h1", "salt"], F.col("range"), total={"pos": F.lit(1).cast("long")})
    return placed.select("conv", "pos", "h1", "h2", "chars")


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv``, ``depth``, ``h1``, ``h2``, ``chars`` and ``length`` of rebuilt conversations, depth 0 included.

    The first ``h`` turns come from the conversation whose id ends in two
    zeros, the others are the conversation's own behind its first ``h``.
    """
    own = materialize(numbered_turns(turns), "trie-numbered")
    heads = own.where((F.col("pos") <= HEAD) & (F.col("conv") % FAMILY == 0)).withColumnRenamed("conv", "base")
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % (HEAD + 1)
    convs = own.groupBy("conv").agg(F.max("pos").alias("n")).withColumn("h", taken).withColumn("base", F.col("conv") - F.col("conv") % FAMILY)
    lent = heads.groupBy("base").agg(F.count("*").alias("lent"))
    convs = convs.join(lent, "base", "left").withColumn("lent", F.least("h", F.coalesce("lent", F.lit(0))))
    convs = materialize(convs.withColumn("length", F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "trie-conversations")
    put = ["conv", "depth", "h1", "h2", "chars", "length"]
    first = convs.join(heads, "base").where("pos <= h").withColumnRenamed("pos", "depth").select(put)
    later = own.join(convs, "conv").where("pos > h").withColumn("depth", F.col("lent") + F.col("pos") - F.col("h")).select(put)
    none = F.lit(0).cast("long")
    root = convs.select("conv", none.alias("depth"), none.alias("h1"), none.alias("h2"), none.alias("chars"), "length")
    return root.unionByName(first).unionByName(later)


def members(rows: DataFrame) -> DataFrame:
    """``rows`` with ``x1``, ``x2``, which stand for the turns up to ``depth``, and ``p1``, ``p2`` for those before.

    A sequence stands for the exclusive or of its turns' hashes, each taken
    together with its depth, so buckets of a long conversation add up.
    """
    hashed = lambda seed: F.when(F.col("depth") > 0, F.xxhash64(F.lit(seed), "depth", "h1", "h2")).otherwise(F.lit(0).cast("long"))
    put = rows.withColumns({"g1": hashed(3), "g2": hashed(4), "bucket": F.floor(F.col("depth") / BUCKET)})
    inside = Window.partitionBy("conv", "bucket").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    put = put.withColumns({"l1": F.bit_xor("g1").over(inside), "l2": F.bit_xor("g2").over(inside)})
    ahead = Window.partitionBy("conv").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = put.where(F.col("length") >= BUCKET).groupBy("conv", "bucket").agg(F.bit_xor("g1").alias("s1"), F.bit_xor("g2").alias("s2"))
    sums = sums.select("conv", "bucket", F.bit_xor("s1").over(ahead).alias("c1"), F.bit_xor("s2").over(ahead).alias("c2"))
    mix = lambda i: F.col(f"l{i}").bitwiseXOR(F.coalesce(f"c{i}", F.lit(0))).alias(f"x{i}")
    joined = put.join(sums, ["conv", "bucket"], "left").select("conv", "depth", "chars", "length", "g1", "g2", mix(1), mix(2))
    before = lambda i: F.col(f"x{i}").bitwiseXOR(F.col(f"g{i}")).alias(f"p{i}")
    return joined.select("conv", "depth", "chars", "length", "x1", "x2", before(1), before(2))


def trie_nodes(rows: DataFrame) -> DataFrame:
    """Nodes of ``members``: ``owner`` (smallest member), ``depth``, ``up`` (the parent's owner), ``x1``, ``x2``,
    ``n_convs``, ``n_children``, ``chars`` and ``below`` (members of all nodes of the subtree together)."""
    key = ["depth", "x1", "x2"]
    nodes = rows.groupBy(*key).agg(
        F.min("conv").alias("owner"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("below"))
    nodes = materialize(nodes, "trie-keys")
    parent = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("owner").alias("up"))
    linked = nodes.join(parent, ["depth", "p1", "p2"], "left")
    children = linked.where("depth > 0").groupBy(F.col("up").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    out = linked.join(children, ["owner", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    return materialize(out.select("owner", "depth", "up", "x1", "x2", "n_convs", "n_children", "chars", "below"), "trie-nodes")


def _summed(values: list[str]):
    """A task's work on small components: every subtree's sums, added to what is there."""

    def of(block: pd.DataFrame) -> pd.DataFrame:
        block = block.reset_index(drop=True)
        place = pd.MultiIndex.from_frame(block[["top", "top_depth", "owner", "depth"]])
        parent = pd.MultiIndex.from_arrays([block["top"], block["top_depth"], block["up"], block["depth"] - 1])
        at = place.get_indexer(parent)
        at[block["depth"] == block["top_depth"]] = -1
        sums = block[values].copy()
        for _, rows in sorted(block.groupby(block["depth"] - block["top_depth"]).groups.items(), reverse=True):
            inner = rows[at[rows] >= 0]
            if len(inner):
                add = sums.loc[inner].groupby(at[inner]).sum()
                sums.loc[add.index] += add
        return pd.DataFrame({"owner": block["owner"], "depth": block["depth"], **{f"sum_{v}": block[f"sum_{v}"] + sums[v] for v in values}})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            batch = batch.astype({"up": "Int64"}).fillna({"up": -1}).astype({"up": "int64"})
            block = batch if held is None else pd.concat([held, batch])
            # The last component may go on in the next batch.
            last = block.iloc[-1]
            open_ = (block["top"] == last["top"]) & (block["top_depth"] == last["top_depth"])
            held, block = block[open_], block[~open_]
            if len(block):
                yield of(block)
        if held is not None:
            yield of(held)

    return run


def rollup(nodes: DataFrame, paths: DataFrame, values: list[str], small: int = SMALL) -> DataFrame:
    """``owner``, ``depth`` and ``sum_<value>`` of every node's subtree, itself included.

    ``nodes`` is a tree: ``owner``, ``depth``, ``up`` (the parent's owner, NULL
    for the root) and ``below``, positive weights summed over the subtree.
    ``paths`` has ``conv``, ``depth``, ``at`` and ``up``: the node (and its
    parent) at which each owner stands at each depth; it is read only if there
    are over ``small`` nodes.  No nodes give no rows.
    """
    top, sums = ["top", "top_depth"], [f"sum_{v}" for v in values]
    none = F.lit(0).cast("long")
    # Written, as a join on columns that are constants would be none by keys.
    state = materialize(nodes.select("owner", "depth", "up", "below", *values, *[none.alias(s) for s in sums], none.alias("top"), none.alias("top_depth")), "trie-components")
    ready, done, steps = [], [], None
    while True:
        sized = state.groupBy(*top).agg(F.max("below").alias("whole"), F.count("*").alias("n"))
        large = materialize(sized.where(F.col("n") > small), "trie-large")
        if large.isEmpty():
            ready.append(state)
            break
        if steps is None:
            steps = materialize(paths, "trie-paths")
        heavy = state.join(large, top).where(F.col("below") * 2 > F.col("whole"))
        centre = heavy.groupBy(*top).agg(F.max("whole").alias("whole"), F.max(F.struct("depth", "owner", "below")).alias("c"))
        centre = materialize(centre.select(*top, "whole", F.col("c.depth").alias("c_depth"), F.col("c.owner").alias("c_owner"), F.col("c.below").alias("c_below")), "trie-centroids")
        ready.append(state.join(centre.select(*top), top, "left_anti"))
        asked = state.join(centre, top).withColumn("ask", F.when(F.col("depth") > F.col("c_depth"), F.col("c_depth") + 1))
        step = steps.select(F.col("conv").alias("owner"), F.col("depth").alias("ask"), "at", F.col("up").alias("at_up"))
        held = asked.join(step, ["owner", "ask"], "left").withColumns({
            "under": F.coalesce(F.col("at_up") == F.col("c_owner"), F.lit(False)),
            "is_c": (F.col("owner") == F.col("c_owner")) & (F.col("depth") == F.col("c_depth")),
            "on_way": F.col("below") * 2 > F.col("whole")})
        held = materialize(held, "trie-split")
        totals = held.where("under or is_c").groupBy(*top).agg(*[F.sum(v).alias(f"total_{v}") for v in values])
        added = held.join(totals, top).withColumns({f"sum_{v}": F.col(f"sum_{v}") + F.when(F.col("on_way"), F.col(f"total_{v}")).otherwise(F.lit(0)) for v in values})
        added = added.withColumn("below", F.col("below") - F.when(F.col("on_way"), F.col("c_below")).otherwise(F.lit(0)))
        moved = added.select(
            "owner", "depth", "up", "below", *values, *sums, "is_c",
            F.when(F.col("under"), F.col("at")).otherwise(F.col("top")).alias("top"), F.when(F.col("under"), F.col("c_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"))
        moved = materialize(moved, "trie-components")
        done.append(moved.where("is_c").select("owner", "depth", *sums))
        state = moved.where("not is_c").drop("is_c")
    whole = ready[0]
    for part in ready[1:]:
        whole = whole.unionByName(part)
    schema = "owner long, depth long, " + ", ".join(f"{s} long" for s in sums)
    # A component has at most ``small`` nodes, so no task holds more than a batch and that.
    dealt = whole.repartition(*top).sortWithinPartitions(*top)
    out = dealt.select("owner", "depth", "up", *values, *sums, *top).mapInPandas(_summed(values), schema)
    for part in done:
        out = out.unionByName(part)
    return out


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the parts of each node's list, which come in order, one node after another."""
    now, state, out = None, None, []
    for batch in batches:
        for depth, x1, x2, part in zip(batch["depth"], batch["x1"], batch["x2"], batch["part"], strict=True):
            if (depth, x1, x2) == now:
                state.update(b",")
            else:
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = (depth, x1, x2), hashlib.sha256()
            state.update(part.encode())
        yield pd.DataFrame(out, columns=["depth", "x1", "x2", "ends_sha256"])
        out = []
    if now is not None:
        yield pd.DataFrame([(*now, state.hexdigest())], columns=["depth", "x1", "x2", "ends_sha256"])


def ends_digests(rows: DataFrame) -> DataFrame:
    """``depth``, ``x1``, ``x2``, ``ends_sha256``: a hash of the ids, in order, of members that end at a node.

    Ids of one range of ``BUCKET`` numbers become one part of the list; a node's
    parts pass through its task one by one and are never held together.
    """
    key = ["depth", "x1", "x2"]
    ends = rows.where("depth = length").withColumn("range", F.shiftright("conv", BUCKET.bit_length() - 1))
    part = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    parts = ends.groupBy(*key, "range").agg(part.alias("part"))
    dealt = parts.repartition(*key).sortWithinPartitions(*key, "range")
    return dealt.select(*key, "part").mapInPandas(_digests, "depth long, x1 long, x2 long, ends_sha256 string")


def conversation_trie(turns: DataFrame, small: int = SMALL) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations of ``turns``.

    ``turns`` has ``conv_id``, ``turn``, ``role`` and ``text``.  Returns per node
    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (NULL for the
    root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and
    ``ends_sha256``.

    A NULL role or text counts as empty, a NULL turn comes first; turns with the
    same number come by a hash of role and text, and repeated rows are turns of
    their own.  Rows without ``conv_id`` belong to no conversation and are left
    out.  Other columns are ignored.  An empty table has no members, thus no
    nodes.  ``small`` only sets what is summed in one task, not the result.
    """
    rows = materialize(members(rebuilt(turns.select("conv_id", "turn", "role", "text"))), "trie-members")
    nodes = trie_nodes(rows).withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")})
    key = ["depth", "x1", "x2"]
    owners = nodes.select(F.col("owner").alias("conv")).distinct()
    paths = rows.join(owners, "conv", "left_semi").join(nodes.select(*key, F.col("owner").alias("at"), "up"), key).select("conv", "depth", "at", "up")
    summed = rollup(nodes, paths, ["leaves", "saved"], small)
    found = nodes.join(summed, ["owner", "depth"]).join(ends_digests(rows), key, "left")
    return found.select(
        F.col("owner").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", F.col("sum_leaves").alias("n_leaves"),
        F.col("sum_saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


#: The same in DuckDB's SQL: prefixes as lists, and a row for every node and every prefix of it.
SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn NULLS FIRST, role, text) AS turns FROM c GROUP BY conv_id),
h AS (
  SELECT conv_id, turns, xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::UBIGINT)),
    lambda x, b: list_reduce(list_concat([xor(x, b)], [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384::UBIGINT) ELSE y // 2 END)),
    4294967295::UBIGINT) % 6 AS h FROM o),
b AS (
  SELECT h.conv_id, list_concat(coalesce(list_slice(f.turns, 1, h.h::BIGINT), []), list_slice(h.turns, h.h::BIGINT + 1, len(h.turns))) AS turns
  FROM h LEFT JOIN o f ON f.conv_id = h.conv_id - h.conv_id % 100),
m AS (SELECT conv_id, d, list_slice(turns, 1, d) AS p, d = len(turns) AS ends FROM b, unnest(range(0, len(turns) + 1)) AS u(d)),
n AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM m GROUP BY p, d),
k AS (SELECT list_slice(p, 1, d - 1) AS p, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
v AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * length(n.p[n.d].t) END AS saved FROM n LEFT JOIN k USING (p, d)),
s AS (SELECT list_slice(p, 1, a) AS p, a AS d, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM v, unnest(range(0, d + 1)) AS u(a) GROUP BY 1, 2)
SELECT v.conv_id, v.d AS depth, q.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, v.ends_sha256
FROM v JOIN s USING (p, d) LEFT JOIN n q ON v.d > 0 AND q.d = v.d - 1 AND q.p = list_slice(v.p, 1, v.d - 1)
"""
