"""Candidates for set similarity by MinHash signatures and banded buckets.

Two sets agree in a place of their signatures with a probability equal to their
Jaccard similarity.  Signatures are cut into bands; sets that agree in a whole
band meet in its bucket.  The exact join finds every pair; this finds nearly
every pair from a threshold up with work that does not depend on how common
single tokens are.  What is found is verified on the sets, so nothing is found
that is not there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.operators.sketches import may_be_similar, sketch
from corpuskit.session import materialize

#: Permutations and rows of a band: at a similarity of 0.6 a pair meets in one of 32 bands with a probability of 0.988.
PERMUTATIONS, ROWS = 128, 4
#: Sets of a bucket that one task holds against each other.
TILE = 5_000
#: 1,024 places tell sets of up to some 800 tokens apart.
SKETCH_WORDS = 16
SEED = 7


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    odd = rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd[:, None], rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)[:, None]


def signature(tokens: Column) -> Column:
    """128 minima over the hashes of a set's tokens; all the same for an empty set."""

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        factor, shift = _permutations()
        for sets in batches:
            out = []
            for hashes in sets:
                low = np.full(PERMUTATIONS, np.uint64((1 << 64) - 1))
                # In blocks, so that a set of any size takes little memory.
                for at in range(0, len(hashes), 4096):
                    part = hashes[at : at + 4096].astype(np.int64).view(np.uint64)
                    mixed = part[None, :] * factor + shift
                    low = np.minimum(low, (mixed ^ (mixed >> np.uint64(29))).min(axis=1))
                out.append((low >> np.uint64(32)).astype(np.int64))
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(of, "array<long>")(F.transform(tokens, lambda t: F.xxhash64(t)))


def banded(sets: DataFrame) -> DataFrame:
    """``set_id``, ``n``, ``sketch`` and a ``bucket`` for every band of the set's signature, from signatures written once."""
    signed = sets.select("set_id", "n", sketch(F.col("tokens"), F.lit(SKETCH_WORDS)).alias("sketch"), signature(F.col("tokens")).alias("sig"))
    bands = F.transform(F.sequence(F.lit(0), F.lit(PERMUTATIONS // ROWS - 1)), lambda b: F.xxhash64(b, F.slice("sig", b * ROWS + 1, ROWS)))
    signed = materialize(signed.select("set_id", "n", "sketch", bands.alias("buckets")), "signatures")
    return signed.select("set_id", "n", "sketch", F.explode("buckets").alias("bucket"))


def minhash_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(short_id, long_id)`` of ``sets (set_id, tokens, n)`` that share a bucket and may reach ``threshold`` by their sizes and sketches.

    A bucket of many sets is cut into blocks, and every pair of blocks is a tile
    of its own, so no task holds a bucket.  Unlike sets that share a bucket by
    chance grow with the square of the sets; their sketches end them in the join.
    """
    rows = banded(sets)
    # one row per TILE rows at most
    blocks = F.broadcast(rows.groupBy("bucket").agg(F.count("*").alias("m")).where(F.col("m") > TILE).select(
        "bucket", F.ceil(F.col("m") / TILE).cast("int").alias("blocks")))
    placed = rows.join(blocks, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn(
        "block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    tile = lambda other: F.struct(F.least("block", other).alias("i"), F.greatest("block", other).alias("j"))
    spread = placed.select("bucket", "set_id", "n", "sketch", "block", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), tile)).alias("tile"))
    side = lambda c: spread.select("bucket", "tile", *[F.col(x).alias(f"{c}_{y}") for x, y in (("set_id", "id"), ("n", "n"), ("sketch", "sketch"), ("block", "block"))])
    c = F.col
    in_order = (c("short_n") < c("long_n")) | ((c("short_n") == c("long_n")) & (c("short_id") < c("long_id")))
    # In the tile of two blocks only sets of different blocks meet.
    own = (c("tile.i") == c("tile.j")) | (c("short_block") != c("long_block"))
    long_enough = c("short_n") >= c("long_n") * threshold - 1e-6
    met = side("short").join(side("long"), ["bucket", "tile"]).where(in_order & own & long_enough & may_be_similar(threshold))
    return met.select("short_id", "long_id").distinct()
