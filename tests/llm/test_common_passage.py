"""Sets that only have a passage in common end in the exact join; similar ones come out of it."""

import random

import numpy as np
from pyspark.sql import functions as F

from corpuskit.llm import simhash
from corpuskit.operators.sketches import parities


def test_a_common_passage_gives_no_pairs(spark):
    rng = random.Random(3)
    passage = [rng.getrandbits(62) for _ in range(20)]
    sets = [passage + [rng.getrandbits(62) for _ in range(100)] for _ in range(80)]
    sets += [s[:-2] + [rng.getrandbits(62) for _ in range(2)] for s in sets[:5]]
    rows = [(i, len(s), parities(np.array(s), simhash.SKETCH_WORDS).tolist()) for i, s in enumerate(sets)]
    sketches = spark.createDataFrame(rows, "node long, n int, sketch array<long>")
    shared = sketches.select("node", "n", F.explode(F.array(*map(F.lit, passage))).alias("token"), F.lit(21).alias("band"), F.lit(1).alias("common"))
    roots = spark.createDataFrame([], "node long, root long")
    got = {(r.u, r.v) for r in simhash._apart(shared, roots, sketches).collect()}
    assert got == {(i, 80 + i) for i in range(5)}


def test_sketches_part_no_similar_sets(spark):
    rng = random.Random(4)
    rows = []
    for node in range(0, 400, 2):
        base = [rng.getrandbits(62) for _ in range(rng.choice((8, 90, 700, 3000)))]
        # As few shingles in common as a similarity of 4 in 5 allows.
        other = base[: -(-len(base) * 4 // 5)]
        rows += [(node + i, len(s), base[0], parities(np.array(s), simhash.SKETCH_WORDS).tolist()) for i, s in enumerate((base, other))]
    sketches = spark.createDataFrame(rows, "node long, n int, token long, sketch array<long>")
    pairs = sketches.select("node", "n", F.explode(F.sequence(F.col("token"), F.col("token") + F.floor(F.col("n") / 20) + 1)).alias("token"), F.lit(9).alias("band"), F.lit(1).alias("common"))
    got = {(r.u, r.v) for r in simhash._apart(pairs, spark.createDataFrame([], "node long, root long"), sketches).collect()}
    assert got == {(node, node + 1) for node in range(0, 400, 2)}
