"""MinHash candidates: recall against the exact join, tiles of hot buckets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskit.catalog.inputs import Inputs
from corpuskit.operators import minhash as M
from corpuskit.operators.similarity import similar_sets
from corpuskit.plans import clones as P


def pairs_of(found):
    return {(r.set_a, r.set_b): r.similarity for r in found.pairs.collect()}


def edited(rng, words, base, share):
    """A set whose similarity with ``base`` is about ``share``."""
    keep = rng.sample(base, round(2 * share / (1 + share) * len(base)))
    return keep + rng.sample(words, len(base) - len(keep))


def test_recall_by_band(spark):
    rng = random.Random(2)
    words = [f"t{i}" for i in range(20_000)]
    rows = []
    for g in range(400):
        base = rng.sample(words, 60)
        rows += [base] + [edited(rng, words, base, rng.uniform(0.55, 1.0)) for _ in range(3)]
    items = spark.createDataFrame([(i, f"r{i % 3}", sorted(set(t))) for i, t in enumerate(rows)], "item long, grp string, tokens array<string>")
    exact, near = pairs_of(similar_sets(items)), pairs_of(similar_sets(items, candidates=M.minhash_pairs))
    assert set(near) <= set(exact) and all(near[p] == exact[p] for p in near)
    for low, high, least in ((0.60, 0.65, 0.9), (0.65, 0.8, 0.97), (0.8, 1.01, 0.995)):
        band = [p for p, s in exact.items() if low <= s < high]
        assert len(band) > 50 and sum(p in near for p in band) >= least * len(band)


def test_recall_on_the_table(spark):
    symbols = Inputs(spark, "/root/testdata/sf0.01").symbols
    exact, near = pairs_of(P.find_clones(symbols)), pairs_of(P.find_clones_by_signatures(symbols))
    assert set(near) <= set(exact) and len(near) >= 0.9 * len(exact) > 0


def test_tiles_of_a_hot_bucket(spark, monkeypatch):
    base = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([(i, "r", sorted([*base, f"x{i}"])) for i in range(60)], "item long, grp string, tokens array<string>")
    whole = pairs_of(similar_sets(items, candidates=M.minhash_pairs))
    monkeypatch.setattr(M, "TILE", 7)
    assert pairs_of(similar_sets(items, candidates=M.minhash_pairs)) == whole and len(whole) == 60 * 59 // 2


def test_signatures(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "a"]), (3, []), (4, ["a"])], "i int, t array<string>").select("i", M.signature(F.col("t")).alias("s"))
    got = {r.i: np.array(r.s) for r in rows.collect()}
    assert (got[1] == got[2]).all() and len(got[3]) == 128 and 30 < (got[1] == got[4]).sum() < 98


@pytest.mark.parametrize("n", [0, 1])
def test_no_pairs(spark, n):
    items = spark.createDataFrame([(1, "r", ["a", "b"])], "item long, grp string, tokens array<string>").limit(n)
    assert similar_sets(items, candidates=M.minhash_pairs).pairs.count() == 0
