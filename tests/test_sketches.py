"""Set similarity where many sets share tokens: nothing is lost, few pairs are verified."""

import random

import pytest
from pyspark.sql import functions as F

from corpuskit.operators import minhash, similarity
from corpuskit.operators.sketches import may_be_similar, sketch


def sets_of(rng, n):
    """Texts over a small vocabulary of falling frequency, and edited copies."""
    words = [f"w{i}" for i in range(1500)]
    weights = [1 / (i + 20) for i in range(1500)]
    out = []
    while len(out) < n:
        base = list(dict.fromkeys(rng.choices(words, weights, k=rng.choice((8, 60, 250, 900)))))
        out.append(set(base))
        if len(out) % 10 == 0:
            out.append(set(rng.sample(base, int(len(base) * rng.uniform(0.5, 0.95)))) | {f"new{len(out)}"})
    return out


def test_candidates_are_few_and_none_is_lost(spark):
    sets = sets_of(random.Random(5), 600)
    items = spark.createDataFrame([(i, "r", sorted(s)) for i, s in enumerate(sets)], "item long, grp string, tokens array<string>")
    met = []

    def counted(ordered, threshold):
        pairs = similarity.candidate_pairs(ordered, threshold)
        met.append(pairs.count())
        return pairs

    found = similarity.similar_sets(items, 0.6, counted)
    member = {r["set_id"]: sets[r["item"]] for r in found.members.collect()}
    got = {frozenset((r.set_a, r.set_b)): r.similarity for r in found.pairs.collect()}
    ids = list(member)
    want = {}
    for i, a in enumerate(ids):
        for b in ids[:i]:
            s = len(member[a] & member[b]) / len(member[a] | member[b])
            if s >= 0.6:
                want[frozenset((a, b))] = s
    assert len(want) > 20 and got == pytest.approx(want)
    assert met[0] <= 3 * len(want) + 20


def test_chance_meetings_end_in_the_join(spark, monkeypatch):
    """Bands of one row: nearly all sets meet, few come out."""
    sets = sets_of(random.Random(6), 300)
    rows = spark.createDataFrame([(i, sorted(s), len(s)) for i, s in enumerate(sets)], "set_id long, tokens array<string>, n int")
    monkeypatch.setattr(minhash, "ROWS", 1)
    pairs = {(r.short_id, r.long_id) for r in minhash.minhash_pairs(rows, 0.6).collect()}
    alike = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and (len(a), i) < (len(b), j) and len(a & b) >= 0.6 * len(a | b)}
    assert alike <= pairs and len(pairs) <= 3 * len(alike) + 20


@pytest.mark.parametrize("words", [1, 3, 16])
def test_a_sketch_never_parts_similar_sets(spark, words):
    rng = random.Random(words)
    base = [f"t{i}" for i in range(400)]
    rows = []
    for _ in range(200):
        a = set(rng.sample(base, rng.randint(1, 60)))
        b = set(rng.sample(sorted(a), rng.randint(max(1, int(0.6 * len(a))), len(a))))
        rows.append((sorted(b), sorted(a), len(b), len(a), len(a & b) / len(a | b)))
    frame = spark.createDataFrame(rows, "b array<string>, a array<string>, short_n int, long_n int, s double").where("s >= 0.6")
    told = frame.select("*", sketch(F.col("b"), F.lit(words)).alias("short_sketch"), sketch(F.col("a"), F.lit(words)).alias("long_sketch"))
    assert told.count() > 100 and told.where(~may_be_similar(0.6)).count() == 0
