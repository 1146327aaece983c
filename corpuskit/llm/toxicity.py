"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples and unlabelled text train a linear classifier over
words and word beginnings.  Unlabelled text holds toxic examples as well, so
its risk is corrected by the class prior; where the corrected part falls below
zero, which only overfitting can do, the step goes the other way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from corpuskit.session import materialize

_WORD = re.compile(r"[^\W\d_]+")
_STARTS = (4, 5, 6)
THRESHOLD = 0.3
#: Least G statistic of a feature; chance alone exceeds it for one in 600.
SURE = 10.0
#: Words whose features a worker remembers.
KEPT = 1 << 19


@dataclass(frozen=True)
class Bounds:
    """How much the fit may take in; everything else covers all rows.

    ``positives`` and ``unlabelled`` texts at most, about, chosen by a hash of
    their ids, and the ``features`` that tell the two apart best.
    """

    positives: int = 2000
    unlabelled: int = 6000
    features: int = 2048


@dataclass(frozen=True)
class Model:
    """Weights by feature; a score is the logistic function of their sum."""

    bias: float
    weights: dict[int, float]

    def score(self, features: set[int]) -> float:
        return float(_logistic(self.bias + sum(self.weights[f] for f in features)))


def _logistic(z):
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(z, np.float64)))


def features_of(word: str) -> tuple[int, ...]:
    """64-bit names of a word and its beginnings."""
    names = [word, *("^" + word[:n] for n in _STARTS if len(word) > n)]
    return tuple(xxhash.xxh64_intdigest(n, 7) - (1 << 63) for n in names)


def features(text: str | None) -> set[int]:
    """Features of all words of a whole text."""
    return {f for w in set(_WORD.findall((text or "").lower())) for f in features_of(w)}


def train(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, strength: float = 0.3) -> tuple[float, np.ndarray]:
    """Bias and weights that minimise the non-negative risk (logistic loss, Adam).

    ``pos`` and ``unl`` have a row per example and a 0/1 column per feature.
    ``strength`` pulls weights to zero; it counts as one part of the positives.
    """
    add = lambda x: np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    pos, unl = add(pos), add(unl)
    w = np.zeros(pos.shape[1], np.float32)
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        fp, fu = pos @ w, unl @ w
        # Slopes of the risk of taking P for positive, P for negative, U for negative.
        as_pos = -(pos.T @ _logistic(-fp).astype(np.float32)) / len(pos)
        as_neg = (pos.T @ _logistic(fp).astype(np.float32)) / len(pos)
        rest = (unl.T @ _logistic(fu).astype(np.float32)) / len(unl) - prior * as_neg
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        slope = prior * as_pos + rest if negative >= 0 else -rest
        slope[:-1] += strength / len(pos) * w[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return float(w[-1]), w[:-1]


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows, by a hash of ``id``; all of them if they are no more."""
    total = rows.count()
    if total <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 20)) < F.lit(most * (1 << 20) // total))


def fit(docs: DataFrame, positive_ids: DataFrame, prior: float, bounds: Bounds = Bounds(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the ``docs`` that ``positive_ids`` names against all of ``docs``.

    Ids of no document and NULL texts teach nothing.  Without any positive
    example, or any feature that is more frequent in them, every score is the
    prior.
    """
    prior = min(max(prior, 1e-3), 0.5)
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = positive_ids.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    chosen = rows.join(_sample(known, bounds.positives), "id", "left_semi").withColumn("positive", F.lit(True))
    chosen = chosen.unionByName(_sample(rows, bounds.unlabelled).withColumn("positive", F.lit(False)))

    @pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([list(features(t)) for t in texts], dtype=object)

    examples = materialize(chosen.select("positive", F.monotonically_increasing_id().alias("row"), of("text").alias("features")), "toxicity-examples")
    sizes = dict(examples.groupBy("positive").count().collect())
    n_pos, n_unl = sizes.get(True, 0), sizes.get(False, 0)
    if not n_pos or not n_unl:
        return Model(float(np.log(prior / (1 - prior))), {})
    count = lambda side: F.count(F.when(F.col("positive") == side, 1))
    seen = examples.select("positive", F.explode("features").alias("feature")).groupBy("feature").agg(count(True).alias("p"), count(False).alias("u"))
    # The G statistic says how surely a feature is more frequent in the positives.
    hits = F.col("p") + F.col("u")
    part = lambda c, n: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) * (n_pos + n_unl) / (hits * n))).otherwise(0.0)
    gain = 2 * (part("p", n_pos) + part("u", n_unl))
    telling = seen.where((F.col("p") * n_unl > F.col("u") * n_pos) & (F.col("p") >= max(3, -(-n_pos // 100))) & (gain > SURE)).orderBy(gain.desc(), "feature").limit(bounds.features)
    names = sorted(r[0] for r in telling.select("feature").collect())
    if not names:
        return Model(float(np.log(prior / (1 - prior))), {})
    short = examples.select("positive", "row", F.array_intersect("features", F.lit(names)).alias("features")).orderBy("row").collect()
    place = {f: i for i, f in enumerate(names)}
    sides = {True: np.zeros((n_pos, len(names)), np.float32), False: np.zeros((n_unl, len(names)), np.float32)}
    at = {True: 0, False: 0}
    for r in short:
        sides[r.positive][at[r.positive], [place[f] for f in r.features]] = 1
        at[r.positive] += 1
    bias, weights = train(sides[True], sides[False], prior)
    return Model(bias, dict(zip(names, weights.tolist(), strict=True)))


def score(model: Model, text: Column) -> Column:
    """The model's score of each whole text, from 0 to 1; NULL counts as empty."""

    @pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, tuple[int, ...]] = {}
        for texts in batches:
            out = []
            for t in texts:
                found: set[int] = set()
                for w in set(_WORD.findall((t or "").lower())):
                    own = known.get(w)
                    if own is None:
                        if len(known) > KEPT:
                            known.clear()
                        own = known[w] = tuple(f for f in features_of(w) if f in model.weights)
                    found.update(own)
                out.append(model.score(found))
            yield pd.Series(out, dtype="float64")

    return of(text)


def toxicity(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds(), threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``.

    Labels (``id_col``, ``toxic``) teach only where the crc32 of the id as text
    leaves another remainder than 2 by 4; the others are ``held_out``.  The
    prior is the share of toxic ones among the labels that teach.  All input
    columns stay; one that has an added name is replaced.  A NULL id is not
    held out; a NULL label or one of no document teaches nothing; repeated
    labels count once for the sample.  An empty ``labels`` gives every text the
    least prior as score.
    """
    held = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 4 == 2, F.lit(False))
    teach = labels.where(~held(id_col) & F.col("toxic").isNotNull()).select(id_col, "toxic")
    prior = teach.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    model = fit(docs.where(~held(id_col)), teach.where("toxic = 1"), prior, bounds, id_col, text_col)
    scored = docs.withColumns({"held_out": held(id_col), "score": score(model, F.col(text_col))})
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
