"""Parity sketches: a bound on how far two token sets differ, without their tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SLACK = 1e-6  # keeps t*n from landing just above an integer


def at_least(value: Column) -> Column:
    return F.ceil(value - SLACK).cast("int")


def parities(hashes: np.ndarray, words: int) -> np.ndarray:
    """Parities of a set's hashes over ``64 * words`` places, as ``words`` numbers of 64 bits."""
    places = hashes.astype(np.int64).view(np.uint64) % np.uint64(64 * words)
    odd = np.bincount(places.astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketch(tokens: Column, words: Column) -> Column:
    """Parities of a set's tokens over ``64 * words`` hashed places.

    Two sketches of one width differ in at most as many places as their sets
    differ in tokens, so pairs told apart by them are not similar.
    """

    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sets, widths in batches:
            yield pd.Series([parities(hashes, width) for hashes, width in zip(sets, widths, strict=True)], dtype=object)

    return F.pandas_udf(of, "array<long>")(F.transform(tokens, lambda t: F.xxhash64(t)), words)


def may_be_similar(threshold: float) -> Column:
    """Whether ``short_sketch`` and ``long_sketch`` leave room for the tokens that must be shared."""
    n = F.col("short_n") + F.col("long_n")
    differ = F.aggregate(F.zip_with("short_sketch", "long_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    return differ <= n - 2 * at_least(n * (threshold / (1 + threshold)))
