"""Small pandas UDFs that plug into the token counter and the embedder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def char_counter():
    """Token counter that counts characters."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return texts.str.len()

    return count


def length_embedder():
    """Two-dimensional embedder: characters and words."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.array([len(s), len(s.split())], dtype="float32") for s in texts])

    return embed
