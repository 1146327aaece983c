"""Maps of bits that pick rows in place, so that a join or a fold need not move the others.

A map has a fixed size whatever the data; other values than those it was made
of may hit it too, so it only ever leaves out what is certainly not wanted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Bits of a map; false hits only cost time.
MAP_BITS = 1 << 25


def map_of(values: DataFrame, name: str) -> np.ndarray:
    """A map of ``MAP_BITS`` bits in which those of ``values`` are set; other values may hit one too."""
    bit = F.pmod(F.col(name).cast("long"), F.lit(MAP_BITS)) + 1
    put = values.groupBy(F.bitmap_bucket_number(bit).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    bits = np.zeros(MAP_BITS // 8, np.uint8)
    for at, part in put:
        bits[(at - 1) * 4096 : at * 4096] = np.frombuffer(part, np.uint8)
    return bits


def hits_of(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.mod(values, len(bits) * 8)
    return bits[at >> 3] >> (at & 7) & 1 == 1


def marked(rows: DataFrame, column: str, wanted: DataFrame, flag: str) -> DataFrame:
    """``rows`` with a ``flag`` that is true where ``column`` may be one of ``wanted``'s and false where it is certainly not."""
    bits = rows.sparkSession.sparkContext.broadcast(map_of(wanted, column))

    def has(values: pd.Series) -> pd.Series:
        return pd.Series(hits_of(bits.value, values.to_numpy()))

    return rows.withColumn(flag, pandas_udf(has, "boolean")(column))
