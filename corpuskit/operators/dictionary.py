"""A table of tags and keywords, matched in one pass over each text.

The keywords become an automaton, so a text costs its characters and its hits,
however many keywords there are.  The table is cut into blocks of bounded size;
each block is one more pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.session import materialize

#: Characters of keywords in one automaton.
BLOCK = 1 << 22


def _blocks(words: DataFrame, size: int) -> Iterator[list[tuple[str, list[int]]]]:
    """Keywords with the numbers of their tags, in blocks by hash; one block at a time is on the driver."""
    total = words.agg(F.coalesce(F.sum(F.length("keyword")), F.lit(0))).first()[0]
    n = max(1, -(-total // size))
    for b in range(n):
        part = words.where(F.pmod(F.xxhash64("keyword"), F.lit(n)) == b)
        yield [(r.keyword, list(r.tags)) for r in part.collect()]


def _numbers_in(block: list[tuple[str, list[int]]], low: Column) -> Column:
    """Numbers of the tags with a keyword of the block in a lower-case text."""

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton()
        for keyword, tags in block:
            automaton.add_word(keyword, tags)
        if block:
            automaton.make_automaton()
        for texts in batches:
            yield pd.Series([sorted({t for _, tags in automaton.iter(x) for t in tags}) if block and x else [] for x in texts], dtype=object)

    return F.pandas_udf(of, "array<int>")(low)


def tagged(rows: DataFrame, dictionary: DataFrame, text: str, name: str = "tags", block: int = BLOCK) -> DataFrame:
    """``rows`` with ``name``: the tags, in the order of the dictionary, with a keyword in the lower-case text.

    ``dictionary`` has ``tag``, ``keyword`` and ``position`` (of the tag).  An
    empty or NULL keyword stands for nothing, a NULL text has no tags.
    """
    spark = rows.sparkSession
    words = dictionary.where(F.length("keyword") > 0).groupBy("keyword").agg(F.sort_array(F.collect_set(F.col("position").cast("int"))).alias("tags"))
    words = materialize(words, "dictionary")
    names = {r.position: r.tag for r in dictionary.groupBy("position").agg(F.min("tag").alias("tag")).collect()}
    found = F.array().cast("array<int>")
    for part in _blocks(words, block):
        found = F.array_union(found, _numbers_in(part, F.lower(text)))
    labels = spark.sparkContext.broadcast({int(k): v for k, v in names.items()})

    def named(numbers: pd.Series) -> pd.Series:
        return pd.Series([[labels.value[int(i)] for i in sorted(x)] for x in numbers], dtype=object)

    return rows.withColumn(name, F.pandas_udf(named, "array<string>")(found))


def dictionary_of(spark, tags: dict[str, tuple[str, ...]]) -> DataFrame:
    """A dictionary table of a mapping from tags to keywords."""
    rows = [(tag, keyword, i) for i, (tag, keywords) in enumerate(tags.items()) for keyword in keywords]
    return spark.createDataFrame(rows, "tag string, keyword string, position int")
