"""Sets are made of the texts that are picked, once: no filter of a later step repeats the function."""

import re

from pyspark.sql import functions as F

from corpuskit.llm import simhash as S


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_similar_makes_sets_of_picked_texts_only(spark):
    texts = spark.createDataFrame([(i, i, "a b c d e f g " * i) for i in range(1, 5)], "id long, h long, text string")
    keys = [tuple(S._digest(S.shingle_set("a b c d e f g " * i))) for i in range(1, 5)]
    prints = spark.createDataFrame([(i, *keys[i - 1], (i, i)) for i in range(1, 5)], "node long, k1 long, k2 long, best struct<id:long,h:long>")
    found = S._similar(spark.createDataFrame([(2, 3), (1, 2)], "u long, v long"), prints, texts)
    made = re.findall(r"ArrowEvalPython \[[^\]]*of\(text", _plan(found))
    assert len(made) == 2  # one for each side, which are one shuffle
    assert [tuple(r) for r in found.collect()] == [(2, 3)]


def test_held_prefixes_are_looked_up_once(spark):
    prints = spark.createDataFrame([(1, [1, 2, 3]), (2, [3, 4]), (3, [])], "node long, prefix array<int>")
    tokens = spark.createDataFrame([(3,)], "token int")
    rows = prints.select("node", S._held("prefix", tokens).alias("prefix")).select("node", F.explode("prefix").alias("token"))
    shared = rows.join(tokens, "token")
    assert len(re.findall(r"ArrowEvalPython \[", _plan(shared))) == 1
    assert sorted(map(tuple, shared.collect())) == [(3, 1), (3, 2)]
