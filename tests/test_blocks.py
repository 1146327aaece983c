"""Block ends in one pass, and answers that no time zone changes."""

import random
import time

from pyspark.sql import functions as F

from corpuskit.functions.formats import days_between
from corpuskit.operators.blocks import first_at_most
from corpuskit.plans.code import extract_symbols


def test_first_at_most():
    rng = random.Random(7)
    for _ in range(300):
        values = [rng.randrange(6) for _ in range(rng.randrange(12))]
        asked = [(rng.randrange(len(values) + 2), rng.randrange(-1, 6)) for _ in range(6)]
        want = [next((i for i in range(s, len(values)) if values[i] <= b), None) for s, b in asked]
        assert first_at_most(values, asked) == want


def test_a_file_of_many_definitions(spark):
    body = "class Big:\n" + "".join(f"    def f{i}(self):\n        return {i}\n\n" for i in range(100_000))
    files = spark.createDataFrame([("r", "big.py", "python", body)], "repo string, path string, language string, text string")
    start = time.time()
    got = extract_symbols(files).agg(F.count("*").alias("n"), F.count_if(F.col("class_context") == "Big").alias("methods"), F.max("line_end").alias("last")).first()
    assert (got.n, got.methods, got.last) == (100_001, 100_000, 300_000) and time.time() - start < 120


def test_days_in_any_zone(spark):
    rows = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-10 12:00:00' AS b, TIMESTAMP_NTZ '2024-03-09 12:00:00' AS a")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert rows.select(days_between(F.col("b"), F.col("a")).alias("d")).first().d == 1.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
