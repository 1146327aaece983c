"""Markup is parsed once for the blocks of a manual; items with a frequent term are not gathered by it."""

from pyspark.sql import functions as F

from corpuskit.catalog.inputs import Inputs
from corpuskit.plans import linking as L
from tests.conftest import SF


def test_markup_is_parsed_once(spark, monkeypatch):
    t, labels = Inputs(spark, SF), []
    from corpuskit import session

    own = session.materialize

    def counted(df, label):
        labels.append((label, "regexp_extract_all" in df._jdf.queryExecution().optimizedPlan().toString()))
        return own(df, label)

    monkeypatch.setattr(session, "materialize", counted)
    assert t.block_table.count() > 0
    assert [parses for _, parses in labels] == [True, False]


def test_items_of_a_frequent_term(spark):
    symbols = spark.createDataFrame([("r", f"f{i}", "SPI_BUS", "") for i in range(7)] + [("r", "g", "Wheel", "")], "repo string, file string, name string, source string")
    items = spark.range(3000).select(F.lit("d").alias("doc"), F.col("id").alias("page"), F.lit("s").alias("item_id"), F.when(F.col("id") == 7, "wheel").otherwise("spi_bus").alias("identifier"),
                                     F.lit(0.8).alias("weight"), F.lit("struct_name").alias("match_type"))
    links = L.link_items(items, symbols)
    rows = links.collect()
    assert len(rows) == 2999 * 5 + 1 and [(r.file, r.rank) for r in rows if r.page == 7] == [("g", 1)]
    assert sorted(r.file for r in rows if r.page == 8) == [f"f{i}" for i in range(5)] and all(abs(r.confidence - 0.72) < 1e-9 for r in rows)
