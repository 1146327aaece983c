"""Notes whose lists are longer than what a note shows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from corpuskit.catalog import all_queries, all_sql
from corpuskit.catalog.inputs import BASE_TABLES
from corpuskit.session import run_dir
from tests.conftest import SF
from tests.oracle import compare


@pytest.fixture(scope="module")
def large(spark):
    """sf0.001 with many symbols of a file and many notes of a chapter."""
    folder = run_dir(spark, "long-lists")
    docs, pages = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/pages.parquet")
    docs.crossJoin(spark.range(8)).withColumn("source", F.concat(F.lit("src"), F.col("doc_id") % 3)).withColumn(
        "doc_id", (F.col("doc_id") + 10_000 * F.col("id")) * 211).drop("id").write.parquet(f"{folder}/documents.parquet")
    pages.crossJoin(spark.range(40)).withColumn("page_id", F.col("page_id") + 4_620 * F.col("id")).drop("id").write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    for name in BASE_TABLES:
        path = f"{folder}/{name}.parquet/*.parquet" if name in ("documents", "pages") else f"{SF}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return folder, con


@pytest.mark.parametrize("key", ["N2_module_notes", "N5_chapter_notes"])
def test_long_lists(spark, large, key):
    folder, con = large
    ok, message = compare(spark, con, key, all_queries()[key], all_sql()[key], folder)
    assert ok, message
    notes = [r.content for r in all_queries()[key](spark, folder).collect()]
    if key == "N2_module_notes":
        assert any(" more symbols)_" in c for c in notes)
    else:
        assert max(c.split("## Sections")[0].count("- [[N") for c in notes) > 60
