"""Keywords count wherever they stand in a text."""

import duckdb
from pyspark.sql import functions as F

from corpuskit.catalog import all_queries, all_sql
from corpuskit.session import run_dir
from tests.conftest import SF
from tests.oracle import compare


def test_tags_of_the_end_of_a_text(spark):
    folder = run_dir(spark, "late-keywords")
    spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 20").withColumn(
        "text", F.concat(F.repeat(F.lit("x"), 5000), F.lit(" Beamform"))).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    key = "F7_dictionary_tags"
    ok, message = compare(spark, con, key, all_queries()[key], all_sql()[key], folder)
    assert ok, message
    rows = all_queries()[key](spark, folder).collect()
    assert len(rows) == 20 and all("TRM__Mic_Array" in r.code_tags for r in rows)
