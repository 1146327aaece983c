"""Notes that are empty, and rows that make no note, in the queries that write and read notes."""

import duckdb
import pytest
from pyspark.sql import functions as F

from corpuskit.catalog import all_queries, all_sql
from corpuskit.session import run_dir
from corpuskit.sources.files import read_notes
from corpuskit.sources.note_writer import write_notes
from tests.conftest import SF
from tests.oracle import compare


@pytest.fixture(scope="module")
def odd(spark):
    folder, k = run_dir(spark, "odd-notes"), F.col("doc_id")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.withColumn("text", F.when(k % 10 == 3, "").when(k % 10 == 6, F.lit(None)).otherwise(F.col("text"))).withColumn(
        "source", F.when(k % 50 == 8, F.lit(None)).otherwise(F.col("source"))).withColumn(
        "doc_id", F.when(k == 17, F.lit(None)).otherwise(k)).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    return folder, con


@pytest.mark.parametrize("key", ["S8_note_file_scan", "K7_note_sink"])
def test_odd_texts(spark, odd, key):
    folder, con = odd
    ok, message = compare(spark, con, key, all_queries()[key], all_sql()[key], folder)
    assert ok, message


def test_notes_are_listed_by_tasks(spark, tmp_path):
    rows = [("x.md", "# x"), ("a/y.md", ""), ("a/_z.md", "no"), ("_b/c/d.md", "dé"), (".hidden/e.md", "no"), ("a/f.txt", "no")]
    write_notes(spark.createDataFrame(rows, "path string, content string"), f"file://{tmp_path}")
    read = read_notes(spark, f"file://{tmp_path}")
    assert sorted((r.name, r.size, r.text) for r in read.collect()) == [("d", 3, "dé"), ("x", 3, "# x"), ("y", 0, "")]
    assert read.inputFiles() and not any(f.endswith(".md") for f in read.inputFiles())  # the driver holds no list of notes
    assert "ArrowEvalPython" not in read.select("name", "size")._jdf.queryExecution().optimizedPlan().toString()
    (tmp_path / "none").mkdir()
    assert read_notes(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError, match="no path"):
        write_notes(spark.createDataFrame([(None, "x")], "path string, content string"), str(tmp_path))
