"""Keyed streaming state: restarts, what a batch touches, expiry, replays."""

import time

from pyspark.sql import functions as F

from corpuskit.session import run_dir
from corpuskit.streaming import jobs
from corpuskit.streaming.state import first_rows, kept_rows, last_rows, state_store

SCHEMA = "k string, n int, t string"


def push(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(f"{path}/in")


def stream(spark, path, files=None):
    reader = spark.readStream.schema(SCHEMA)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{path}/in")


def test_last_rows_over_restarts(spark):
    path = run_dir(spark, "state-test")
    view = lambda: sorted((tuple(r) for r in jobs.keep_last(stream(spark, path), f"{path}/view", ["k"], ["n"], 2).collect()), key=repr)
    push(spark, path, [("a", 1, "x"), ("a", 2, None), ("a", 0, "z"), ("b", None, "n"), (None, 4, "no key")])
    assert view() == sorted([("a", 1, "x"), ("a", 2, None), ("b", None, "n"), (None, 4, "no key")], key=repr)
    push(spark, path, [("a", 3, "late"), ("b", 7, "y"), ("c", 1, "new")])
    want = sorted([("a", 2, None), ("a", 3, "late"), ("b", None, "n"), ("b", 7, "y"), (None, 4, "no key"), ("c", 1, "new")], key=repr)
    assert view() == want and view() == want


def test_a_batch_touches_its_own_keys(spark):
    path = run_dir(spark, "state-keys")
    push(spark, path, [(f"k{i}", 1, "x") for i in range(500)])

    def run():
        with state_store(spark):
            query = last_rows(stream(spark, path), ["k"], ["n"], 3).writeStream.format("noop").outputMode("update").option(
                "checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
            query.awaitTermination()
        return sum(op["numRowsUpdated"] for p in query.recentProgress for op in p["stateOperators"]), query.recentProgress[-1]["stateOperators"][0]

    run()
    push(spark, path, [("k7", 2, "y"), ("k8", 2, "y")])
    updated, last = run()
    assert updated <= 4 and kept_rows(spark, f"{path}/cp").count() == 502


def test_idle_keys_expire(spark):
    path = run_dir(spark, "state-idle")
    push(spark, path, [("old", 1, "x")])
    view = lambda: {r.k for r in jobs.keep_last(stream(spark, path), f"{path}/view", ["k"], ["n"], 2, idle_ms=40_000).collect()}
    assert view() == {"old"}
    time.sleep(41)
    push(spark, path, [("new", 1, "y")])
    assert view() == {"new"}


def test_ingest_with_replays_and_a_growing_table(spark):
    path = run_dir(spark, "ingest-test")
    table = f"{path}/table"
    spark.createDataFrame([("known", 0, "t")], SCHEMA).write.parquet(table)
    keys = lambda: sorted(r.k for r in spark.read.parquet(table).collect())
    push(spark, path, [("a", 1, "x"), ("a", 2, "x"), ("known", 1, "x")])
    push(spark, path, [("b", 1, "x"), ("a", 3, "x")])
    ingest = lambda checkpoint: jobs.ingest_once(stream(spark, path, 1), table, f"{path}/{checkpoint}", "k")
    ingest("one")
    assert keys() == ["a", "b", "known"]
    spark.createDataFrame([("side", 0, "t")], SCHEMA).write.mode("append").parquet(table)
    push(spark, path, [("side", 1, "x"), ("c", 1, "x"), ("b", 9, "x")])
    ingest("one")
    ingest("two")  # all of it again, with a checkpoint that knows nothing
    assert keys() == ["a", "b", "c", "known", "side"]


def test_a_batch_repeated_behind_its_write(spark):
    """The write is done, the commit is not: the batch runs again and adds nothing twice."""
    path = run_dir(spark, "ingest-crash")
    table = f"{path}/table"
    spark.createDataFrame([], SCHEMA).write.parquet(table)
    push(spark, path, [("a", 1, "x"), ("b", 1, "x")])

    def dies(batch, _):
        batch.write.mode("append").parquet(table)
        raise RuntimeError("lost")

    known = spark.readStream.schema(SCHEMA).parquet(table).withColumn("__known", F.lit(True))
    both = stream(spark, path).withColumn("__known", F.lit(False)).unionByName(known)
    try:
        with state_store(spark):
            jobs.catch_up(first_rows(both, "k"), f"{path}/cp", dies)
        raise AssertionError("the batch should have failed")
    except Exception as e:  # noqa: BLE001 - a streaming error wraps it
        assert "lost" in str(e)
    jobs.ingest_once(stream(spark, path), table, f"{path}/cp", "k")
    assert sorted(r.k for r in spark.read.parquet(table).collect()) == ["a", "b"]


def test_a_table_is_one_file_or_a_folder(spark):
    """Z3, Z4: large tables are folders of files, which a filter on file names left out."""
    path = run_dir(spark, "table-of-files")
    rows = spark.range(40).selectExpr("cast(id % 8 as string) as k", "cast(id as int) as n", "'x' as t")
    rows.repartition(4).write.parquet(f"{path}/many.parquet")
    rows.where("n < 0").write.parquet(f"{path}/none.parquet")
    files = spark.read.format("binaryFile").load(f"{path}/many.parquet").select("path").collect()
    view = lambda folder, name, at: {(r.k, r.n) for r in jobs.keep_last(jobs.follow_table(spark, folder, name, rows.schema), f"{path}/{at}", ["k"], ["n"], 2).collect()}
    assert view(path, "many.parquet", "view") == {(str(k), k + 8 * i) for k in range(8) for i in (3, 4)}
    one = files[0].path.rsplit("/", 1)
    assert len(view(*one, "single")) > 0 and view(path, "none.parquet", "nothing") == set()
