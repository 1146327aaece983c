"""Incremental jobs on Structured Streaming.

Each job reads files as they arrive, remembers its place in a checkpoint and
stops when it has caught up; running it again takes only what is new.  What a
job knows of its keys is in the state store (``state``).  A batch that is
repeated after a failure gives the same again, so results do not depend on lost
executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.plans.analytics import with_rate
from corpuskit.plans.answers import ledger, validate
from corpuskit.sources.sinks import append_unseen
from corpuskit.streaming.state import first_rows, kept_rows, last_rows, state_store


def follow_table(spark: SparkSession, folder: str, files: str, schema: T.StructType, per_batch: int | None = None) -> DataFrame:
    """Stream of a Parquet table of a folder, be it one file or a folder of files."""
    reader = spark.readStream.schema(schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    # A pattern takes files and folders alike; a plain path would have to be a folder.
    return reader.parquet(f"{folder}/{{{files}}}")


def follow_json(spark: SparkSession, folder: str, schema: T.StructType, since: float = 0.0) -> DataFrame:
    """Stream of log events (JSON lines) later than a cursor; broken lines are skipped."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(folder).where(F.col("ts") > since)


def follow_text(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of text lines with the time their file arrived."""
    return spark.readStream.option("maxFilesPerTrigger", 1).text(folder)


def catch_up(stream: DataFrame, checkpoint: str, each_batch: Callable[[DataFrame, int], None]) -> None:
    """Run ``each_batch`` over everything that is new, then stop."""
    query = stream.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def append_stream(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append everything new to a Parquet table, each row once."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(
        availableNow=True).start()
    query.awaitTermination()


def keep_last(stream: DataFrame, path: str, keys: list[str], order: list[str], n: int, idle_ms: int | None = None) -> DataFrame:
    """Last ``n`` rows of each key, by ``order``, over all batches so far.

    They are list state of their keys: a batch touches its own keys only, each
    task first drops what is beyond ``n`` for a key, and a key that gets no rows
    for ``idle_ms`` is forgotten.  With that clock a run is one batch, as there is
    always a later one to wait for.
    """
    until = {"once": True} if idle_ms else {"availableNow": True}
    checkpoint = f"{path}/checkpoint"
    with state_store(stream.sparkSession):
        query = last_rows(stream, keys, order, n, idle_ms).writeStream.format("noop").outputMode("update").option(
            "checkpointLocation", checkpoint).trigger(**until).start()
        query.awaitTermination()
    return kept_rows(stream.sparkSession, checkpoint).select(*stream.columns)


def forget(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """State without the given keys (a cleared conversation)."""
    return rows.join(keys.select(key), key, "left_anti")


def ingest_once(stream: DataFrame, table: str, checkpoint: str, key: str) -> None:
    """Append rows whose key neither the table has nor the stream has had; replays add nothing.

    Keys are state.  The table itself is followed as well, its files only mark
    their keys; so a batch costs its own rows and what was added to the table
    since, not the table.  Only the first batch of a run, which may be one that
    failed behind its write, is held against the table's keys.
    """
    spark = stream.sparkSession
    known = spark.readStream.schema(spark.read.parquet(table).schema).parquet(table).select(*stream.columns)
    both = stream.withColumn("__known", F.lit(False)).unionByName(known.withColumn("__known", F.lit(True)))
    again = iter([True])

    def add(batch: DataFrame, _: int) -> None:
        if next(again, False):
            append_unseen(batch, table, key)
        else:
            batch.write.mode("append").parquet(table)

    with state_store(spark):
        catch_up(first_rows(both, key), checkpoint, add)


def validate_stream(generations: DataFrame, contexts: DataFrame, path: str, checkpoint: str) -> None:
    """Check answers as they arrive and append the failed ones to the ledger."""
    def check(batch: DataFrame, batch_id: int) -> None:
        ledger(validate(batch, contexts)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    catch_up(generations, checkpoint, check)


def track_progress(stream: DataFrame, path: str, checkpoint: str, by: str, failed: Column, total: int | Column) -> DataFrame:
    """Rows done and failed per ``by`` so far, their rate and the seconds left of ``total``, from one small row set per batch."""
    def count(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(by).agg(F.count("*").alias("done"), F.count_if(failed).alias("failed"), F.min("ts").alias("t0"), F.max("ts").alias("t1")).write.mode(
            "overwrite").parquet(f"{path}/batch={batch_id}")

    catch_up(stream, checkpoint, count)
    parts = stream.sparkSession.read.parquet(path)
    sums = parts.groupBy(by).agg(F.sum("done").alias("done"), F.sum("failed").alias("failed"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    return with_rate(sums, total)


def activity_windows(stream: DataFrame, path: str, checkpoint: str, cap: int = 10, late: str = "1 day") -> None:
    """Events per seven-day window sliding by a day, written once a window can no longer change."""
    counted = stream.withWatermark("ts", late).groupBy(F.window("ts", "7 days", "1 day").alias("w")).agg(F.count("*").alias("events"))
    rows = counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events", F.least("events", F.lit(cap)).alias("activity"))
    append_stream(rows, path, checkpoint)


def queue_state(queue: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Work queue with the newest result of each item; without one it is pending."""
    return queue.join(results.select(key, "status"), key, "left").withColumn("status", F.coalesce("status", F.lit("pending")))
