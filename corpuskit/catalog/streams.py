"""Incremental jobs, run until they have caught up with the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.catalog.registry import query
from corpuskit.functions.formats import error_line
from corpuskit.plans import history as H
from corpuskit.session import run_dir
from corpuskit.sources.tables import EVENT_SCHEMA
from corpuskit.streaming import jobs as J


def _stream(t, table):
    return J.follow_table(t.spark, t.sf_dir, f"{table}.parquet", getattr(t, table).schema)


@query("Z1_incremental_log_read", "SELECT CAST(event_id AS DOUBLE) AS ts, event_type AS event FROM events WHERE event_id > 2000")
def z1(t):
    path = run_dir(t.spark, "log")
    rows = t.events.select(F.col("event_id").cast("double").alias("ts"), F.col("event_type").alias("event"))
    rows.where("event_id < 6000").write.mode("append").json(f"{path}/in")
    J.append_stream(J.follow_json(t.spark, f"{path}/in", EVENT_SCHEMA, 2000), f"{path}/out", f"{path}/checkpoint")
    rows.where("event_id >= 6000").write.mode("append").json(f"{path}/in")
    J.append_stream(J.follow_json(t.spark, f"{path}/in", EVENT_SCHEMA, 2000), f"{path}/out", f"{path}/checkpoint")
    return t.spark.read.parquet(f"{path}/out").select("ts", "event")


@query("Z2_log_follow", """
    SELECT event_type AS log, event_id AS line_no, contains(event_type, 'error') AS is_error FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r <= 100""")
def z2(t):
    path = run_dir(t.spark, "follow")
    lines = t.events.select(F.concat_ws(" ", "event_id", "event_type").alias("value"), "event_id")
    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):
        lines.where(part).select("value").write.mode("append").text(f"{path}/in")
    parsed = J.follow_text(t.spark, f"{path}/in").select(
        F.split("value", " ")[1].alias("log"), F.split("value", " ")[0].cast("bigint").alias("line_no"), error_line(F.col("value")).alias("is_error"))
    return J.keep_last(parsed, f"{path}/view", ["log"], ["line_no"], 100)


@query("Z3_conversation_state", """
    SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4 AND conv_id % 10 <> 3""")
def z3(t):
    path = run_dir(t.spark, "memory")
    state = J.keep_last(_stream(t, "conversations"), path, ["conv_id"], ["turn"], 4)
    cleared = t.conversations.where("conv_id % 10 = 3").select("conv_id").distinct()
    return J.forget(state, cleared, "conv_id").select("conv_id", "turn", "role")


@query("Z4_idempotent_ingest", "SELECT doc_id, source FROM documents")
def z4(t):
    path = run_dir(t.spark, "ingest")
    rows = t.documents.select("doc_id", "source")
    rows.where("doc_id % 4 = 0").write.parquet(f"{path}/table")
    for attempt in ("first", "replay"):
        stream = _stream(t, "documents").select("doc_id", "source")
        J.ingest_once(stream, f"{path}/table", f"{path}/checkpoint-{attempt}", "doc_id")
    return t.spark.read.parquet(f"{path}/table")


@query("Z5_live_ledger", "SELECT gen_id, verdict AS violation FROM @verdicts@ WHERE verdict NOT IN ('pass', 'bypass')")
def z5(t):
    path = run_dir(t.spark, "ledger")
    t.generations.write.parquet(f"{path}/in")
    stream = t.spark.readStream.schema(t.generations.schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/in")
    J.validate_stream(stream, t.contexts, f"{path}/out", f"{path}/checkpoint")
    return t.spark.read.parquet(f"{path}/out").select("gen_id", "violation")


@query("Z6_running_progress", """
    SELECT event_type, count(*) AS done, count(*) FILTER (value < 5) AS failed, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS per_second,
      CAST(floor(greatest(0, 50000 - count(*)) / (count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6))) AS BIGINT) AS eta_s FROM events GROUP BY event_type""")
def z6(t):
    path = run_dir(t.spark, "progress")
    return J.track_progress(_stream(t, "events"), f"{path}/parts", f"{path}/checkpoint", "event_type", F.col("value") < 5, 50_000).select("event_type", "done", "failed", "per_second", "eta_s")


@query("Z7_activity_windows", """
    SELECT window_start, window_start + INTERVAL 7 DAY AS window_end, count(*) AS events, least(count(*), 10) AS activity FROM (SELECT ts, unnest(range(0, 7)) AS i, date_trunc('day', ts) AS d FROM events), LATERAL (SELECT d - i * INTERVAL 1 DAY AS window_start)
    WHERE window_start + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL""")
def z7(t):
    path = run_dir(t.spark, "activity")
    J.activity_windows(_stream(t, "events").withColumn("ts", F.col("ts").cast("timestamp")), f"{path}/out", f"{path}/checkpoint")
    rows = t.spark.read.parquet(f"{path}/out")
    return rows.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "events", "activity")


@query("Z7_recent_activity", "SELECT count(*) AS recent, least(1.0, count(*) / 10) AS activity FROM events WHERE ts > TIMESTAMP '2024-01-23 00:00:00'")
def z7_batch(t):
    rows = t.events.where(H.recent(F.col("ts"), F.lit("2024-01-30 00:00:00")))
    return rows.agg(F.count("*").alias("recent"), F.least(F.lit(1.0), F.count("*") / 10).alias("activity"))


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'error' ELSE 'not_found' END"


@query("Z8_work_queue", f"""
    SELECT c_custkey, coalesce(status, 'pending') AS status FROM customer LEFT JOIN (SELECT o_custkey, max_by({_STATUS}, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""")
def z8(t):
    path = run_dir(t.spark, "queue")
    results = _stream(t, "orders").select(F.col("o_custkey").alias("c_custkey"), F.expr(_STATUS).alias("status"), "o_orderdate", "o_orderkey")
    newest = J.keep_last(results, path, ["c_custkey"], ["o_orderdate", "o_orderkey"], 1)
    return J.queue_state(t.customer.select("c_custkey"), newest, "c_custkey")


@query("Z8_queue_progress", f"""
    SELECT status, count(*) AS n FROM (SELECT coalesce(status, 'pending') AS status FROM customer LEFT JOIN (SELECT o_custkey, max_by({_STATUS}, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey) GROUP BY status""")
def z8_progress(t):
    return z8(t).groupBy("status").agg(F.count("*").alias("n"))
