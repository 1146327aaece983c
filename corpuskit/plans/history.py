"""Query history, ledger and session log as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.formats import seconds_between
from corpuskit.operators.scan import ordered_scan, top_rows

SOURCES_TYPE = "array<struct<filename:string,snippet:string,score:double>>"
NUMBERS_TYPE = "map<string,double>"


def parse_history(rows: DataFrame) -> DataFrame:
    """History rows with their JSON columns parsed."""
    return (
        rows.withColumn("sources", F.from_json("sources", SOURCES_TYPE))
        .withColumn("phases", F.from_json("phases", NUMBERS_TYPE))
        .withColumn("token_usage", F.from_json("token_usage", NUMBERS_TYPE))
    )


def recent(ts: Column, now: Column, days: int = 7) -> Column:
    """Later than ``days`` before ``now``; the caller says what now is."""
    return ts > now.cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))


def latest(rows: DataFrame, n: int, session_id: str | None = None) -> DataFrame:
    """Newest ``n`` rows by id, of one session or of all."""
    if session_id is not None:
        rows = rows.where(F.col("session_id") == session_id)
    return rows.orderBy(F.desc("id")).limit(n)


def memory(turns: DataFrame, keep: int = 8, chars: int = 500) -> DataFrame:
    """Last ``keep`` entries of each conversation, clipped and labelled."""
    last = top_rows(turns, ["conv_id"], [F.desc("turn")], keep, "from_end")
    label = F.when(F.col("role") == "user", "USER").otherwise("ASSISTANT")
    return last.withColumn("entry", F.concat(F.lit("["), label, F.lit("]: "), F.substring("text", 1, chars)))


def memory_block(turns: DataFrame, keep: int = 8) -> DataFrame:
    """Memory of each conversation as one text in turn order."""
    rows = memory(turns, keep)
    ordered = F.sort_array(F.collect_list(F.struct("turn", "entry")))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda e: e["entry"]), "\n").alias("memory"), F.count("*").alias("entries"))


def since_previous(log: DataFrame, keys: list[str], order: list[str], bucket: Column) -> DataFrame:
    """Log rows with the milliseconds since the row before them of the same key."""
    linked = ordered_scan(log, keys, order, bucket, before={"prev_ts": F.col("ts")})
    gap = seconds_between(F.col("ts"), F.col("prev_ts")).cast("double")
    return linked.withColumn("gap_ms", F.round(gap * 1000, 3))


def heatmap(history: DataFrame, n: int = 200) -> DataFrame:
    """How often and when last each file was retrieved, the ``n`` most frequent."""
    hits = parse_history(history.where("sources is not null")).select("ts", F.explode("sources").alias("s"))
    files = hits.where("s.filename <> ''").groupBy(F.col("s.filename").alias("path")).agg(F.count("*").alias("count"), F.max("ts").alias("last_accessed"))
    return files.orderBy(F.desc("count"), "path").limit(n)


def phase_shares(history: DataFrame) -> DataFrame:
    """Long form of phase times: phase, milliseconds, total, share of the total."""
    parsed = parse_history(history).select("id", "phases", F.aggregate(F.map_values("phases"), F.lit(0.0), lambda a, x: a + x).alias("total_ms"))
    return parsed.select("id", "total_ms", F.explode("phases").alias("phase", "ms")).withColumn(
        "share", F.when(F.col("total_ms") > 0, F.round(F.col("ms") / F.col("total_ms"), 6)))


def top_with_overflow(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group with how many more there are."""
    totals = rows.groupBy(*keys).agg(F.count("*").alias("__total"))
    return top_rows(rows, keys, order, n).join(totals, keys).withColumn("more", F.greatest(F.col("__total") - n, F.lit(0))).drop("__total")


def list_items(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Array columns as rows ``key, field, item``."""
    named = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("items")) for f in fields])
    return rows.select(key, F.explode(named).alias("f")).select(key, "f.field", F.explode("f.items").alias("item"))


def merge_lists(saved: DataFrame, new: DataFrame) -> DataFrame:
    """Append-and-distinct of list items, one row per kept item."""
    return saved.unionByName(new).distinct()
