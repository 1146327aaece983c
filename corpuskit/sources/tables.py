"""Tables as sources: JSON, collections, history and logs, all with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.operators.scan import top_rows

EVENT_SCHEMA = T.StructType([
    T.StructField("ts", T.DoubleType()), T.StructField("wall", T.StringType()), T.StructField("event", T.StringType()),
    T.StructField("rss_mb", T.DoubleType()), T.StructField("attrs", T.MapType(T.StringType(), T.StringType()))])
CHUNK_SCHEMA = T.StructType([
    T.StructField("chunk_id", T.StringType()), T.StructField("content", T.StringType()), T.StructField("content_type", T.StringType()),
    T.StructField("token_count", T.IntegerType()), T.StructField("part_index", T.IntegerType()), T.StructField("symbol_name", T.StringType()),
    T.StructField("repo", T.StringType()), T.StructField("file", T.StringType()), T.StructField("line_start", T.LongType()),
    T.StructField("language", T.StringType())])


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files that hold one JSON array each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; malformed ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def prefer(better: DataFrame, plain: DataFrame, key: str) -> DataFrame:
    """Rows of ``better``, and those of ``plain`` whose ``key`` has none there."""
    rest = plain.join(better.select(key).distinct(), key, "left_anti")
    return better.unionByName(rest, allowMissingColumns=True)


def read_collection(spark: SparkSession, path: str, collection: str, columns: list[str]) -> DataFrame:
    """Chosen columns of one collection; only its partition is read."""
    return spark.read.parquet(path).where(F.col("collection") == collection).select(*columns)


def tail(lines: DataFrame, keys: list[str], order: str, n: int = 100) -> DataFrame:
    """Last ``n`` lines of each log with the log's number of lines."""
    totals = lines.groupBy(*keys).agg(F.count("*").alias("total_lines"))
    return top_rows(lines, keys, [F.desc(order)], n, "from_end").join(totals, keys)
