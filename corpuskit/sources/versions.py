"""Tables of versions: changed as a whole, published in one step.

A version is a list of data folders.  A change writes the partitions that it
touches into new folders, leaves all others where they are, and at last appends
one file to the table's manifest, which names the folders of the new version.
Readers follow the newest file of the manifest.  A job that dies before that
leaves folders that nobody reads; what was there is still there, whole.

Tables take one writer at a time; a second one that publishes the same version
is told so.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.operators.scan import top_rows

MANIFEST = "version long, attempt string, part string, folder string, schema string, partition string"


class Conflict(RuntimeError):
    """Another writer has published the same version first."""


@dataclass(frozen=True)
class Version:
    """One state of a table: its folders by part, as many as partitions and appends since the last rewrite."""

    number: int
    folders: tuple[tuple[str, str], ...]
    schema: T.StructType
    partition: str

    def read(self, spark: SparkSession, parts: set[str] | None = None) -> DataFrame:
        folders = [f for p, f in self.folders if parts is None or p in parts]
        return spark.read.schema(self.schema).parquet(*folders) if folders else spark.createDataFrame([], self.schema)


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def version_of(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """The newest version of the table, or the one with that number."""
    rows = _manifest(spark, path)
    number = rows.agg(F.max("version")).first()[0] if number is None else number
    found = rows.where((F.col("version") == number)).collect()
    if not found:
        raise ValueError(f"{path} has no version {number}")
    first = min(r.attempt for r in found)
    own = [r for r in found if r.attempt == first]
    folders = tuple(sorted((r.part, r.folder) for r in own if r.folder is not None))
    return Version(number, folders, T.StructType.fromJson(json.loads(own[0].schema)), own[0].partition)


def read_table(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    return version_of(spark, path, number).read(spark)


def part_of(partition: str) -> Column:
    """The part of a row: a name for any value of the partition column, NULL included."""
    return F.md5(F.coalesce(F.concat(F.lit("="), F.col(partition).cast("string")), F.lit("")).cast("binary"))


def publish(spark: SparkSession, path: str, version: Version) -> None:
    """Make ``version`` the newest; one task writes one file, which is there or is not."""
    attempt, schema = uuid.uuid4().hex, version.schema.json()
    rows = [(version.number, attempt, p, f, schema, version.partition) for p, f in version.folders]
    rows = rows or [(version.number, attempt, None, None, schema, version.partition)]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    winner = _manifest(spark, path).where(F.col("version") == version.number).agg(F.min("attempt")).first()[0]
    if winner != attempt:
        raise Conflict(f"version {version.number} of {path} is another writer's")


def _written(rows: DataFrame, path: str, partition: str) -> list[tuple[str, str]]:
    """New folders that hold ``rows``, one per part."""
    folder = f"{path}/data/{uuid.uuid4().hex}"
    rows.withColumn("__part", part_of(partition)).write.partitionBy("__part").parquet(folder)
    schema = T.StructType([*rows.schema.fields, T.StructField("__part", T.StringType())])
    parts = rows.sparkSession.read.schema(schema).parquet(folder).select("__part").distinct().collect()
    return [(r[0], f"{folder}/__part={r[0]}") for r in parts]


def _open(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def create_table(rows: DataFrame, path: str, partition: str) -> None:
    """A table of ``rows`` as version 0, with a folder for each value of ``partition``."""
    publish(rows.sparkSession, path, Version(0, tuple(_written(rows, path, partition)), _open(rows.schema), partition))


def append_rows(rows: DataFrame, path: str) -> None:
    """A version with ``rows`` more; no folder is written again."""
    spark, now = rows.sparkSession, version_of(rows.sparkSession, path)
    added = _written(rows.select(*now.schema.names), path, now.partition)
    publish(spark, path, Version(now.number + 1, (*now.folders, *added), now.schema, now.partition))


def rewrite_parts(path: str, touched: DataFrame, change) -> None:
    """A version in which the partitions named by ``touched`` hold what ``change`` makes of their rows.

    ``touched`` has the partition column; ``change`` takes the rows of those
    partitions and may add rows of any partition.  Other folders stay.
    """
    spark = touched.sparkSession
    now = version_of(spark, path)
    parts = {r[0] for r in touched.select(part_of(now.partition)).distinct().collect()}
    fresh = change(now.read(spark, parts)).select(*now.schema.names)
    added = _written(fresh, path, now.partition)
    kept = [(p, f) for p, f in now.folders if p not in parts]
    publish(spark, path, Version(now.number + 1, (*kept, *added), now.schema, now.partition))


def upsert_rows(path: str, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> None:
    """Put ``new`` in the place of rows with equal keys; rows of one key must be of one partition.

    Of several new rows with one key the first in ``order`` stays.
    """
    if order:
        new = top_rows(new, keys, order, 1, "__r").drop("__r")
    rewrite_parts(path, new, lambda old: old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True))


def delete_rows(path: str, doomed: DataFrame, keys: list[str]) -> None:
    """Delete the rows that agree with one of ``doomed`` in ``keys``; ``doomed`` has the partition column as well."""
    rewrite_parts(path, doomed, lambda old: old.join(doomed.select(*keys).distinct(), keys, "left_anti"))


def change_rows(path: str, key: str, column: str, changes: DataFrame, doomed: DataFrame) -> None:
    """Set ``column`` where ``changes`` has a value for the key, and delete ``doomed``, in one version.

    Both have the key and the partition column; rows of one key are of one partition.
    """
    now = version_of(changes.sparkSession, path)

    def change(old: DataFrame) -> DataFrame:
        new = changes.select(key, F.col(column).alias("__new"))
        left = old.join(doomed.select(key).distinct(), key, "left_anti").join(new, key, "left")
        return left.withColumn(column, F.coalesce("__new", column)).drop("__new")

    touched = changes.select(now.partition).unionByName(doomed.select(now.partition))
    rewrite_parts(path, touched, change)
