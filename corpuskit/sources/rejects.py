"""JSON lines read with nothing lost: rows that fit the schema, and a table of those that do not."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.plans.quality import failure_rate
from corpuskit.session import materialize

_BAD = "__bad"


@dataclass(frozen=True)
class Checked:
    """``lines`` has ``file``, ``line``, ``reason`` (NULL for a good line) and ``row`` (NULL for a bad one)."""

    lines: DataFrame

    def kept(self) -> DataFrame:
        return self.lines.where("reason is null").select("row.*")

    def rejects(self) -> DataFrame:
        """``file``, ``line`` as it was and ``reason``."""
        return self.lines.where("reason is not null").select("file", "line", "reason")

    def rates(self, by: Column) -> DataFrame:
        """Lines, rejected lines and what their share means, per value of ``by`` over ``file``."""
        return failure_rate(self.lines.select(by.alias("subject"), "reason"), F.col("reason").isNotNull(), "subject").withColumnRenamed("files", "lines")


def read_checked(spark: SparkSession, path: str, schema: T.StructType) -> Checked:
    """JSON lines below ``path``, each kept or rejected, parsed once and written to the shared folder.

    Reasons: ``empty`` (a blank line), ``broken`` (no JSON object), ``mismatch`` (a
    value of another type than the schema's).  A missing field is NULL, one that
    the schema lacks is ignored.
    """
    wide = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    parsed = lines.withColumn("row", F.from_json("line", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}))
    bad = F.col("row").isNull() | F.col(f"row.{_BAD}").isNotNull()
    whole = F.from_json("line", "map<string,string>", {"mode": "PERMISSIVE"})
    reason = F.when(F.trim("line") == "", "empty").when(bad & whole.isNull(), "broken").when(bad, "mismatch")
    named = F.when(reason.isNull(), F.struct(*[F.col(f"row.{f.name}").alias(f.name) for f in schema.fields]))
    return Checked(materialize(parsed.select("file", "line", reason.alias("reason"), named.alias("row")), "checked-lines"))


def stop_if_too_many(rates: DataFrame) -> None:
    """Raise if a subject has more rejects than a job may go on with."""
    worst = rates.where("verdict = 'stop'").orderBy(F.desc("rate"), "subject").head(3)
    if worst:
        raise ValueError("too many rejected lines: " + ", ".join(f"{r.subject} {r.rate:.1%}" for r in worst))
