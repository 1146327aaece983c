"""Table functions for SQL: one text in, many rows out."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from corpuskit.operators.packing import _line_parts


@udtf
class LineParts:
    """``line_parts(text, limit, overlap)``: ``part_index`` and ``part`` of a text cut between lines.

    Called laterally, ``FROM docs, LATERAL line_parts(text, 512, 50)``.  The
    limits must be constants, ``overlap`` below ``limit``; a NULL text has no parts.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, limit: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType):
            raise ValueError("line_parts cuts a string")
        for name, given in (("limit", limit), ("overlap", overlap)):
            if not given.isConstantExpression or given.value is None:
                raise ValueError(f"{name} of line_parts must be a constant")
        if not 0 <= overlap.value < limit.value:
            raise ValueError("overlap of line_parts must be below its limit")
        return AnalyzeResult(StructType().add("part_index", IntegerType()).add("part", StringType()))

    def eval(self, text: str, limit: int, overlap: int) -> Iterator[tuple[int, str]]:
        if text is not None:
            yield from enumerate(_line_parts(text, limit, overlap))


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session's SQL."""
    spark.udtf.register("line_parts", LineParts)
