"""A training-data pipeline over ``documents``: five stages, each an operator of ``corpuskit.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one
before it kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.llm import decontamination, packing, pii, rules, simhash
from corpuskit.llm.queries import KEY
from corpuskit.session import materialize


#: Rows that a Python worker takes at a time.  Texts are whole, so the usual 10,000 are too many for a small executor.
ROWS_AT_A_TIME = 1000


def _narrow(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_AT_A_TIME)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and every row of the threshold table.

    A NULL or empty text has no words and goes; repeated rows stay or go
    together; all columns stay; an empty table stays empty.
    """
    return rules.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies: the one with the smallest ``doc_id``.

    NULL, empty and blank texts are copies of each other; of repeated rows one
    stays; a NULL id comes last; all columns stay; an empty table stays empty.
    """
    _narrow(spark)
    return simhash.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its edit budget.

    A NULL or empty text holds none and stays, as do repeated rows and all
    columns; an empty table stays empty, an empty benchmark takes nothing out.
    """
    _narrow(spark)
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def feistel_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with pseudonyms for personal values; ``n_chars``, if there is one, follows the text.

    NULL and empty texts stay as they are, a NULL ``n_chars`` stays NULL; no
    row goes; an empty table stays empty.
    """
    kept = pii.pseudonymise(docs, KEY, count_col="__pseudonyms").drop("__pseudonyms")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))
    return kept.select(*docs.columns)


def vector_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in training sequences, with their token ids.

    A NULL or empty text is one piece of the end alone; repeated rows are packed
    like any other; an empty table gives no pieces.
    """
    _narrow(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("feistel_pseudonyms", feistel_pseudonyms),
    ("vector_packing", vector_packing),
]

#: Fingerprints, edit distances, keyed permutations and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
