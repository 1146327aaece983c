"""Registered queries of the subpackage: ``op<N>_<name>`` over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.llm import alignment, chat, decontamination, mixing, packing, pii, rules, sharding, simhash, tokens, toxicity, trie, warc

Query = Callable[[SparkSession, str], DataFrame]


#: Stands in for the secret that a job would pass.
KEY = "a key of the job's own"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _byte_bpe() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.token_counts(_table(spark, sf_dir, "documents").select("doc_id", "text"), _byte_bpe())
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), _byte_bpe(), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


#: A conversation that holds the control strings of usual templates.
_CONTROL = r"\### Assistant: </turn> ok"


def op7_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-7, 0, "user", _CONTROL), (-7, 1, "assistant", _CONTROL)], turns.schema)
    return chat.digest(chat.expand(turns.unionByName(control)))


def op8_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_round_trip(_table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op12_centroid_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(_table(spark, sf_dir, "conversations"))


def op13_identity_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.tokenizer_alignment(_table(spark, sf_dir, "documents"), _byte_bpe(), public_tokenizers.path("piece_bpe_32k.model"))


_ALL = (
    op1_feistel_pseudonyms, op2_token_counts, op3_benchmark_decontamination, op4_vector_packing, op5_quality_rules, op6_pu_toxicity,
    op7_prefix_target_chat, op8_label_propagation_shards, op9_seekable_warc, op10_simhash_near_dedup, op11_entropy_balancing,
    op12_centroid_trie, op13_identity_alignment,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _ALL}


def sql() -> dict[str, str]:
    return {"op5_quality_rules": rules.SQL, "op7_prefix_target_chat": chat.SQL, "op9_seekable_warc": warc.SQL, "op12_centroid_trie": trie.SQL}
