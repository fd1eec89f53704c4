"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm import decontaminate, huffman, licenses, packing, pii, quality, sharding, simhash, suffixes, toxicity


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op4_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.grouped(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.rated(docs.select("doc_id", "text"), labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


def op7_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "documents"))


def op8_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_minimum_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(packing.pieces(table(spark, sf_dir, "documents"), vocabulary()))


def op10_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_license_digests": op1_license_digests,
    "op2_toxicity_chain": op2_toxicity_chain,
    "op3_huffman_ids": op3_huffman_ids,
    "op4_pivot_simhash": op4_pivot_simhash,
    "op5_decontamination": op5_decontamination,
    "op6_quality_ratio": op6_quality_ratio,
    "op7_semi_markov_pii": op7_semi_markov_pii,
    "op8_prefix_doubling": op8_prefix_doubling,
    "op9_minimum_slack": op9_minimum_slack,
    "op10_virtual_slots": op10_virtual_slots,
}

SQL: dict[str, str] = {"op1_license_digests": licenses.scan_sql()}
