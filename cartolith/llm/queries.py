"""The registered queries of the document operators, with SQL twins where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm import bpe, conversations, decontaminate, exact_dedup, jaccard, language, licenses, merkle, quality_bands, repeats, sharding, token_counts, toxicity
from cartolith.llm.common import table


def op1_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"), depth=50)
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("span_starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), wrapped=True)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_classes(table(spark, sf_dir, "documents"), size=4, percent=85, counts=True).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.histogram(bpe.counts(table(spark, sf_dir, "documents"), *bpe.default_files()))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), *bpe.default_files())


def op7_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"), shards=40)
    return found.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"), merkle.without_newlines())


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digests(table(spark, sf_dir, "conversations"))


def op13_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bands.rate(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_repeat_removal, op2_license_scan, op3_language_id, op4_ngram_jaccard, op5_token_counts, op6_byte_bpe, op7_toxicity_chain, op8_exact_dedup, op9_decontamination, op10_ring_shards, op11_merkle_manifest, op12_conversation_repair, op13_quality_bands)}
ORACLE = {"op2_license_scan": licenses.oracle(), "op8_exact_dedup": exact_dedup.ORACLE, "op11_merkle_manifest": merkle.oracle()}
