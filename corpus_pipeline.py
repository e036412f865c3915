"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm import bpe, decontaminate, exact_dedup, jaccard, toxicity
from cartolith.llm.common import discard, only, table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    return only(docs, toxicity.judge(docs, table(spark, sf_dir, "labels")).where("NOT toxic"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return only(docs, exact_dedup.exact_duplicates(docs).where("kept"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by shingles of five words and 80 % the one with the smallest id stays; op4's 4 and 85 are its query's own."""
    return only(docs, jaccard.linked_classes(docs, size=5, percent=80).where(F.col("component_id").eqNullSafe(F.col("doc_id"))))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    return only(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).where("NOT contaminated"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of what is left, as digests, and the digest of the text decoded from them."""
    return bpe.digests(docs, *bpe.default_files())


STAGES = [("toxicity", toxicity_stage), ("exact dedup", exact_dedup_stage), ("n-gram Jaccard", jaccard_stage), ("decontamination", decontamination_stage), ("byte-level BPE", encode_stage)]
ORACLE_SQL = None   # classifiers and token merges are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        made = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if i:
            discard(docs)
        docs = made
    return docs
