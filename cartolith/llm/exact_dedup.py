"""Exact deduplication: equal texts by a 128-bit content hash, with their bytes compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.llm.common import documents_of

WHITE = r"[\x20\x09-\x0D]+"


def content_hash(text: Column) -> Column:
    """MD5 as 16 bytes."""
    return F.unhex(F.md5(text))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", squeeze: bool = True, hashed=content_hash) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, after each run of white space has become one space (unless squeeze is False). The row with the smallest id
    stays. Null counts as empty; all empty texts are one group; a null id is larger than any other. Rows with the same id and text count one by one
    in group_size and are kept alike. Other columns of docs are not read. An empty table gives an empty result.

    The group key is the hash and then the text, so that a group holds equal bytes even if hashes collide; copies are combined before the shuffle, so
    a text that fills a third of the table crosses it once per task. Documents find their group by hash and SHA-256, without their text; that join has
    one row per group on one side, so a hot group on the other is split by the adaptive join.
    """
    base = documents_of(docs, doc_id, text)
    if squeeze:
        base = base.withColumn("text", F.regexp_replace("text", WHITE, " "))
    keyed = base.select("doc_id", hashed(F.col("text")).alias("h"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "text")
    groups = (keyed.groupBy("h", "text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
              .select(F.col("h").alias("gh"), F.sha2(F.col("text").cast("binary"), 256).alias("gsha"), "keep_id", "group_size"))
    found = keyed.drop("text").join(groups, (F.col("h") == F.col("gh")) & (F.col("text_sha256") == F.col("gsha")))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


ORACLE = r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256 FROM t"""
