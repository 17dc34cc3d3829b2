"""Exact dedup by progressive refinement, DataFrame functions only.

1. Rows are counted by text length; a length of its own ends there.
2. Survivors are counted by (length, hash of the first characters).
3. Only survivors of both have their whole text hashed (SHA-256, which stands for
   the text), and are grouped by (length, hash).

Counting is pre-aggregated in the map tasks; only lengths and hashes travel for it.
Rows join the surviving keys, and later their groups, on the key and a salt from their
id, so that a group that holds a large share of all rows is dealt over many tasks. The hashed rows (ids and hashes, no texts) are stored once and read
twice, for the groups and for the decisions.

Defined results: a null text is the empty text; a null ``doc_id`` is kept only if its
group has no other id; rows that repeat a ``doc_id`` with the same text count as rows
and share the decision; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_names, salted_join, stored

#: Characters of the second step's hash.
PREFIX_CHARS = 64


def _text(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hash_all: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept (and text_sha256).

    Of equal texts the row with the largest ``doc_id`` stays. ``hash_all`` adds the
    hash of every text, also of those that the first two steps already settled.
    """
    body = _text(text)
    sized = docs.select(F.col(doc_id).alias("_id"), F.octet_length(body).alias("_len"),
                        F.xxhash64(F.substring(body, 1, PREFIX_CHARS)).alias("_pre"), body.alias("_text"))
    by_prefix = sized.groupBy("_len", "_pre").agg(F.count(F.lit(1)).alias("_m"))
    by_length = by_prefix.groupBy("_len").agg(F.sum("_m").alias("_n")).filter("_n > 1").select("_len")
    survives = (by_prefix.join(by_length, "_len", "left_semi").filter("_m > 1")
                .select("_len", "_pre", F.lit(True).alias("_again")))
    full = F.when(F.col("_again"), F.sha2("_text", 256))
    cols = ["_id", "_len", full.alias("_full")]
    if hash_all:
        cols.append(F.sha2("_text", 256).alias("text_sha256"))
    rows = stored(salted_join(sized, survives, ["_len", "_pre"], "_id").select(*cols), "exact")
    groups = (rows.filter("_full is not null").groupBy("_len", "_full")
              .agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1"))
    out = [F.col("_id").alias("doc_id"),
           F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
           F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size")]
    joined = salted_join(rows, groups, ["_len", "_full"], "_id").select(*out, *rows.columns[3:])
    return joined.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def keep_unique(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that an equal text of a larger ``doc_id`` replaces (all columns stay)."""
    gone_id, gone_hash = fresh_names(docs, "_gone", "_gone_sha256")
    gone = (exact_dedup(docs, doc_id, text, hash_all=True).filter(~F.col("kept"))
            .select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_hash)).distinct())
    return docs.join(gone, F.col(doc_id).eqNullSafe(F.col(gone_id)) & (F.sha2(_text(text), 256) == F.col(gone_hash)), "left_anti")
