"""Corpus pipeline: language ID, exact dedup, near-dedup, repeat removal, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but
the last return the columns of ``documents``. ``run`` writes each stage's result below
``spark.checkpoint.dir`` and reads it again for the next.

Defined results: rows without a letter (null and empty texts among them) go in the first
stage; of equal texts the largest id stays; of near copies (five-word shingles, similarity
of 0.8 or more) the smallest id stays; a string of 50 bytes stays in the document of the
smallest id only; what is left is packed, end ids included, even where a text is empty now.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormgrid.llm import exact_dedup, language, near_dedup, packing, suffix_dedup
from stormgrid.llm.common import prepare, stored, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; learned from their own labels."""
    prepare(spark)
    return language.keep_identified(docs, language.fit(docs, F.lit(True)))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_unique(docs).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    prepare(spark)
    return near_dedup.keep_one(docs).select(*docs.columns)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that documents of smaller ids hold too."""
    prepare(spark)
    return suffix_dedup.without_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 ids."""
    prepare(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("suffix_dedup", repeats_stage),
    ("packing", packing_stage),
]

#: SQL can't express MinHash groups, trained classifiers or packing; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
