"""Dedup stages on tables whose columns bear the operators' inner names; the query's kept column."""

import pytest

from stormgrid.llm import exact_dedup, near_dedup, queries
from stormgrid.llm.common import fresh_names, prepare

CLASHES = "doc_id long, text string, _gone long, _GONE_ string, _gone_key long, _gone_sha256 string, key long, kept boolean"


def test_stages_keep_clashing_columns(spark):
    prepare(spark)
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, "same text", 5, "x", 6, "y", 7, True), (2, "same text", 5, "x", 6, "y", 7, False), (3, long, 0, None, 1, None, 2, None), (4, long + " more", 8, "a", 9, "b", 1, True),
            (None, "same text", 1, "c", 2, "d", 3, True)]
    docs = spark.createDataFrame(rows, CLASHES)
    assert fresh_names(docs, "_gone", "free") == ["_gone__", "free"]
    unique = exact_dedup.keep_unique(docs)
    assert unique.columns == docs.columns and sorted(map(tuple, unique.collect())) == [rows[1], rows[2], rows[3]]
    one = near_dedup.keep_one(unique)
    assert one.columns == docs.columns and sorted(map(tuple, one.collect())) == [rows[1], rows[2]]
    assert exact_dedup.keep_unique(docs.limit(0)).count() == 0


def test_kept_compares_ids(spark, tmp_path):
    """Two different near texts of one id: both rows say kept, as their id is their component's."""
    base = [f"w{k}" for k in range(40)]
    rows = [(9, " ".join(base)), (9, " ".join([*base, "end"])), (12, " ".join([*base, "other"])), (3, "alone here"), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op7_near_dedup(spark, str(tmp_path)).select("doc_id", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == [(3, 3, True), (5, 5, True), (9, 9, True), (9, 9, True), (12, 9, False)]
