"""Partition layout helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a frame whose scan has fewer partitions than the cluster has cores.

    Distance joins and ordered numbering are CPU-bound per row, so an input that
    is small in bytes (one parquet row group) would otherwise run in one task.
    Large inputs already split into many partitions and pass through untouched
    (no shuffle is added at scale).
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df


DEFAULT_HOT_KEY_ROWS = 1_000_000


def hot_key_rows(spark) -> int:
    v = spark.conf.get("stormgrid.hotKeyRows", None)
    return int(v) if v else DEFAULT_HOT_KEY_ROWS


def rank_within(df: DataFrame, group: str, order: list, name: str = "rank",
                hot_rows: int | None = None, chunks: int | None = None) -> DataFrame:
    """Add ``name`` = 1-based position of each row within its ``group`` under ``order``.

    When the largest group has at most ``hot_rows`` rows, this is a plain window.
    Otherwise no group goes to one task: rows are range-partitioned on
    (group, order) so a hot group spreads over many chunks, ranked inside each
    chunk, and offset by the row counts of the group's earlier chunks (a summary
    with one row per (group, chunk)). The chunked frame is checkpointed to the
    shared checkpoint folder so chunk ids are stable under recomputation.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    spark = df.sparkSession
    hot = hot_key_rows(spark) if hot_rows is None else hot_rows
    n = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the input (typically a whole search) is read twice -- group sizes, then the
    # ranking -- so materialise it once in the shared checkpoint folder
    df = df.checkpoint(eager=True)
    largest = df.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    if largest <= hot:
        w = Window.partitionBy(group).orderBy(*order)
        return df.withColumn(name, F.row_number().over(w))
    ranged = (df.repartitionByRange(n, F.col(group), *order)
              .withColumn("_chunk", F.spark_partition_id()).checkpoint(eager=True))
    w = Window.partitionBy(group, "_chunk").orderBy(*order)
    local = ranged.repartition(n, group, "_chunk").withColumn("_rn", F.row_number().over(w))
    counts = local.groupBy(group, "_chunk").agg(F.count(F.lit(1)).alias("_cn"))
    ws = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_cn").over(ws), F.lit(0))).drop("_cn")
    out = local.join(offsets, [group, "_chunk"])
    return out.withColumn(name, (F.col("_off") + F.col("_rn")).cast("int")).drop("_chunk", "_rn", "_off")
