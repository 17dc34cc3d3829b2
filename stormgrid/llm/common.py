"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package

#: Rows in one Arrow batch. Texts are long, so a batch of the default 10 000 rows
#: would hold tens of MB; this only sets the hand-over size, every row is handed over.
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Session settings that the Python stages rely on, and the package on the workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder under ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage with files that every executor can read again after a loss.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salted_join(rows: DataFrame, few: DataFrame, keys: list[str], spread_by: str, how: str = "left", salts: int = 16) -> DataFrame:
    """Join ``rows`` with ``few`` (one row a key) on ``keys``, a key's rows dealt over ``salts`` tasks.

    ``spread_by`` is the column of ``rows`` whose hash picks the salt; ``few`` is repeated per salt.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    right = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def table_join(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join ``rows`` with ``few`` (one row a key), a crowded key's rows split over tasks by Spark.

    Neither side may be partitioned by the keys yet (read ``few`` from a table, not from an
    aggregate), as adaptive skew joins split only a join's own two shuffles. They repeat
    the other side for crowded partitions only, into as many parts as their bytes ask for.
    """
    return rows.join(few, keys, how)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]],
                schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def texts_of(column: pa.Array) -> list[str]:
    """Whole texts of an Arrow string column, null as the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]


def chunks_by_size(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes add up to ``limit`` at most (or hold one item)."""
    start = total = 0
    for i, s in enumerate(sizes):
        if i > start and total + s > limit:
            yield start, i
            start, total = i, 0
        total += s
    if start < len(sizes):
        yield start, len(sizes)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be no column of ``df`` (case ignored)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
