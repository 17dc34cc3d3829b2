"""Keep a filter where it is written.

Catalyst pushes a deterministic filter below projections and inlines the
projected expressions into it. For filters over long derived expressions
(a staged distance, a parsed-and-coerced row) that duplicates the work and can
exceed the 64 KB method limit of generated code. A fence is a cheap column that
Catalyst treats as non-deterministic; a filter that reads it cannot move below
the projection that defines it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FENCE = "_fence"


def fence(df: DataFrame) -> DataFrame:
    return df.withColumn(FENCE, F.spark_partition_id())


def fenced_filter(df: DataFrame, cond: Column) -> DataFrame:
    """Filter a fenced frame and drop the fence column."""
    return df.filter(cond & (F.col(FENCE) >= 0)).drop(FENCE)
