"""Sizes: what may be broadcast, and what is too few files for the cores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side is sent to every executor.
BROADCAST_ROWS = 100_000
#: Bytes up to which a table in fewer files than there are cores is dealt anew.
SPREAD_BYTES = 1 << 30


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if ``df`` has at most ``most`` rows, which are counted;
    else leave it to a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small table to all cores if it lies in fewer files,
    before costly work on each row; larger tables have files enough."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SPREAD_BYTES and len(df.inputFiles()) < cores else df
