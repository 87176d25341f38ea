"""Enough partitions for work that costs far more than moving its input."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over at least as many partitions as there are cores.

    Inputs that come in too few files are dealt out by ``keys`` (round robin without); larger
    ones, which have more splits than cores, stay where they are, without a shuffle. Meant for
    scans and unions of scans: counting the partitions of a plan with shuffles would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)
