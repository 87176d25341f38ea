"""Ranks that must hold on groups of any size, and islands of consecutive numbers.

Rank statistics of a value depend only on how many rows have a lesser and how many an equal
value. So rows are counted by value first, windows run over distinct values in chunks, and
rows take their rank by an equi-join: a group of any size, or one value held by a third of all
rows, never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def below_and_equal(rows: DataFrame, group: list[str], value: str, chunk: Column) -> DataFrame:
    """(group, value, below, equal, total) of each distinct value.

    ``chunk`` must grow with the value; it cuts a group's distinct values into windows.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("equal")).withColumn("_chunk", chunk)
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    chunks = counts.groupBy(*group, "_chunk").agg(F.sum("equal").alias("_n"))
    chunks = chunks.select(*group, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("total"))
    inside = Window.partitionBy(*group, "_chunk").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("_inside", F.coalesce(F.sum("equal").over(inside), F.lit(0)))
    return ranked.join(chunks, [*group, "_chunk"]).select(*group, value, (F.col("_before") + F.col("_inside")).alias("below"), "equal", "total")


def midrank_percentile() -> Column:
    """(below + half the equal) / total."""
    return (F.col("below") + 0.5 * F.col("equal")) / F.col("total")


def tercile() -> Column:
    """1, 2 or 3 by the share strictly below; ties fall into the lower."""
    share = F.col("below") / F.col("total")
    return F.when(share < 1 / 3, 1).when(share < 2 / 3, 2).otherwise(3)


def pair_ids(pairs: DataFrame, order: str, scope: list[str], chunk: int = 1_000_000) -> DataFrame:
    """``pairs`` with ``pair_id`` (``pair-0001`` and on) in ascending ``order`` within ``scope``; counted in two levels."""
    from changelode.operators.merging import batches

    numbered = batches(pairs, scope, order, size=1, chunk=chunk)
    return numbered.withColumn("pair_id", F.concat(F.lit("pair-"), F.when(F.col("batch") < 9999, F.lpad((F.col("batch") + 1).cast("string"), 4, "0")).otherwise((F.col("batch") + 1).cast("string")))).drop("batch")


def first_by(rows: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """(key, value): the value of each key's first row; equal places go to the lesser value."""
    return rows.groupBy(*key).agg(F.min(F.struct(order, value))[value].alias(value))


def islands(rows: DataFrame, group: list[str], number: str, chunk_size: int = 100_000) -> DataFrame:
    """(group, first, last, n): runs of consecutive positive numbers; doubles count once.

    A number begins a run if its predecessor is absent and ends one if its successor is, both
    found by equi-joins; the k-th beginning belongs to the k-th end.
    """
    nums = rows.where(F.col(number) > 0).select(*group, F.col(number).cast("bigint").alias("n")).distinct()
    starts = nums.join(nums.withColumn("n", F.col("n") + 1), [*group, "n"], "left_anti")
    ends = nums.join(nums.withColumn("n", F.col("n") - 1), [*group, "n"], "left_anti")

    def numbered(x: DataFrame, name: str) -> DataFrame:
        chunked = x.withColumn("_chunk", F.floor(F.col("n") / chunk_size))
        before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        sums = chunked.groupBy(*group, "_chunk").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
        inside = F.row_number().over(Window.partitionBy(*group, "_chunk").orderBy("n"))
        return chunked.withColumn("_k", inside).join(sums, [*group, "_chunk"]).select(*group, F.col("n").alias(name), (F.col("_k") + F.col("_before")).alias("k"))

    out = numbered(starts, "first").join(numbered(ends, "last"), [*group, "k"])
    return out.select(*group, "first", "last", (F.col("last") - F.col("first") + 1).alias("n"))
