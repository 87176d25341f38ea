"""Replacing rows by key, what flipped, unions of sources, and resumable batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replace_by_key(base: DataFrame, subset: DataFrame, key: list[str]) -> DataFrame:
    """``base`` with the rows of ``subset`` in place of those with equal keys.

    Keys of the subset that the base lacks are an error; see :func:`strangers`.
    """
    return base.join(subset.select(*key), key, "left_anti").unionByName(subset)


def strangers(base: DataFrame, subset: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``subset`` without a partner; a caller that must fail checks that there are none."""
    return subset.join(base.select(*key), key, "left_anti")


def transitions(base: DataFrame, subset: DataFrame, key: list[str], label: str) -> DataFrame:
    """(from, to, n): how labels moved between a base and its re-computed subset."""
    old = base.select(*key, F.col(label).alias("from_class"))
    new = subset.select(*key, F.col(label).alias("to_class"))
    return old.join(new, key).groupBy("from_class", "to_class").agg(F.count("*").alias("n"))


def flip_report(moves: DataFrame) -> DataFrame:
    """One row: compared, unchanged, flipped and formerly empty records."""
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias
    same = F.col("from_class") == F.col("to_class")
    return moves.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("compared"), n(same)("unchanged"), n(~same)("flipped"), n(~same & (F.col("from_class") == "none"))("from_none"))


def duplicates(sources: DataFrame, key: list[str], label: str) -> DataFrame:
    """(key, n, labels): keys that occur more than once over all sources."""
    return sources.groupBy(*key).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels")).where("n > 1")


def uniform(rows: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """(group, column..._values): how many different values each provenance column has."""
    # A set of two, not a count of all: whether there is more than one value is what matters.
    return rows.groupBy(*group).agg(*[((F.max(c) == F.min(c)) | F.max(c).isNull()).alias(f"{c}_uniform") for c in columns])


def differences(base: DataFrame, subset: DataFrame, key: list[str], parts: dict[str, str]) -> DataFrame:
    """(key, part): where a re-computed record is not the same one: ``parts`` gives, for each name, an expression to compare.

    Nulls are equal to each other; structs compare by all their fields. Without rows, the
    subset may replace the base.
    """
    old = base.select(*key, F.struct(*[F.expr(e).alias(n) for n, e in parts.items()]).alias("old"))
    new = subset.select(*key, F.struct(*[F.expr(e).alias(n) for n, e in parts.items()]).alias("new"))
    unlike = F.filter(F.array(*[F.when(~F.col(f"old.{n}").eqNullSafe(F.col(f"new.{n}")), F.lit(n)) for n in parts]), lambda x: x.isNotNull())
    return old.join(new, key).select(*key, F.explode(unlike).alias("part")).distinct()


def _refuse(bad: DataFrame, what: str) -> None:
    """An error that names the first rows, if there are any; at most ten rows reach the driver."""
    if rows := bad.take(10):
        raise ValueError(f"{what}: " + ", ".join(str(tuple(r)) for r in rows))


def replaced(base: DataFrame, subset: DataFrame, key: list[str], parts: dict[str, str]) -> DataFrame:
    """:func:`replace_by_key` that fails on keys the base lacks and on records that are not the same."""
    _refuse(strangers(base, subset, key).select(*key), "not in the base")
    _refuse(differences(base, subset, key, parts), "not the same record")
    return replace_by_key(base, subset, key)


def united(sources: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """All sources with their ``source`` label; a key that occurs twice, in whatever sources, is an error."""
    if not sources:
        raise ValueError("no source")
    out = None
    for label, df in sources.items():
        rows = df.withColumn("source", F.lit(label))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    _refuse(duplicates(out, key, "source"), "more than once")
    return out


def coverage(rows: DataFrame, batches_: DataFrame, key: list[str]) -> DataFrame:
    """(key, problem): rows that finished batches lack, hold twice or hold beyond the input; none means they are whole."""
    want = rows.select(*key).withColumn("want", F.lit(1)).withColumn("have", F.lit(0))
    have = batches_.select(*key).withColumn("want", F.lit(0)).withColumn("have", F.lit(1))
    sums = want.unionByName(have).groupBy(*key).agg(F.sum("want").alias("want"), F.sum("have").alias("have"))
    problem = F.when(F.col("have") < F.col("want"), "missing").when(F.col("want") == 0, "not in the input").when(F.col("have") > F.col("want"), "more than once")
    return sums.withColumn("problem", problem).where("problem is not null").select(*key, "problem")


def finalized(rows: DataFrame, batches_: DataFrame, key: list[str]) -> DataFrame:
    """The concatenated batches, once they cover the input exactly."""
    _refuse(coverage(rows, batches_, key), "batches don't cover the input")
    return batches_


def listed(rows: DataFrame, members: DataFrame, key: list[str], keep: bool = True, complete: bool = False) -> DataFrame:
    """Rows on a list (``keep``) or off it; with ``complete``, a listed key that no row has is an error.

    ``members``: key columns; the list may be of any size and repeat its keys.
    """
    if complete:
        _refuse(absent(rows, members, key), "listed but not in the input")
    return rows.join(members.select(*key).distinct(), key, "left_semi" if keep else "left_anti")


def absent(rows: DataFrame, members: DataFrame, key: list[str]) -> DataFrame:
    """Listed keys that no row has."""
    return members.select(*key).distinct().join(rows.select(*key), key, "left_anti")


def batch_of(number: Column, size: int = 50) -> Column:
    """The batch of a zero-based position."""
    return F.floor(number / size).cast("bigint")


def batches(rows: DataFrame, group: list[str], order: str, size: int = 50, chunk: int = 1_000_000, tie: str | None = None) -> DataFrame:
    """``rows`` with fixed batch numbers in key order, nulls first; positions are counted in two levels.

    ``tie`` orders rows of equal keys, so that batches never depend on how rows arrive.
    """
    cut = rows.withColumn("_chunk", F.coalesce(F.floor(F.col(order) / chunk), F.lit(-(2**62))))
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*group, "_chunk").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    here = F.row_number().over(Window.partitionBy(*group, "_chunk").orderBy(F.asc_nulls_first(order), *([tie] if tie else []))) - 1
    return cut.withColumn("_here", here).join(sums, [*group, "_chunk"]).withColumn("batch", batch_of(F.col("_here") + F.col("_before"), size)).drop("_chunk", "_here", "_before")


def unfinished(rows: DataFrame, finished: DataFrame) -> DataFrame:
    """Rows of batches that are not among the finished ones, for a resumed run."""
    return rows.join(finished.select("batch").distinct(), "batch", "left_anti")
