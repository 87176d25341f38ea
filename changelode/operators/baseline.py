"""Defect density and churn of subsystems in the window before a cut-off.

A window's totals are differences of running totals at its two ends. Running totals come from
the two-level running sums that also number versions, so cases never meet all commits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelode.operators.asof import running
from changelode.operators.ranking import below_and_equal, midrank_percentile, tercile
from changelode.plans.durable import durable

WINDOW_MONTHS = 24
MIN_COMMITS = 20


def months_before(t: Column, months: int) -> Column:
    """A time some months earlier; a day the month lacks runs over into the next (29 Feb gives 1 Mar)."""
    first = F.add_months(F.trunc(t, "month"), -months).cast("timestamp")
    inside = F.unix_micros(t) - F.unix_micros(F.date_trunc("month", t))
    return F.timestamp_micros(F.unix_micros(first) + inside)


def window_totals(changes: DataFrame, cases: DataFrame, entity: list[str], measures: list[str], months: int = WINDOW_MONTHS) -> DataFrame:
    """(case_id, entity, measures) over [cutoff - months, cutoff).

    ``changes``: entity columns, at, measures. ``cases``: case_id, cutoff and the first entity
    column; every entity of that column is asked for.
    """
    asked = cases.join(changes.select(*entity).distinct(), entity[:1]).select("case_id", *entity, F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.col("cutoff").alias("at")), F.struct(F.lit(-1).alias("sign"), months_before(F.col("cutoff"), months).alias("at")))).alias("e"))
    none = lambda t: F.lit(None).cast(t)
    points = asked.select(*entity, F.col("e.at").alias("at"), F.lit(0).alias("kind"), "case_id", F.col("e.sign").alias("sign"), *[F.lit(0).cast("bigint").alias(m) for m in measures])
    rows = changes.select(*entity, "at", F.lit(1).alias("kind"), none("string").alias("case_id"), none("int").alias("sign"), *[F.col(m).cast("bigint").alias(m) for m in measures])
    line = running(points.unionByName(rows), entity, "at", ["kind", "case_id", "sign"], {f"{m}_so_far": m for m in measures})
    signed = [F.sum(F.col("sign") * F.col(f"{m}_so_far")).alias(m) for m in measures]
    return line.where("case_id is not null").groupBy("case_id", *entity).agg(*signed)


def touched(lines: DataFrame, scored: DataFrame, primary: DataFrame) -> DataFrame:
    """(case_id, subsystem, lines, score, tercile, place): what a case touches, in report order.

    The primary subsystem leads, then more lines, higher scores (an unscored one after all
    others) and lesser names. ``lines``: case_id, subsystem, lines; ``scored``: case_id,
    subsystem, score, tercile; ``primary``: case_id, subsystem. A case's window is as large as
    its change.
    """
    rows = lines.join(scored.select("case_id", "subsystem", "score", "tercile"), ["case_id", "subsystem"], "left").join(primary.select("case_id", "subsystem").withColumn("leads", F.lit(0)), ["case_id", "subsystem"], "left")
    order = Window.partitionBy("case_id").orderBy(F.coalesce("leads", F.lit(1)), F.desc("lines"), F.desc(F.coalesce("score", F.lit(-1.0))), "subsystem")
    return rows.withColumn("place", F.row_number().over(order)).select("case_id", "subsystem", "lines", "score", "tercile", "place")


def verdicts(totals: DataFrame, cases: DataFrame, min_commits: int = MIN_COMMITS) -> DataFrame:
    """(case_id, subsystem, commits, churn, defects, score, tercile, risky, reason) of each case's own subsystem.

    Only subsystems with ``min_commits`` are scored: the mean of the mid-rank percentiles of
    defect density and churn among them. An inactive or absent one is not risky, for the reason
    ``low_activity`` or ``no_commits``; a scored one has an empty reason. A case without a known
    subsystem has a null verdict.
    ``totals``: case_id, subsystem, commits, churn, defects; ``cases``: case_id, subsystem.
    """
    totals = durable(totals)  # read several times below
    active = totals.where(F.col("commits") >= min_commits).withColumn("density", F.col("defects") / F.col("commits")).withColumn("churn_d", F.col("churn").cast("double"))
    by = lambda value, name, chunk: below_and_equal(active, ["case_id"], value, chunk).select("case_id", value, midrank_percentile().alias(name))
    scored = durable(active.join(by("density", "p", F.floor(F.col("density") * 100)), ["case_id", "density"]).join(by("churn_d", "q", F.floor(F.log2(F.col("churn_d") + 1))), ["case_id", "churn_d"]).withColumn("score", F.round((F.col("p") + F.col("q")) / 2, 9)))
    thirds = below_and_equal(scored, ["case_id"], "score", F.floor(F.col("score") * 100)).select("case_id", "score", tercile().alias("tercile"))
    scored = scored.join(thirds, ["case_id", "score"]).select("case_id", "subsystem", "score", "tercile")
    out = cases.select("case_id", "subsystem").join(totals, ["case_id", "subsystem"], "left").join(scored, ["case_id", "subsystem"], "left")
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    reason = F.when(F.coalesce("commits", F.lit(0)) == 0, "no_commits").when(F.col("commits") < min_commits, "low_activity").otherwise("")
    return out.select("case_id", "subsystem", n("commits"), n("churn"), n("defects"), "score", "tercile", F.when(F.col("subsystem").isNotNull(), F.coalesce(F.col("tercile") == 3, F.lit(False))).alias("risky"), reason.alias("reason"))
