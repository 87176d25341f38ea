"""Rows and totals of a selection report, and the relations of one record's evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelode.operators import records


def tier_label(strong: Column, medium: Column, weak: Column) -> Column:
    """The strongest tier with its count, or a dash."""
    n = lambda c, name: F.concat(c.cast("string"), F.lit(" " + name))
    return F.when(strong > 0, n(strong, "strong")).when(medium > 0, n(medium, "medium")).when(weak > 0, n(weak, "weak")).otherwise("-")


def human_bytes(n: Column) -> Column:
    """A size in units of 1,024 with one decimal."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**power, F.concat(F.format_string("%.1f", n / 1024.0**power), F.lit(" " + unit))).otherwise(out)
    return out


def shortened(text: Column, size: int) -> Column:
    """A text of at most ``size`` characters, the last of a longer one being dots."""
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.substring(text, 1, size - 3), F.lit("...")))


def rows(pr_record: DataFrame, blockers: DataFrame | None = None) -> DataFrame:
    """One report row a record: scores, counts of signals and files, lines, subsystem and what blocks its export.

    ``blockers``: record_id, blocker (null: none); without it nothing is known to block.
    """
    r = records.records(pr_record)
    size = lambda t: records.count(F.col(f"retrospective.{t}_signals")).alias(t)
    total = lambda f: F.aggregate(F.coalesce(F.filter("original.changed_files", lambda x: x.isNotNull()), F.array()), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x[f], F.lit(0))).alias(f)
    flat = r.select(
        "record_id", "original.repository", "original.number", "original.title", F.date_format("original.merged_at", "yyyy-MM-dd").alias("merged_on"), F.coalesce("stateful.score", F.lit(0.0)).alias("score"),
        "stateful.category", F.coalesce("retrospective.summary_rank_score", F.lit(0.0)).alias("rank"), size("strong"), size("medium"), size("weak"),
        records.count(F.col("original.changed_files")).alias("files"), total("additions"), total("deletions"),
    )
    out = flat.join(records.primary_subsystem(records.requests(pr_record)), "record_id")
    return out.withColumn("blocker", F.lit(None).cast("string")) if blockers is None else out.join(blockers.select("record_id", "blocker"), "record_id", "left")


def ordered(report: DataFrame) -> DataFrame:
    """Report order: by subsystem, then rank and score downwards, then number."""
    return report.orderBy("subsystem", F.desc("rank"), F.desc("score"), "number", "record_id")


def totals(report: DataFrame) -> DataFrame:
    """One row: candidates, subsystems, exportable and blocked ones."""
    by = report.groupBy("subsystem").agg(F.count("*").alias("n"), F.count("blocker").alias("blocked"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("candidates"), F.count("*").alias("subsystems"), F.coalesce(F.sum(F.col("n") - F.col("blocked")), F.lit(0)).alias("exportable"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("blocked"))


def signal_rows(pr_record: DataFrame) -> DataFrame:
    """(record_id, signal_id, strength, place, source_ref, commit, patch, raw): every signal beside its own JSON.

    ``commit`` is the lower-cased id where the reference is a full one to a commit.
    """
    parts = []
    for tier in ("strong", "medium", "weak"):
        s = records.records(pr_record).select("record_id", F.posexplode(f"retrospective.{tier}_signals").alias("at", "s")).where("s is not null")
        source = F.upper("s.source_type") if tier != "weak" else F.lit("")
        full = F.lower("s.source_ref").rlike(r"^[0-9a-f]{40}\z") & F.coalesce(source.isin("", "COMMIT"), F.lit(True))
        patch = F.nullif("s.logical_patch_id", F.lit("")) if tier != "weak" else F.lit(None).cast("string")
        parts.append(s.select(
            "record_id", F.concat(F.lit(f"{tier}:"), F.col("at").cast("string")).alias("signal_id"), F.lit(tier).alias("strength"), F.col("at").cast("bigint").alias("place"), F.col("s.source_ref").alias("source_ref"),
            F.when(full, F.lower("s.source_ref")).alias("commit"), patch.alias("patch"), F.to_json("s").alias("raw"),
        ))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def commit_rows(signals: DataFrame, related: DataFrame, exported: DataFrame) -> DataFrame:
    """(record_id, commit, signals, relationships, state, patch, error): what is known of each commit a record names.

    ``related``: record_id, commit, place; ``exported``: sha, subject, patch, error. A commit git
    does not know is ``missing``, one without a patch ``metadata_only``.
    """
    named = signals.where("commit is not null").select("record_id", "commit").unionByName(related.where("commit is not null").select("record_id", "commit")).distinct()
    by_signal = signals.where("commit is not null").groupBy("record_id", "commit").agg(F.array_sort(F.collect_set("signal_id")).alias("signals"))
    by_relation = related.where("commit is not null").groupBy("record_id", "commit").agg(F.array_sort(F.collect_set("place")).alias("relationships"))
    known = exported.select(F.lower("sha").alias("commit"), "subject", "patch", "error").dropDuplicates(["commit"])
    state = F.when(F.col("subject").isNull(), "missing").when(F.col("patch").isNull(), "metadata_only").otherwise("materialized")
    return named.join(by_signal, ["record_id", "commit"], "left").join(by_relation, ["record_id", "commit"], "left").join(known, "commit", "left").select("record_id", "commit", "signals", "relationships", state.alias("state"), "patch", "error")


def patch_manifests(signals: DataFrame) -> DataFrame:
    """(record_id, patch, signals, refs): the signals and sources of each logical patch."""
    rows_ = signals.where("patch is not null").groupBy("record_id", "patch")
    return rows_.agg(F.array_sort(F.collect_set("signal_id")).alias("signals"), F.array_sort(F.collect_set("source_ref")).alias("refs"))
