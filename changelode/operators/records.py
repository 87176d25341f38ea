"""Records and commits as relations, and aggregates over signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelode.functions.paths import changed_lines, is_ancillary, subsystem

KEY = ["repository", "number"]


def records(pr_record: DataFrame) -> DataFrame:
    """One row a record: second deliveries are dropped by the record id."""
    return pr_record.where(F.col("original").isNotNull()).dropDuplicates(["record_id"])


def place(log: DataFrame) -> Column:
    """A row's place in the log; unknown places come last."""
    return F.coalesce("log_idx", F.lit(2**62)) if "log_idx" in log.columns else F.lit(0).cast("bigint")


def first_places(log: DataFrame) -> DataFrame:
    """(repository, sha, place): the first row of each commit, as narrow rows."""
    return log.where("sha is not null and repository is not null").groupBy("repository", "sha").agg(F.min(place(log)).alias("place"))


def patches(pr_record: DataFrame) -> DataFrame:
    """(record_id, sha, patch): patch ids of later commits, as the stored signals record them."""
    r = pr_record.where(F.col("original").isNotNull())
    each = [r.select("record_id", F.explode(f"retrospective.{t}").alias("s")).select("record_id", F.col("s.source_ref").alias("sha"), F.col("s.logical_patch_id").alias("patch")) for t in ("strong_signals", "medium_signals")]
    return each[0].unionByName(each[1]).where("sha is not null and patch != ''").groupBy("record_id", "sha").agg(F.min("patch").alias("patch"))


def locations_of_commits(prs: DataFrame) -> DataFrame:
    """(repository, sha, path, function): functions of the commits that belong to a request, as its record lists them."""
    own = prs.select("repository", "commit_shas", F.explode("changed_function_locations").alias("l"))
    return own.select("repository", F.explode("commit_shas").alias("sha"), "l.path", "l.function").where("sha is not null and path != '' and function != ''").distinct()


def requests(pr_record: DataFrame) -> DataFrame:
    """The original facts of each request, flat.

    Facts are flat before second deliveries are dropped, so that only those a query needs are shuffled.
    """
    flat = pr_record.where(F.col("original").isNotNull()).select("record_id", "original.*", F.col("provenance.observation_end").alias("observation_end"))
    return flat.dropDuplicates(["record_id"])


def commits(log: DataFrame) -> DataFrame:
    """One row a commit and repository; the first of repeated rows by log position."""
    cols = ["sha", "author_date", "committer_date", "subject", "full_message", "parents", "log_idx"]
    first = F.min_by(F.struct(*cols), F.coalesce("log_idx", F.lit(2**62))).alias("c")
    return log.where("sha is not null and repository is not null").groupBy("repository", F.col("sha").alias("key")).agg(first).select("repository", "c.*")


def targets(prs: DataFrame) -> DataFrame:
    """(record_id, repository, number, merged_at, observation_end, target): every commit id of a request."""
    shas = F.array_distinct(F.filter(F.transform(F.concat(F.array("merge_commit_sha", "head_sha"), F.coalesce("commit_shas", F.array().cast("array<string>"))), F.lower), lambda s: F.length(s) >= 6))
    return prs.select("record_id", *KEY, "merged_at", "observation_end", F.explode(shas).alias("target"))


def commit_paths(pr_record: DataFrame) -> DataFrame:
    """(repository, sha, path): paths of later commits, as the stored signals record them."""
    r = pr_record.where(F.col("original").isNotNull()).select(F.col("original.repository").alias("repository"), "retrospective")
    each = [
        r.select("repository", F.explode(f"retrospective.{tier}").alias("s")).where("s is not null").select("repository", F.col("s.source_ref").alias("sha"), F.explode("s.changed_paths").alias("path"))
        for tier in ("strong_signals", "medium_signals")
    ]
    return each[0].unionByName(each[1]).where("repository is not null and sha is not null and path is not null").distinct()


def files(prs: DataFrame) -> DataFrame:
    """(record_id, repository, number, path, additions, deletions), one row a changed file."""
    return prs.select("record_id", *KEY, "merged_at", F.explode("changed_files").alias("f")).where("f.path is not null").select("record_id", *KEY, "merged_at", "f.path", "f.additions", "f.deletions")


def primary_subsystem(prs: DataFrame) -> DataFrame:
    """(record_id, subsystem): the code group with most changed lines, ancillary groups only without code.

    Ties go to the lesser name; a request without files has ``(none)``.
    """
    group = subsystem(F.col("path")).alias("name")
    weights = files(prs).groupBy("record_id", group).agg(F.sum(F.coalesce("additions", F.lit(0)) + F.coalesce("deletions", F.lit(0))).alias("lines"))
    best = weights.groupBy("record_id").agg(F.min(F.struct(is_ancillary(F.col("name")).alias("ancillary"), (-F.col("lines")).alias("less"), "name"))["name"].alias("subsystem"))
    return prs.select("record_id").join(best, "record_id", "left").select("record_id", F.coalesce("subsystem", F.lit("(none)")).alias("subsystem"))


def sizes(prs: DataFrame) -> DataFrame:
    return prs.select("record_id", changed_lines(F.col("changed_files")).alias("changed_lines"))


def exposure(merged: Column, end: Column) -> Column:
    """Whole days from merge to the end of observation; null without both or if reversed."""
    span = F.unix_micros(end) - F.unix_micros(merged)
    return F.when(span >= 0, F.floor(span / F.lit(86_400_000_000)).cast("bigint"))


def count(array: Column) -> Column:
    """Elements of an array; null arrays have none."""
    return F.coalesce(F.size(F.filter(array, lambda x: F.lit(True))), F.lit(0)).cast("bigint")


def is_counted() -> Column:
    """Whether a record's later commits were ever looked for: it says what correlated it."""
    return F.coalesce(F.col("provenance.correlated_by") != "", F.lit(False))


def is_positive(tier_: str = "strong") -> Column:
    """Whether a record has a signal of the tier: ``strong``, or ``any`` for a strong or a medium one."""
    if tier_ not in ("strong", "any"):
        raise ValueError(f"unknown tier {tier_!r}")
    strong = count(F.col("retrospective.strong_signals")) > 0
    return strong if tier_ == "strong" else strong | (count(F.col("retrospective.medium_signals")) > 0)


def tiers(pr_record: DataFrame) -> DataFrame:
    """(record_id, class): the strongest tier of each record; no signal is shuffled."""
    return pr_record.where(F.col("original").isNotNull()).select("record_id", tier().alias("class")).dropDuplicates(["record_id"])


def tier(retrospective: str = "retrospective") -> Column:
    """The strongest tier that holds a signal."""
    has = lambda t: count(F.col(f"{retrospective}.{t}")) > 0
    return F.when(has("strong_signals"), "strong").when(has("medium_signals"), "medium").when(has("weak_signals"), "weak").otherwise("none")


def digest(values: Column) -> Column:
    """SHA-256 of the sorted values, one a line."""
    return F.sha2(F.concat(F.array_join(F.array_sort(values), "\n"), F.lit("\n")), 256)


def two_level_digest(rows: DataFrame, group: list[str], value: str, buckets: int = 256) -> DataFrame:
    """Per group a digest that never gathers a group in one task: digests of buckets by the
    value's first byte, then a digest of those (at most ``buckets``) in order."""
    part = rows.groupBy(*group, F.substring(value, 1, 2).alias("bucket")).agg(digest(F.collect_list(value)).alias("inner"), F.count("*").alias("n"))
    return part.groupBy(*group).agg(digest(F.collect_list(F.concat("bucket", F.lit(":"), "inner"))).alias("digest"), F.sum("n").alias("n"))
