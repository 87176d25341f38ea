"""How a later commit relates to an earlier request: line lineage and its limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelode.functions import paths, refs
from changelode.operators import records
from changelode.operators.diffs import REVERSAL_COUNTS, reversal
from changelode.operators.ranking import islands

# Sizes beyond which a commit's analysis is flagged.
MAX_PATHS, MAX_RANGES, MAX_LINES = 20, 20, 500


def lineage(candidates: DataFrame, removed: DataFrame, blame: DataFrame, targets: DataFrame) -> DataFrame:
    """Per candidate how many removed lines trace to the request's own commits.

    ``candidates``: record_id, sha. ``removed``: sha, path, line. ``blame``: sha, path, line,
    origin_sha (of the parent). ``targets``: record_id, target. All lines are analysed,
    whatever a commit's size; a candidate without removed lines has zeros.
    """
    lines = candidates.distinct().join(removed.select("sha", "path", "line").distinct(), "sha")
    traced = lines.join(blame.select("sha", "path", "line", F.lower("origin_sha").alias("origin_sha")), ["sha", "path", "line"], "left")
    own = targets.where(F.length("target") == 40).select("record_id", F.col("target").alias("origin_sha"), F.lit(True).alias("own")).distinct()
    counted = traced.join(own, ["record_id", "origin_sha"], "left").groupBy("record_id", "sha").agg(
        F.count("*").alias("removed_lines"), F.count("origin_sha").alias("analyzed_lines"), F.count("own").alias("blamed_lines"),
        F.array_sort(F.collect_set(F.when(F.col("own"), F.col("origin_sha")))).alias("matched"),
    )
    n = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return candidates.distinct().join(counted, ["record_id", "sha"], "left").select(
        "record_id", "sha", n("removed_lines"), n("analyzed_lines"), n("blamed_lines"), F.coalesce(F.try_divide("blamed_lines", "analyzed_lines"), F.lit(0.0)).alias("fraction"),
        F.coalesce("matched", F.array().cast("array<string>")).alias("matched"),
    )


def over_limits(removed: DataFrame) -> DataFrame:
    """(sha, paths, ranges, lines, over): commits' sizes and which of them a bounded analysis would cut."""
    ranges = islands(removed, ["sha", "path"], "line").groupBy("sha", "path").agg(F.count("*").alias("ranges"), F.sum("n").alias("lines"))
    out = ranges.groupBy("sha").agg(F.count("*").alias("paths"), F.max("ranges").alias("ranges"), F.sum("lines").alias("lines"))
    return out.withColumn("over", (F.col("paths") > MAX_PATHS) | (F.col("ranges") > MAX_RANGES) | (F.col("lines") > MAX_LINES))


def status(parents, readable):
    """The state of a candidate's analysis, from its number of parents and whether its diffs are readable."""
    return F.when(parents.isNull(), "error").when(parents > 1, "skipped_merge").when(parents == 0, "skipped_root").when(readable, "complete").otherwise("partial")


def relationships(
    candidates: DataFrame, heads: DataFrame, removed: DataFrame, blame: DataFrame, targets: DataFrame, requests: DataFrame, request_lines: DataFrame, commits: DataFrame, commit_lines: DataFrame, reverse: DataFrame
) -> DataFrame:
    """(record_id, source_ref, analysis_status, analysis_note, lineage, reversal): every candidate put together.

    ``candidates``: record_id, sha. ``heads``: sha, parents, error. ``removed``: sha, path, line,
    content. ``blame``: sha, path, line, origin_sha, error. ``targets``: record_id, target.
    ``requests``: record_id, patch_id, error, and ``request_lines``: record_id, kind, path, content.
    ``commits``: sha, error, and ``commit_lines``: sha, kind, path, content. ``reverse``: sha,
    patch_id, error.

    A commit that is not among ``heads`` is ``unavailable``, an unreadable one an ``error``;
    merges and roots are skipped. The others have their lineage; a reversal needs both diffs.
    They are ``partial``, with a note, where a blame, a diff or a patch id is missing.
    """
    known = candidates.select("record_id", "sha").distinct()
    one = lambda df, *cols: df.dropDuplicates(["sha"]).select("sha", *cols)
    state = known.join(one(heads, "parents", F.col("error").alias("head_error"), F.lit(True).alias("seen")), "sha", "left")
    kind = F.when(F.col("seen").isNull(), "unavailable").when(F.col("head_error").isNotNull() | F.col("parents").isNull(), "error").when(F.col("parents") > 1, "skipped_merge").when(F.col("parents") == 0, "skipped_root")
    state = state.withColumn("state", kind)
    open_ = state.where("state is null").select("record_id", "sha")

    lines = lineage(open_, removed, blame.where("error is null"), targets)
    failed = blame.where("error is not null").groupBy("sha").agg(F.concat_ws("; ", F.array_sort(F.collect_set(F.concat(F.lit("blame of "), "path", F.lit(": "), "error")))).alias("blame_error"))
    own = targets.where(F.length("target") == 40).select("record_id", F.col("target").alias("origin_sha")).distinct()
    traced = open_.join(blame.where("error is null").select("sha", "path", "line", F.lower("origin_sha").alias("origin_sha")), "sha").join(own, ["record_id", "origin_sha"], "left_semi")
    supported = traced.join(removed.select("sha", "path", "line", "content").distinct(), ["sha", "path", "line"]).select("record_id", "sha", "path", "content")

    asked = requests.dropDuplicates(["record_id"]).select("record_id", F.col("patch_id").alias("original_patch"), F.col("error").alias("request_error"), F.lit(True).alias("asked"))
    read = open_.join(asked, "record_id", "left").join(one(commits, F.col("error").alias("commit_error"), F.lit(True).alias("fetched")), "sha", "left").join(one(reverse, F.col("patch_id").alias("reverse_patch"), F.col("error").alias("reverse_error")), "sha", "left")
    request_fault = F.when(F.col("asked").isNull(), "request diff: unavailable").when(F.col("request_error").isNotNull(), F.concat(F.lit("request diff: "), "request_error"))
    commit_fault = F.when(F.col("fetched").isNull(), "commit diff: unavailable").when(F.col("commit_error").isNotNull(), F.concat(F.lit("commit diff: "), "commit_error"))
    read = read.withColumn("request_fault", request_fault).withColumn("commit_fault", commit_fault)
    both = read.where("request_fault is null and commit_fault is null").select("record_id", "sha", "original_patch", "reverse_patch")
    key = ["record_id", "sha"]
    original = both.select(*key).join(request_lines.select("record_id", "kind", "path", "content"), "record_id")
    later = both.select(*key).join(commit_lines.select("sha", "kind", "path", "content"), "sha").select(*key, "kind", "path", "content")
    undone = reversal(original, later, supported.join(both.select(*key), key, "left_semi"), key, both)

    patch_fault = F.when(F.col("request_fault").isNull() & F.col("commit_fault").isNull(), F.concat_ws("; ", F.when(F.coalesce("original_patch", F.lit("")) == "", "no patch id of the request"), F.when(F.coalesce("reverse_patch", F.lit("")) == "", F.concat(F.lit("no reverse patch id: "), F.coalesce("reverse_error", F.lit("unavailable"))))))
    notes = read.join(failed, "sha", "left").select(*key, F.concat_ws(" | ", "blame_error", F.nullif(F.concat_ws("; ", "request_fault", "commit_fault", F.nullif(patch_fault, F.lit(""))), F.lit(""))).alias("note"))
    counts = [F.col(c) for c in REVERSAL_COUNTS]
    empty = F.array().cast("array<struct<path:string,added:bigint,removed:bigint,removed_again:bigint,added_again:bigint,supported:bigint>>")
    taken = F.struct(
        (F.coalesce("reversal_type", F.lit("none")) == "full").alias("full_reverse_patch_match"), F.coalesce("reversal_type", F.lit("none")).alias("reversal_type"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(n) for c, n in zip(counts, REVERSAL_COUNTS)],
        F.coalesce("overlap_fraction", F.lit(0.0)).alias("fraction"), F.coalesce("path_overlaps", empty).alias("path_overlaps"),
    )
    out = (
        state.join(lines.select(*key, F.struct("removed_lines", "analyzed_lines", "blamed_lines", "fraction", "matched").alias("lineage")), key, "left").join(notes, key, "left")
        .join(both.select(*key, F.lit(True).alias("both")), key, "left").join(undone.withColumnRenamed("fraction", "overlap_fraction"), key, "left")
    )
    note = F.when(F.col("state") == "unavailable", "repository is unavailable").when(F.col("state") == "error", F.coalesce("head_error", F.lit("unreadable"))).otherwise(F.coalesce("note", F.lit("")))
    return out.select(
        "record_id", F.col("sha").alias("source_ref"), F.coalesce("state", F.when(F.coalesce("note", F.lit("")) == "", "complete").otherwise("partial")).alias("analysis_status"), note.alias("analysis_note"),
        F.when(F.col("state").isNull(), F.col("lineage")).alias("lineage"), F.when(F.col("both"), taken).alias("reversal"),
    )


def homes(log: DataFrame, prs: DataFrame, changed: DataFrame) -> DataFrame:
    """(repository, target, home): every known commit id with the subsystem of its files, null if they are unknown.

    A commit's own paths (``changed``: repository, sha, path) come before the files of the request it belongs to.
    """
    weights = changed.groupBy("repository", F.lower("sha").alias("target"), paths.subsystem(F.col("path")).alias("name")).agg(F.count("*").alias("n"))
    best = F.min(F.struct(paths.is_ancillary(F.col("name")).alias("ancillary"), (-F.col("n")).alias("less"), "name"))["name"]
    own = weights.groupBy("repository", "target").agg(best.alias("home")).select("repository", "target", F.lit(0).cast("bigint").alias("rank"), "home")
    asked = records.targets(prs).join(records.primary_subsystem(prs).where("subsystem != '(none)'"), "record_id").select("repository", "target", F.col("record_id").alias("rank"), F.col("subsystem").alias("home"))
    seen = log.select("repository", F.lower("sha").alias("target"), F.lit(0).cast("bigint").alias("rank"), F.lit(None).cast("string").alias("home"))
    tiers = [x.withColumn("tier", F.lit(i)) for i, x in enumerate((own, asked, seen))]
    known = F.min(F.when(F.col("home").isNotNull(), F.struct("tier", "rank", "home")))["home"].alias("home")
    return tiers[0].unionByName(tiers[1]).unionByName(tiers[2]).groupBy("repository", "target").agg(known)


def defect_origins(log: DataFrame, prs: DataFrame, changed: DataFrame) -> DataFrame:
    """(repository, sha, attributed_by, fixed_ref, subsystem) of every commit with a strong corrective reference.

    Its ids come first, in order, then its numbers through the first merge commit of the request,
    else the commit itself. An id resolves if it begins one known commit only. A merge commit is
    one that names the number in the log, else that of the request's record.
    """
    shas, numbers, matched = refs.untargeted(F.col("full_message"))
    corrective = log.select("repository", "sha", shas.alias("shas"), numbers.alias("numbers"), matched.alias("matched")).where("matched")
    known = homes(log, prs, changed)

    cited = corrective.select("repository", "sha", F.posexplode("shas").alias("pos", "ref")).withColumn("block", F.substring("ref", 1, 6))
    hit = cited.join(known.where("length(target) >= 6").withColumn("block", F.substring("target", 1, 6)), ["repository", "block"]).where(F.col("target").startswith(F.col("ref")) | F.col("ref").startswith(F.col("target")))
    found = hit.groupBy("repository", "sha", "pos").agg(F.count_distinct(F.when(F.length("target") == 40, F.col("target"))).alias("full"), F.max(F.struct(F.length("target").alias("n"), "target", "home")).alias("x"))
    by_id = found.where("full <= 1 and x.home is not null").groupBy("repository", "sha").agg(F.min(F.struct("pos", "x.target", "x.home")).alias("id"))

    place = F.coalesce("log_idx", F.lit(2**62))
    merges = log.select("repository", "sha", F.regexp_extract("subject", refs.MERGE_SUBJECT, 1).try_cast("bigint").alias("number"), place.alias("place")).where("number > 0")
    merges = merges.groupBy("repository", "number").agg(F.lower(F.min_by("sha", F.struct("place", "sha"))).alias("target")).join(known, ["repository", "target"]).where("home is not null").select("repository", "number", F.lit(0).alias("tier"), "home")
    merged = prs.where("merge_commit_sha is not null").join(records.primary_subsystem(prs).where("subsystem != '(none)'"), "record_id")
    first = F.struct(F.col("merged_at").isNull().alias("unknown"), "merged_at", "record_id")
    merged = merged.groupBy("repository", "number").agg(F.min_by("subsystem", first).alias("home")).select("repository", "number", F.lit(1).alias("tier"), "home")
    named = corrective.select("repository", "sha", F.posexplode("numbers").alias("pos", "number")).join(merges.unionByName(merged), ["repository", "number"])
    by_number = named.groupBy("repository", "sha").agg(F.min(F.struct("pos", "tier", "number", "home")).alias("pr"))

    own = known.withColumnsRenamed({"target": "key", "home": "own"})
    out = corrective.select("repository", "sha", F.lower("sha").alias("key")).join(own, ["repository", "key"], "left").join(by_id, ["repository", "sha"], "left").join(by_number, ["repository", "sha"], "left")
    how = F.when(F.col("id").isNotNull(), "fixed_commit").when(F.col("pr").isNotNull(), "fixed_pr_merge").otherwise("self")
    ref = F.when(F.col("id").isNotNull(), F.col("id.target")).when(F.col("pr").isNotNull(), F.concat(F.lit("#"), F.col("pr.number").cast("string")))
    return out.select("repository", "sha", how.alias("attributed_by"), ref.alias("fixed_ref"), F.coalesce("id.home", "pr.home", "own").alias("subsystem"))
