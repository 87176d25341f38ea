"""Later commits as evidence on earlier requests.

No request is compared with all commits: each signal is an equi-join on what the message
names (a commit id's first six digits, a number, a number's prefixes, a path, a function), and
the time window is applied to what the join leaves.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelode.functions import refs
from changelode.operators.records import KEY, files, first_places, place, targets
from changelode.plans.spread import spread

WINDOW_DAYS = 90
NAME_LEAST = 6  # characters of a function name that may match in free text


def after_merge(date: Column, merged: Column, end: Column) -> Column:
    """Strictly after the merge and up to the end of observation, if there is one."""
    return (date > merged) & (end.isNull() | (date <= end))


def mentions(commits: DataFrame, hits: Column) -> DataFrame:
    """One row a hit with its position, for commits that pass the cheap citation test."""
    kept = commits.where(refs.has_citation(F.col("full_message")))
    return kept.select("repository", "sha", "author_date", F.posexplode(hits).alias("pos", "hit"))


STRONG = ("FIXES_SHA", "FIXES_PR", "EXPLICIT_REVERT", "REGRESSION_MENTION")


def strong_hits(log: DataFrame, kinds: Sequence[str] = STRONG) -> DataFrame:
    """(repository, sha, author_date, kind, turn, pos, ref, numbers, snippet): all that messages cite, in one pass.

    Messages are read where they lie and never shuffled: what a message names leaves the scan
    as narrow rows, and second deliveries of a commit are told apart by narrow log places.
    """
    m, none = F.col("full_message"), F.lit(None).cast("string")
    several = lambda c: F.array(c.try_cast("bigint"))

    def hit(kind: str, turn: int, found: Column, ref: Callable[[Column], Column], numbers: Callable[[Column], Column]) -> Column:
        return F.transform(found, lambda x, i: F.struct(F.lit(kind).alias("kind"), F.lit(turn).alias("turn"), i.alias("pos"), ref(x).alias("ref"), numbers(x).alias("numbers"), x["snippet"].alias("snippet")))

    no_ref, no_number = lambda x: none, lambda x: F.lit(None).cast("array<bigint>")
    prefixes = lambda x: F.transform(F.filter(refs.digit_prefixes(x["value"]), lambda d: ~d.startswith("0")), lambda d: d.try_cast("bigint"))
    every = {
        "FIXES_SHA": [hit("FIXES_SHA", 0, refs.found(m, refs.FIXES_SHA), lambda x: F.lower(x["value"]), no_number)],
        "FIXES_PR": [hit("FIXES_PR", 0, refs.found(m, refs.FIXES_PR), no_ref, lambda x: several(x["value"]))],
        "EXPLICIT_REVERT": [
            hit("EXPLICIT_REVERT", 0, refs.found(m, refs.REVERT_COMMIT), lambda x: F.lower(x["value"]), no_number),
            hit("EXPLICIT_REVERT", 1, refs.found(m, refs.REVERT_SUBJECT), no_ref, prefixes),
        ],
        "REGRESSION_MENTION": [hit("REGRESSION_MENTION", 0, refs.regressions(m), lambda x: F.lower(x["sha"]), lambda x: several(x["number"]))],
    }
    cited = F.concat(*[c for k in kinds for c in every[k]])
    rows = spread(log.where("sha is not null and repository is not null").select("repository", "sha", place(log).alias("log_idx"), "author_date", "full_message"), "sha").where(refs.has_citation(m))
    rows = rows.select("repository", "sha", F.col("log_idx").alias("place"), "author_date", F.explode(cited).alias("h")).select("repository", "sha", "place", "author_date", "h.*")
    return rows.join(first_places(log), ["repository", "sha", "place"]).drop("place")


def strong(log: DataFrame, prs: DataFrame, kinds: Sequence[str] = STRONG) -> DataFrame:
    """(record_id, sha, signal_type, snippet): strong signals, the first of a kind for each request and commit.

    A cited commit id and a request's commit id begin alike, the shorter in full; both have six
    digits at least, so the first six are an exact blocking key. Numbers join by equality. A
    reverted subject counts after reverted ids; it contains the number, also as a prefix.
    """
    hits = strong_hits(log, kinds)
    keep = ["record_id", "sha", "author_date", "merged_at", "observation_end", "kind", "turn", "pos", "snippet"]
    ids = hits.where(F.length("ref") >= refs.SHA_LEAST).withColumn("block", F.substring("ref", 1, 6)).join(targets(prs).withColumn("block", F.substring("target", 1, 6)), ["repository", "block"])
    ids = ids.where(F.col("target").startswith(F.col("ref")) | F.col("ref").startswith(F.col("target"))).select(*keep)
    numbers = hits.select("*", F.explode("numbers").alias("number")).where("number > 0").join(prs.select("record_id", *KEY, "merged_at", "observation_end"), KEY).select(*keep)
    return (
        ids.unionByName(numbers).where(after_merge(F.col("author_date"), F.col("merged_at"), F.col("observation_end")))
        .groupBy("record_id", "sha", F.col("kind").alias("signal_type"))
        .agg(F.min(F.struct("turn", "pos", "snippet"))["snippet"].alias("snippet"))
    )


def is_merge(log: DataFrame) -> Column:
    return F.coalesce(F.size("parents") > 1, F.lit(False)) if "parents" in log.columns else F.lit(False)


def corrective(log: DataFrame) -> DataFrame:
    """(repository, sha, author_date, merge): commits with fix words in the subject, or a citation; one row each.

    Only flags and dates are shuffled. Merges never give evidence of a diff.
    """
    flag = refs.has_fix_words(F.col("subject")) | refs.has_citation(F.col("full_message"))
    rows = log.where("sha is not null and repository is not null").select("repository", "sha", place(log).alias("place"), "author_date", is_merge(log).alias("merge"), F.coalesce(flag, F.lit(False)).alias("flag"))
    first = rows.groupBy("repository", "sha").agg(F.min(F.struct("place", "author_date", "merge", "flag")).alias("c"))
    return first.where("c.flag").select("repository", "sha", "c.author_date", "c.merge")


def same_function(log: DataFrame, symbols: DataFrame, prs: DataFrame) -> DataFrame:
    """(record_id, sha, function_or_path): later corrective commits, no merges, to a request's own functions.

    ``symbols``: repository, sha, path, function.
    """
    own = prs.select("record_id", "repository", "merged_at", "observation_end", F.explode("changed_function_locations").alias("l")).where("l.path != '' and l.function != ''")
    own = own.select("record_id", "repository", "merged_at", "observation_end", "l.path", "l.function")
    later = corrective(log).where("not merge").join(symbols.distinct(), ["repository", "sha"]).select("repository", "sha", "author_date", "path", "function")
    joined = own.join(later, ["repository", "path", "function"]).where(after_merge(F.col("author_date"), F.col("merged_at"), F.col("observation_end")))
    return joined.select("record_id", "sha", F.concat_ws(":", "path", "function").alias("function_or_path")).distinct()


def same_file(log: DataFrame, paths: DataFrame, prs: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """(record_id, sha, path): the first shared path of a corrective commit, no merge, within ``days`` of the merge."""
    later = corrective(log).where("not merge").join(paths, ["repository", "sha"]).select("repository", "sha", "author_date", "path")
    own = files(prs).select("record_id", "repository", "path", "merged_at").distinct()
    ends = prs.select("record_id", "observation_end")
    joined = own.join(later, ["repository", "path"]).where((F.col("author_date") > F.col("merged_at")) & (F.unix_micros("author_date") - F.unix_micros("merged_at") <= days * 86_400_000_000))
    kept = joined.join(ends, "record_id").where(F.col("observation_end").isNull() | (F.col("author_date") <= F.col("observation_end")))
    return kept.groupBy("record_id", "sha").agg(F.min("path").alias("path"))


def naming(log: DataFrame, names: DataFrame, said: Column | None = None) -> DataFrame:
    """``names`` (repository, function, ...) with the commits whose messages contain the function, also inside a longer word.

    A name has six characters at least and no blank, so its first six are a block that some run
    of the message holds; runs leave the scan once a block, and containment is tested on the
    run alone. ``said`` keeps some rows of the log only. Shorter names are left out.
    """
    names = names.where(F.length("function") >= NAME_LEAST).withColumn("block", F.substring("function", 1, NAME_LEAST))
    runs = F.array_distinct(F.regexp_extract_all("full_message", F.lit(rf"[^ \t\n\x0B\f\r]{{{NAME_LEAST},}}"), F.lit(0)))
    rows = spread(log.where("sha is not null and repository is not null").select("repository", "sha", place(log).alias("place"), "subject", "full_message"), "sha")
    rows = (rows if said is None else rows.where(said)).select("repository", "sha", "place", F.explode(F.filter(runs, lambda r: F.length(r) >= NAME_LEAST)).alias("run"))
    blocks = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("run") - NAME_LEAST + 1), lambda i: F.substring("run", i, F.lit(NAME_LEAST))))
    hit = rows.select("repository", "sha", "place", "run", F.explode(blocks).alias("block")).join(names, ["repository", "block"]).where(F.col("run").contains(F.col("function")))
    return hit.drop("run", "block").distinct().join(first_places(log), ["repository", "sha", "place"]).drop("place")


def legacy_names(log: DataFrame, prs: DataFrame, readable: DataFrame) -> DataFrame:
    """(record_id, sha, function): corrective messages that contain a request's function name.

    Counts for requests without locations, and for all where the commit is a merge or its diff
    is unknown; ``readable``: (repository, sha) of commits with a known diff.
    """
    bare = F.coalesce(F.size(F.filter("changed_function_locations", lambda x: x.isNotNull())), F.lit(0)) <= 0
    own = prs.select("record_id", "repository", "merged_at", "observation_end", bare.alias("bare"), F.explode(F.array_distinct("changed_functions")).alias("function"))
    known = readable.select("repository", "sha").distinct().withColumn("known", F.lit(True))
    states = corrective(log).join(known, ["repository", "sha"], "left").select("repository", "sha", "author_date", (F.col("merge") | F.col("known").isNull()).alias("blind"))
    hit = naming(log, own, refs.has_fix_words(F.col("subject")) | refs.has_citation(F.col("full_message"))).join(states, ["repository", "sha"]).where(F.col("bare") | F.col("blind"))
    return hit.where(after_merge(F.col("author_date"), F.col("merged_at"), F.col("observation_end"))).select("record_id", "sha", "function").distinct()


def rank(prs: DataFrame, strong_: DataFrame, medium: DataFrame, weak: DataFrame, patches: DataFrame | None = None) -> DataFrame:
    """(record_id, strong_leads, medium_leads, weak_signals, rank_score).

    Leads are distinct patches: commits with equal patch ids are one, a commit without one
    stands for itself. Weak signals count one by one. ``patches``: record_id, sha, patch.
    """

    def leads(signals: DataFrame, name: str) -> DataFrame:
        rows = signals.select("record_id", "sha").distinct()
        own = F.concat(F.lit("sha:"), F.col("sha"))
        rows = rows.withColumn("lead", own) if patches is None else rows.join(patches, ["record_id", "sha"], "left").withColumn("lead", F.coalesce(F.nullif("patch", F.lit("")), own))
        return rows.groupBy("record_id").agg(F.count_distinct("lead").alias(name))

    s, m = leads(strong_, "strong_leads"), leads(medium, "medium_leads")
    w = weak.groupBy("record_id").agg(F.count("*").alias("weak_signals"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    out = prs.select("record_id").join(s, "record_id", "left").join(m, "record_id", "left").join(w, "record_id", "left")
    out = out.select("record_id", n("strong_leads").alias("strong_leads"), n("medium_leads").alias("medium_leads"), n("weak_signals").alias("weak_signals"))
    score = F.when(F.col("strong_leads") > 0, F.lit(1.0)).when(F.col("medium_leads") > 0, 0.5 + 0.05 * F.col("medium_leads")).when(F.col("weak_signals") > 0, 0.1 + 0.02 * F.col("weak_signals")).otherwise(0.0)
    return out.withColumn("rank_score", F.least(F.lit(1.0), score))
