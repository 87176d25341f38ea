"""Which fields of a cached bundle are known to have held at a cut-off.

Each function gives a struct (outcome, method, value) as a column over the bundle's columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from changelode.sources.bundles import title_at

# Outcomes and methods.
ADMITTED, EDITED_LATER, UNVERIFIABLE = "admitted", "omitted-post-cutoff-edit", "omitted-unverifiable"
CURRENT, RECONSTRUCTED = "current", "reconstructed"


def outcomes(decisions: DataFrame) -> DataFrame:
    """(field, outcome, n): how often each field was admitted or not."""
    return decisions.groupBy("field", "outcome").agg(F.count("*").alias("n"))


#: Contracts of the metadata a reviewer sees; without a name, the first holds.
CONTRACTS = {"": "v1", "v1": "v1", "v2": "v2"}


def contract(name: str) -> str:
    if name not in CONTRACTS:
        raise ValueError(f"unknown metadata contract {name!r}")
    return CONTRACTS[name]


def unchanged_since(cutoff: Column) -> dict[str, Column]:
    """The first contract: title, description and base branch, each only if the request was not updated after the cut-off."""
    pr = "pull_request."
    still = F.coalesce(F.col(pr + "updated_at") <= cutoff, F.lit(False))
    return {n: F.when(still, F.col(c)) for n, c in (("title", pr + "title"), ("description", pr + "body"), ("base_branch", pr + "base.ref"))}


def _result(outcome: str, method: str | None = None, value: Column | None = None) -> Column:
    return F.struct(F.lit(outcome).alias("outcome"), F.lit(method).cast("string").alias("method"), (value if value is not None else F.lit(None).cast("string")).alias("value"))


def _existed(cutoff: Column) -> Column:
    created = F.col("pull_request.created_at")
    return created.isNotNull() & (created <= cutoff)


def title(cutoff: Column) -> Column:
    """Admitted as it is without later renames, reconstructed through a complete chain, else unverifiable."""
    events = F.coalesce(F.col("issue_events"), F.array())
    late = F.exists(events, lambda e: (e["event"] == "renamed") & (e["created_at"].isNull() | (e["created_at"] > cutoff)))
    complete = F.coalesce(F.col("issue_events_complete"), F.lit(False))
    then = title_at(F.col("pull_request.title"), F.col("issue_events"), complete, cutoff)
    return (
        F.when(~F.coalesce(_existed(cutoff), F.lit(False)) | ~complete, _result(UNVERIFIABLE))
        .when(~late, _result(ADMITTED, CURRENT, F.col("pull_request.title")))
        .when(then.isNotNull(), _result(ADMITTED, RECONSTRUCTED, then))
        .otherwise(_result(UNVERIFIABLE))
    )


def description(cutoff: Column) -> Column:
    """Admitted without edits after the cut-off in a complete history without gaps; it can't be reconstructed."""
    edits = F.coalesce(F.col("body_edits"), F.array())
    gap = F.exists(edits, lambda e: e["deleted_at"].isNotNull() | e["edited_at"].isNull())
    late = F.exists(edits, lambda e: e["edited_at"] > cutoff)
    complete = F.coalesce(F.col("body_edits_complete"), F.lit(False))
    return (
        F.when(~F.coalesce(_existed(cutoff), F.lit(False)) | ~complete | F.coalesce(gap, F.lit(False)), _result(UNVERIFIABLE))
        .when(F.coalesce(late, F.lit(False)), _result(EDITED_LATER))
        .otherwise(_result(ADMITTED, CURRENT, F.col("pull_request.body")))
    )


def base_branch(cutoff: Column) -> Column:
    """The base branch if the whole response was final at the cut-off, else null."""
    updated = F.col("pull_request.updated_at")
    return F.when(updated.isNotNull() & (updated <= cutoff) & (F.col("pull_request.base.ref") != ""), F.col("pull_request.base.ref"))


def commit_messages(cutoff: Column) -> Column:
    """All messages if the merge froze the list by the cut-off and every commit is early enough, else null."""
    commits = F.coalesce(F.col("commits"), F.array())
    when = lambda c: F.coalesce(c["commit"]["committer"]["date"], c["commit"]["author"]["date"])
    fine = F.forall(commits, lambda c: F.coalesce(c["commit"]["message"].isNotNull() & (when(c) <= cutoff), F.lit(False)))
    frozen = F.coalesce(F.col("pull_request.merged_at") <= cutoff, F.lit(False)) & (F.col("pull_request.commits") == F.size(commits))
    return F.when(frozen & fine, F.transform(commits, lambda c: c["commit"]["message"]))
