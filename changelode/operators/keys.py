"""The held-out material of a case: fixing commits, what they refer to, and identifiers in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelode.functions import refs

FULL_ID = r"^[0-9a-f]{40}\z"


def fixing_commits(records: DataFrame) -> DataFrame:
    """(record_id, sha, tier, matched_by): the last strong signal of a commit, else its first medium one.

    References that are no full commit id are left out; :func:`unresolved` lists them.
    """
    rows = _signals(records).where(F.col("sha").rlike(FULL_ID))
    key = F.struct(F.when(F.col("tier") == "strong", 0).otherwise(1).alias("t"), F.when(F.col("tier") == "strong", -F.col("pos")).otherwise(F.col("pos")).alias("p"), "tier", "signal_type")
    best = rows.groupBy("record_id", "sha").agg(F.min(key).alias("b"))
    return best.select("record_id", "sha", F.col("b.tier").alias("tier"), F.col("b.signal_type").alias("matched_by"))


def unresolved(records: DataFrame) -> DataFrame:
    """(record_id, tier, signal_type, ref): signals that name no full commit id."""
    rows = _signals(records)
    return rows.where(F.coalesce(~F.col("sha").rlike(FULL_ID), F.lit(True))).select("record_id", "tier", "signal_type", F.col("sha").alias("ref"))


def _signals(records: DataFrame) -> DataFrame:
    parts = [
        records.select("record_id", F.lit(tier).alias("tier"), F.posexplode(f"retrospective.{tier}_signals").alias("pos", "s")).where("s is not null").select("record_id", "tier", "pos", F.col("s.source_ref").alias("sha"), F.col("s.signal_type").alias("signal_type"))
        for tier in ("strong", "medium")
    ]
    return parts[0].unionByName(parts[1])


FORBIDDEN_LEAST = 7  # bytes of a text that must not stand in what a reviewer sees


def forbidden(records: DataFrame) -> DataFrame:
    """(record_id, value): what later evidence would give away: commit ids, snippets, contexts and notes.

    Full commit ids count whatever their place; texts of fewer than seven bytes are too common
    to tell anything.
    """
    parts = []
    for tier, fields in (("strong", ("source_ref", "raw_snippet")), ("medium", ("source_ref", "context")), ("weak", ("source_ref", "context"))):
        rows = records.select("record_id", F.explode(f"retrospective.{tier}_signals").alias("s"))
        parts.append(rows.select("record_id", F.explode(F.array(*[F.col(f"s.{f}") for f in fields])).alias("value")))
    relations = records.select("record_id", F.explode("retrospective.commit_relationships").alias("r"))
    parts.append(relations.select("record_id", F.explode(F.array("r.source_ref", "r.analysis_note")).alias("value")))
    parts.append(relations.select("record_id", F.explode("r.lineage.matched_original_commit_shas").alias("value")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.where(F.octet_length("value") >= FORBIDDEN_LEAST).distinct()


def texts(fixing: DataFrame, records: DataFrame, commits: DataFrame) -> DataFrame:
    """(record_id, source, kind, body): messages of the fixing commits, without blank ones."""
    repository = records.select("record_id", F.col("original.repository").alias("repository"))
    found = fixing.join(repository, "record_id").join(commits.select("repository", "sha", "full_message"), ["repository", "sha"])
    return found.where(F.btrim("full_message") != "").select("record_id", F.concat(F.lit("commit/"), F.col("sha")).alias("source"), F.lit("fixing_commit_message").alias("kind"), F.col("full_message").alias("body"))


def incomplete(fixing: DataFrame, records: DataFrame, commits: DataFrame) -> DataFrame:
    """(record_id, what): sources that are missing; a case is complete without any."""
    repository = records.select("record_id", F.col("original.repository").alias("repository"))
    return fixing.join(repository, "record_id").join(commits.select("repository", "sha"), ["repository", "sha"], "left_anti").select("record_id", F.concat(F.lit("commit message "), F.col("sha")).alias("what"))


def issues(found: DataFrame, fixing_numbers: DataFrame, own: DataFrame) -> DataFrame:
    """(record_id, number): numbers the texts refer to, less the case's own and the fixing requests'.

    ``fixing_numbers`` and ``own``: record_id, number.
    """
    number = F.explode(F.regexp_extract_all("body", F.lit(refs.java(refs.NUMBER_REF)), F.lit(1))).alias("n")
    named = found.select("record_id", number).select("record_id", F.col("n").try_cast("bigint").alias("number")).where("number > 0").distinct()
    return named.join(fixing_numbers.unionByName(own), ["record_id", "number"], "left_anti")


def cves(found: DataFrame) -> DataFrame:
    """(record_id, cve): distinct identifiers in upper case."""
    return found.select("record_id", F.explode(F.regexp_extract_all("body", F.lit(refs.java(refs.CVE)), F.lit(0))).alias("cve")).select("record_id", F.upper("cve").alias("cve")).distinct()
