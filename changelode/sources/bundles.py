"""Cached provider bundles: one JSON file a request, by repository and number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelode.sources.jsonl import replace

BUNDLE = """bundle_version string,
pull_request struct<number:bigint,title:string,body:string,created_at:timestamp,updated_at:timestamp,merged_at:timestamp,commits:bigint,html_url:string,user:struct<login:string>,
  base:struct<ref:string,sha:string>,head:struct<ref:string,sha:string>,merge_commit_sha:string,labels:array<struct<name:string>>>,
issue_comments array<struct<id:bigint,body:string,created_at:timestamp,html_url:string,user:struct<login:string>>>, issue_comments_complete boolean,
review_comments array<struct<id:bigint,body:string,created_at:timestamp,html_url:string,user:struct<login:string>>>, review_comments_complete boolean,
commits array<struct<sha:string,commit:struct<message:string,author:struct<date:timestamp>,committer:struct<date:timestamp>>>>,
issue_events array<struct<event:string,created_at:timestamp,rename:struct<`from`:string,`to`:string>>>, issue_events_complete boolean,
body_edits array<struct<created_at:timestamp,edited_at:timestamp,updated_at:timestamp,deleted_at:timestamp,editor:string,diff:string>>, body_edits_complete boolean,
body_edits_fetched_at timestamp, body_edits_error string, fetched_at timestamp"""


def path_of(repository: str, number: int) -> str:
    """A bundle's place below the cache folder."""
    return f"{repository.replace('/', '_')}/prs/pr_{number}.json"


def read(spark: SparkSession, cache: str) -> DataFrame:
    """All bundles of a cache folder with the repository folder and number of their path."""
    rows = spark.read.schema(BUNDLE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "pr_*.json").json(cache)
    place = F.col("_metadata.file_path")
    return rows.select("*", F.regexp_extract(place, r"/([^/]+)/prs/pr_\d+\.json$", 1).alias("repository_dir"), F.regexp_extract(place, r"/pr_(\d+)\.json$", 1).cast("bigint").alias("number"))


def cached_first(spark: SparkSession, wanted: DataFrame, cache: str, fetch: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Bundles of the requests wanted (repository, number): cached ones, and what ``fetch`` gives for the rest.

    Without ``fetch`` (offline) a request that is not cached is an error. A cached file without
    a readable request counts as not cached.
    """
    place = F.concat(F.regexp_replace("repository", "/", "_"))
    keys = wanted.select(place.alias("repository_dir"), "number", "repository").distinct()
    have = read(spark, cache).where("pull_request is not null").join(keys.drop("repository"), ["repository_dir", "number"], "left_semi")
    lack = keys.join(have.select("repository_dir", "number"), ["repository_dir", "number"], "left_anti")
    if fetch is None:
        if rows := lack.take(10):
            raise LookupError("not cached: " + ", ".join(f"{r['repository']}#{r['number']}" for r in rows))
        return have
    return have.unionByName(fetch(lack.select("repository", "number")), allowMissingColumns=True)


def store(cache: str, repository: str, number: int, bundle: str) -> str:
    """Writes one bundle to its place in a local cache, over a former one."""
    target = f"{cache}/{path_of(repository, number)}"
    replace(target, bundle)
    return target


def original(bundles: DataFrame) -> DataFrame:
    """The facts at the time of the merge, as a request record has them."""
    pr = "pull_request."
    texts = F.filter(F.transform("commits", lambda c: c["commit"]["message"]), lambda m: m.isNotNull() & (m != ""))
    refs = F.regexp_extract_all(F.coalesce(F.col(pr + "body"), F.lit("")), F.lit(r"(?i)(?:fixes|closes|resolves|issue|see)?\s*#([0-9]+)"), F.lit(1))
    return bundles.select(
        "repository_dir", "number", F.col(pr + "title").alias("title"), F.col(pr + "body").alias("body"), F.col(pr + "user.login").alias("author"), F.col(pr + "created_at").alias("created_at"),
        F.col(pr + "merged_at").alias("merged_at"), F.col(pr + "base.ref").alias("base_ref"), F.col(pr + "base.sha").alias("base_sha"), F.col(pr + "head.sha").alias("head_sha"),
        F.col(pr + "merge_commit_sha").alias("merge_commit_sha"), F.transform(pr + "labels", lambda x: x["name"]).alias("labels"),
        F.filter(F.transform("commits", lambda c: c["sha"]), lambda s: s.isNotNull() & (s != "")).alias("commit_shas"), texts.alias("commit_messages"),
        F.array_sort(F.array_distinct(F.transform(refs, lambda r: r.try_cast("bigint")))).alias("pre_merge_issue_refs"),
    )


def title_at(current, events, complete, cutoff):
    """A title as of ``cutoff`` by undoing later renames, newest first, or null.

    Each rename undone must lead to the title in hand and carry a time and a former title; an
    incomplete history gives null.
    """
    late = F.filter(events, lambda e: (e["event"] == "renamed") & (e["created_at"].isNull() | (e["created_at"] > cutoff)))
    newest = F.reverse(F.array_sort(F.transform(late, lambda e: F.struct(e["created_at"].alias("at"), e["rename"]["from"].alias("from"), e["rename"]["to"].alias("to")))))
    start = F.struct(current.alias("title"), F.lit(True).alias("ok"))
    undo = lambda acc, e: F.struct(
        e["from"].alias("title"), (acc["ok"] & e["at"].isNotNull() & (F.coalesce(e["from"], F.lit("")) != "") & (e["to"] == acc["title"])).alias("ok")
    )
    out = F.aggregate(F.coalesce(newest, F.array().cast("array<struct<at:timestamp,from:string,to:string>>")), start, lambda acc, e: undo(acc, e))
    return F.when(complete & F.coalesce(out["ok"], F.lit(False)), out["title"])
