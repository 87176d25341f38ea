"""Commits that arrive over time: references extracted as a stream, replays made harmless."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from changelode.functions import refs


def commit_stream(spark: SparkSession, folder: str, late: str = "30 days") -> DataFrame:
    """New commit files of a folder, each commit once while it is not later than the watermark."""
    schema = spark.read.parquet(folder).schema
    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.withWatermark("committer_date", late).dropDuplicatesWithinWatermark(["repository", "sha"])


def references(commits: DataFrame) -> DataFrame:
    """(repository, sha, committer_date, kind, ref, snippet): what each new message cites."""
    message = F.col("full_message")
    as_kind = lambda kind, hits: F.transform(hits, lambda h: F.struct(F.lit(kind).alias("kind"), h["value"].alias("ref"), h["snippet"].alias("snippet")))
    hits = F.concat(as_kind("FIXES_SHA", refs.found(message, refs.FIXES_SHA)), as_kind("FIXES_PR", refs.found(message, refs.FIXES_PR)), as_kind("REVERT", refs.found(message, refs.REVERT_COMMIT)))
    return commits.where(refs.has_citation(message)).select("repository", "sha", "committer_date", F.explode(hits).alias("h")).select("repository", "sha", "committer_date", "h.*")


def weekly_citations(found: DataFrame) -> DataFrame:
    """Citations a week and kind; a week is final once the watermark has passed it."""
    return found.groupBy(F.window("committer_date", "7 days").alias("week"), "kind").agg(F.count("*").alias("n")).select(F.col("week.start").alias("week"), "kind", "n")


def run(found: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet exactly once, for what is there now; call again to go on."""
    return found.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
