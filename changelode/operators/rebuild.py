"""Records put together from a seed list and cached parts, without a network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing(seed: DataFrame, bundles: DataFrame, diffs: DataFrame, key: list[str]) -> DataFrame:
    """(key, part): what a seed's members lack; a caller that must fail checks that there is nothing."""
    wanted = seed.select(*key).distinct()
    lacks = lambda part, name: wanted.join(part.select(*key), key, "left_anti").withColumn("part", F.lit(name))
    return lacks(bundles, "bundle").unionByName(lacks(diffs, "diff"))


def rebuild(seed: DataFrame, bundles: DataFrame, diffs: DataFrame, key: list[str]) -> DataFrame:
    """Members of the seed, once each, with bundle and diff columns; failed diffs leave theirs null."""
    return seed.select(*key).distinct().join(bundles.dropDuplicates(key), key).join(diffs.dropDuplicates(key), key, "left")
