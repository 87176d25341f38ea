"""Line-delimited JSON: strict reading, raw lookups, ordered and new-only writing."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows under a given schema; blank lines are skipped, a malformed one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_raw(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, raw): every line's own text beside one field, so that unknown fields survive."""
    lines = spark.read.text(path).where(F.btrim("value") != "")
    return lines.select(F.get_json_object("value", f"$.{key}").alias("key"), F.col("value").alias("raw"))


def read_version(spark: SparkSession, path: str, schema: StructType | str, prefix: str, field: str = "schema_version") -> DataFrame:
    """Rows of one kind of record: a row whose version does not begin with ``prefix`` fails the read."""
    rows = read(spark, path, schema)
    wrong = F.concat(F.lit(f"{field} is no {prefix}: "), F.coalesce(F.col(field), F.lit("null")))
    return rows.withColumn(field, F.when(F.col(field).startswith(prefix), F.col(field)).otherwise(F.raise_error(wrong).cast("string")))


def lookup_first(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """The first line, in file order, whose field has the value; empty if there is none."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    hit = rows.where(F.col("value").contains(value)).where(F.get_json_object("value", f"$.{key}") == value)
    return hit.agg(F.min_by("value", F.struct("f", "b", "i")).alias("raw")).where("raw is not null")


def lookup_only(spark: SparkSession, path: str, key: str, value: str) -> str:
    """The one line whose field has the value; an error if there is none or more than one."""
    hit = read_raw(spark, path, key).where(F.col("key") == value).select("raw").take(2)
    if len(hit) != 1:
        raise LookupError(f"{key} = {value}: {'no record' if not hit else 'more than one record'} in {path}")
    return hit[0]["raw"]


def ingest(spark: SparkSession, path: str, schema: StructType | str, target: str) -> DataFrame:
    """JSON once, Parquet from then on: nested columns are pruned and filters pushed down only there."""
    read(spark, path, schema).write.mode("errorifexists").parquet(target)
    return spark.read.parquet(target)


def write_sorted(df: DataFrame, path: str, *order: str) -> None:
    """JSON lines in a total order over the part files; nulls are written, not left out."""
    df.orderBy(*order).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def replace(target: str, text: str) -> None:
    """A local file written beside its place and moved over it, so that a reader sees the old or the new one."""
    place = Path(target)
    place.parent.mkdir(parents=True, exist_ok=True)
    part = place.with_name(f".{place.name}.{uuid.uuid4().hex}")
    try:
        part.write_text(text, encoding="utf-8")
        os.replace(part, place)
    finally:
        part.unlink(missing_ok=True)


def publish(target: str, write: Callable[[str], None]) -> None:
    """A local directory all or nothing: written beside its place, then moved; never replaced."""
    place = Path(target)
    if place.exists():
        raise FileExistsError(target)
    part = place.with_name(f".{place.name}.{uuid.uuid4().hex}")
    try:
        write(str(part))
        if place.exists():
            raise FileExistsError(target)
        part.rename(place)
    finally:
        shutil.rmtree(part, ignore_errors=True)
