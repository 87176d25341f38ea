"""Tables, reports and checksums as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SNIPPET = 57  # bytes of a function list in a report before it is cut


def csv(df: DataFrame, path: str, order: Sequence[Column | str] = ()) -> None:
    """CSV with a header, in a total order over the part files."""
    (df.orderBy(*order) if order else df).write.mode("errorifexists").option("header", True).csv(path)


def candidate_columns() -> list[Column]:
    """The thirteen columns of the candidates table, formatted as text."""
    two = lambda c: F.format_string("%.2f", F.coalesce(F.col(c), F.lit(0.0)))
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return [
        F.col("original.number").alias("PR_Number"), F.col("original.title").alias("Title"), F.col("original.author").alias("Author"), F.date_format("original.merged_at", "yyyy-MM-dd").alias("Merged_At"),
        two("stateful.score").alias("Stateful_Score"), F.col("stateful.category").alias("Stateful_Category"),
        *[size(f"retrospective.{t}_signals").alias(f"{t.capitalize()}_Signals_Count") for t in ("strong", "medium", "weak")],
        two("retrospective.summary_rank_score").alias("Summary_Rank_Score"), size("original.changed_files").alias("Changed_Files_Count"),
        F.coalesce(F.array_join("original.changed_functions", "; "), F.lit("")).alias("Changed_Functions"), F.col("stateful.explanation").alias("Explanation"),
    ]


def evidence_lines(records: DataFrame) -> DataFrame:
    """(record_id, place, line): the evidence section of a report, one line a signal, for records that have any.

    Strong signals come first, then medium and weak ones, each in its stored order.
    """
    parts = []
    for turn, (tier, where, what) in enumerate((("strong", None, "raw_snippet"), ("medium", "function_or_path", "context"), ("weak", "file_path", "context"))):
        s = records.select("record_id", F.posexplode(f"retrospective.{tier}_signals").alias("at", "s")).where("s is not null")
        text = lambda f: F.coalesce(F.col(f"s.{f}").cast("string"), F.lit(""))
        place = F.concat(F.lit(" ("), text(where), F.lit(")")) if where else F.lit("")
        line = F.concat(F.lit(f"- {tier} "), text("signal_type"), F.lit(": "), text("source_ref"), F.lit(" on "), F.coalesce(F.date_format("s.timestamp", "yyyy-MM-dd"), F.lit("-")), place, F.lit(": "), text(what))
        parts.append(s.select("record_id", F.struct(F.lit(turn).alias("turn"), "at").alias("place"), line.alias("line")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def cut(text: Column, size: int = SNIPPET) -> Column:
    """A text of at most ``size`` bytes, then dots; whole characters only."""
    fits = F.filter(F.sequence(F.lit(0), F.lit(size)), lambda n: F.octet_length(F.substring(text, F.lit(1), n)) <= size)
    return F.when(F.octet_length(text) <= size, text).otherwise(F.concat(F.substring(text, F.lit(1), F.array_max(fits)), F.lit("...")))


def markdown_lines(df: DataFrame) -> DataFrame:
    """(line): one Markdown table row for each row; bars are escaped."""
    cells = [F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), r"\|", r"\\|") for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown(df: DataFrame, path: str) -> None:
    """A report of a small ordered table; rows stream to the driver one partition at a time."""
    with open(path, "x", encoding="utf-8") as f:
        f.write("| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns) + "\n")
        for row in markdown_lines(df).toLocalIterator():
            f.write(row["line"] + "\n")


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, sha256) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(F.col("path"), "length", F.sha2("content", 256).alias("sha256"))
