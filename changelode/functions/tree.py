"""Entries of a source tree: safe paths, refused names, confined symbolic links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File modes, and names a consumer would take for repository data.
LINK = "120000"
MODES = ["100644", "100755", LINK]
REFUSED = [".git", ".gitmodules", "packed-refs", "HEAD", "ORIG_HEAD", "FETCH_HEAD", "MERGE_HEAD", "shallow", "objects", "refs", "reflogs", "worktrees", "alternates"]


def path_problem(path: Column) -> Column:
    """Why a path cannot be written below a folder, or null."""
    parts = F.split(path, "/")
    return (
        F.when(path.isNull() | (path == ""), "empty path")
        .when(path.startswith("/"), "absolute path")
        .when(F.exists(parts, lambda p: p.isin("", ".", "..")), "path is not literal")
        .when(F.exists(parts, lambda p: p.isin(REFUSED)), "name of repository data")
    )


def resolved(path: Column, target: Column) -> Column:
    """A link's target from the root of the tree, lexically; it begins with ``..`` if it escapes."""
    steps = F.concat(F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.lit(0), F.size(F.split(path, "/")) - 1)), F.split(target, "/"))
    empty = F.array().cast("array<string>")

    def step(acc: Column, s: Column) -> Column:
        up = (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
        return F.when(s.isin("", "."), acc).when((s == "..") & F.coalesce(up, F.lit(False)), F.slice(acc, F.lit(1), F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(F.concat(acc, F.array(s)))

    return F.array_join(F.aggregate(steps, empty, lambda acc, s: F.when(F.size(acc) == 0, F.when(s.isin("", "."), acc).otherwise(F.array(s))).otherwise(step(acc, s))), "/")


def problems(entries: DataFrame) -> DataFrame:
    """(commitish, path, problem) of entries that cannot be admitted; none means an admissible tree.

    ``entries``: commitish, path, mode, link_target. Links must stay inside the tree and lead to
    a file or directory of it that is no link itself.
    """
    own = entries.withColumn("problem", F.coalesce(path_problem(F.col("path")), F.when(~F.col("mode").isin(MODES), "mode"))).where("problem is not null").select("commitish", "path", "problem")
    links = entries.where(F.col("mode") == LINK).select("commitish", "path", F.coalesce("link_target", F.lit("")).alias("target")).withColumn("to", resolved(F.col("path"), F.col("target")))
    files = entries.select("commitish", F.col("path").alias("to"), (F.col("mode") == LINK).alias("is_link"))
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("parts") - 1)), lambda n: F.array_join(F.slice("parts", F.lit(1), n), "/"))
    folders = entries.select("commitish", F.split("path", "/").alias("parts")).where(F.size("parts") > 1).select("commitish", F.explode(above).alias("to")).distinct().withColumn("is_folder", F.lit(True))
    checked = links.join(files, ["commitish", "to"], "left").join(folders, ["commitish", "to"], "left")
    why = (
        F.when(F.col("target") == "", "empty target")
        .when(F.col("target").startswith("/"), "absolute target")
        .when((F.col("to") == "..") | F.col("to").startswith("../"), "target escapes")
        .when(F.col("is_link"), "target is a link")
        .when(F.col("is_link").isNull() & F.col("is_folder").isNull() & (F.col("to") != ""), "target is absent")
    )
    return own.unionByName(checked.withColumn("problem", why).where("problem is not null").select("commitish", "path", "problem"))
