"""What changed paths say: scope, subsystem, size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directory names and bands that results depend on.
TEST_PATHS = r"^(?:tests|topotests)/|/topotests/"
DOC_PATHS = r"^(?:doc|docs|man)/|\.(?:rst|md)$"
PACKAGE_PATHS = r"^(?:debian|redhat|docker|pkg)/|\.spec$"
CONTAINERS = ["internal", "src", "pkg", "cmd", "lib64", "source"]
ANCILLARY = ["tests", "test", "doc", "docs", "tools", ".github", "ci", ".ci", "m4"]
BANDS = [(0, "0"), (10, "1-10"), (50, "11-50"), (200, "51-200"), (1000, "201-1000")]
LAST_BAND = "1001+"


def path_class(path: Column) -> Column:
    p = F.lower(path)
    return F.when(p.rlike(TEST_PATHS), "test").when(p.rlike(DOC_PATHS), "docs").when(p.rlike(PACKAGE_PATHS), "packaging").otherwise("code")


def evidence_scope(paths: Column) -> Column:
    """code, test, docs, packaging, mixed, or unknown without paths; null paths don't count."""
    kinds = F.array_distinct(F.transform(F.filter(F.coalesce(paths, F.array().cast("array<string>")), lambda p: p.isNotNull()), path_class))
    return F.when(F.size(kinds) == 0, "unknown").when(F.size(kinds) > 1, "mixed").otherwise(F.element_at(kinds, 1))


def subsystem(path: Column) -> Column:
    """The first part of a path; a generic container directory is stepped through."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, r"/+", "/"), r"^(?:\./)+", ""), "/")
    top = F.element_at(parts, 1)
    inner = F.concat(top, F.lit("/"), F.try_element_at(parts, F.lit(2)))
    return F.when(top == "", "(root)").when((F.size(parts) > 2) & F.lower(top).isin(CONTAINERS), inner).otherwise(top)


def majority_group(paths: Column) -> Column:
    """The subsystem that most of an array's paths belong to, ties to the lesser name; ``(none)`` without paths."""
    groups = F.transform(F.filter(F.coalesce(paths, F.array().cast("array<string>")), lambda p: p.isNotNull()), subsystem)
    counted = F.transform(F.array_distinct(groups), lambda g: F.struct((-F.size(F.filter(groups, lambda x: x == g))).alias("less"), g.alias("name")))
    return F.coalesce(F.array_min(counted)["name"], F.lit("(none)"))


def is_ancillary(name: Column) -> Column:
    bare = ~name.contains("/") & (name.contains(".") | (F.lower(name) == "makefile"))
    return F.lower(name).isin(ANCILLARY) | bare


def size_band(lines: Column) -> Column:
    out = None
    for upper, band in BANDS:
        out = F.when(lines <= upper, band) if out is None else out.when(lines <= upper, band)
    return out.otherwise(LAST_BAND)


def changed_lines(files: Column) -> Column:
    """Additions and deletions over an array of files; null arrays, files and counts add nothing."""
    add = lambda acc, f: acc + F.coalesce(f["additions"], F.lit(0)) + F.coalesce(f["deletions"], F.lit(0))
    return F.aggregate(F.coalesce(F.filter(files, lambda f: f.isNotNull()), F.array()), F.lit(0).cast("bigint"), add)
