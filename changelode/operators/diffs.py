"""Diff texts: numstat lines, changed lines, C symbols, overlaps between two changes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words and macros that name no C function, words that begin no definition, and
# lines that say nothing.
NO_SYMBOL = [
    "if", "for", "while", "switch", "return", "sizeof", "typeof", "struct", "union", "enum", "typedef", "else", "do", "case", "default", "main",
    "DEFUN", "DEFUN_NOSH", "DEFUN_HIDDEN", "ALIAS", "INSTALL_ELEMENT", "DEFPY", "DEFINE_HOOK", "DECLARE_HOOK", "HOOK_REGISTER", "MEMTYPE_DECLARE",
]
NO_DEFINITION = ["return", "if", "for", "while", "switch", "case", "else", "goto", "break", "continue", "typedef"]
NOTHING = ["{", "}", "};", "()", "{}", "[]", "(", ")", ";", "else", "else {"]
SUBSTANTIVE_LEAST = 3


def numstat(text: Column) -> Column:
    """The files of a numstat text, by path: array of (path, status, additions, deletions).

    Fields are cut at tabs, or at white space; ``-`` (binary) counts nothing; lines whose counts
    are no whole numbers of zero or more are dropped.
    """
    lines = F.split(text, r"\r?\n")

    def parse(line: Column) -> Column:
        tabs = F.split(line, "\t", 3)
        parts = F.when(F.size(tabs) >= 3, tabs).otherwise(F.split(F.btrim(line, F.lit(" \t")), r"[ \t]+", 3))
        n = lambda i: F.when(F.btrim(F.get(parts, F.lit(i))) == "-", F.lit(0).cast("bigint")).otherwise(F.btrim(F.get(parts, F.lit(i))).try_cast("bigint"))
        added, gone, path = n(0), n(1), F.btrim(F.get(parts, F.lit(2)), F.lit(" \t"))
        ok = (F.size(parts) >= 3) & (added >= 0) & (gone >= 0) & (path != "")
        status = F.when((added > 0) & (gone == 0), "added").when((added == 0) & (gone > 0), "deleted").otherwise("modified")
        return F.when(ok, F.struct(path.alias("path"), status.alias("status"), added.alias("additions"), gone.alias("deletions")))

    return F.array_sort(F.filter(F.transform(lines, parse), lambda f: f.isNotNull()))


def substantive(line: Column) -> Column:
    """A changed line trimmed, or null if it says nothing: braces, ``else``, comments, under three bytes."""
    t = F.regexp_replace(line, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")
    nothing = t.isin(NOTHING) | t.startswith("//") | t.startswith("/*") | t.startswith("*") | (F.octet_length(t) < SUBSTANTIVE_LEAST)
    return F.when(~nothing, t)


_HUNK = re.compile(r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@ ?(.*)$")
_CALL = re.compile(r"([A-Za-z_]\w*)\s*\(")
_DEFINITION = re.compile(r"^(?:[A-Za-z_][\w\s*]*[\s*])?([A-Za-z_]\w*)\s*\([^;={}]*$|^(?:[A-Za-z_][\w\s*]*[\s*])?([A-Za-z_]\w*)\s*\([^;=]*\)\s*\{?\s*$")


def symbol(signature: str) -> str:
    """The function a signature names, or nothing: the identifier before the first bracket."""
    m = _CALL.search(re.sub(r"/\*.*?\*/|//.*", " ", signature))
    return m[1] if m and valid_symbol(m[1]) else ""


def defines(entries: list[tuple[str, str, int, int, str]], i: int) -> str:
    """The function that an added line begins to define, or nothing.

    No statement, assignment or control word, and an opening brace at its end or at the start
    of one of the next three lines before any statement.
    """
    line = entries[i][4].strip()
    if not line or ";" in line or "=" in line or line.startswith(("//", "/*", "*")) or re.match(rf"(?:{'|'.join(NO_DEFINITION)})(?:[ (]|$)", line) or not _DEFINITION.match(line):
        return ""
    name = symbol(line)
    if not name or line.endswith("{"):
        return name
    for kind, _, _, _, text in entries[i + 1 : i + 4]:
        if kind == "@" or (text := text.strip()).startswith("{"):
            return name if kind != "@" else ""
        if ";" in text:
            break
    return ""


def valid_symbol(name: str) -> bool:
    return len(name) >= 2 and name not in NO_SYMBOL


def walk(diff: str) -> Iterator[tuple[str, str, int, int, str]]:
    """(kind, path, old line, new line, text) of each entry of a unified diff; kinds are ``@``, ``-``, ``+``, `` ``.

    Removed lines carry the source path, all others the destination path.
    """
    old = new = ""
    a = b = 0
    inside = False
    for line in diff.split("\n"):
        line = line.removesuffix("\r")
        if line.startswith("diff --git "):
            old = new = ""
            inside = False
        elif not inside and line.startswith("--- "):
            old = re.sub(r"^a/", "", line[4:].split("\t")[0])
        elif not inside and line.startswith("+++ "):
            new = re.sub(r"^b/", "", line[4:].split("\t")[0])
        elif m := _HUNK.match(line):
            a, b, inside = int(m[1]), int(m[2]), True
            yield "@", new, a, b, m[3]
        elif inside and line[:1] == "-":
            yield "-", old if old != "/dev/null" else new, a, b, line[1:]
            a += 1
        elif inside and line[:1] == "+":
            yield "+", new if new != "/dev/null" else old, a, b, line[1:]
            b += 1
        elif inside and line[:1] in (" ", ""):
            yield " ", new, a, b, line[1:]
            a, b = a + 1, b + 1
        elif inside and not line.startswith("\\"):
            inside = False


def symbols(diff: str) -> list[tuple[str, str]]:
    """(path, function) that a diff touches in C files: functions of its hunks, and added definitions."""
    out: set[tuple[str, str]] = set()
    entries = list(walk(diff))
    for i, (kind, path, _, _, text) in enumerate(entries):
        if not path.endswith((".c", ".h")):
            continue
        if kind == "@" and (name := symbol(text)):
            out.add((path, name))
        elif kind == "+" and (name := defines(entries, i)):
            out.add((path, name))
    return sorted(out)


def diff_symbols(diffs: DataFrame, key: str = "sha", text: str = "raw_diff") -> DataFrame:
    """(key, path, function) of each diff; Arrow batches, as a diff must be read line by line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, *s) for k, t in zip(b[key], b[text]) if t for s in symbols(t)], columns=[key, "path", "function"])

    return diffs.select(key, text).mapInPandas(run, f"{key} {diffs.schema[key].dataType.simpleString()}, path string, function string")


def diff_lines(diffs: DataFrame, key: str = "sha", text: str = "raw_diff") -> DataFrame:
    """(key, kind, path, line, content): added and removed lines with their places."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, kind, path, old if kind == "-" else new, t) for k, x in zip(b[key], b[text]) if x for kind, path, old, new, t in walk(x) if kind in "+-"]
            yield pd.DataFrame(rows, columns=[key, "kind", "path", "line", "content"])

    return diffs.select(key, text).mapInPandas(run, f"{key} {diffs.schema[key].dataType.simpleString()}, kind string, path string, line bigint, content string")


def multiset_overlap(left: DataFrame, right: DataFrame, group: list[str], item: str) -> DataFrame:
    """(group, left_items, right_items, shared): the size of the multiset intersection per group.

    Both sides are counted by item first, so equal lines travel once however often they occur.
    """
    a = left.groupBy(*group, item).agg(F.count("*").alias("a"), F.lit(0).cast("bigint").alias("b"))
    b = right.groupBy(*group, item).agg(F.lit(0).cast("bigint").alias("a"), F.count("*").alias("b"))
    both = a.unionByName(b).groupBy(*group, item).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return both.groupBy(*group).agg(F.sum("a").alias("left_items"), F.sum("b").alias("right_items"), F.sum(F.least("a", "b")).alias("shared"))


def reversal_paths(original: DataFrame, later: DataFrame, supported: DataFrame, key: list[str]) -> DataFrame:
    """(key, path, added, removed, removed_again, added_again, supported): how far later changes take back original ones.

    ``original`` and ``later``: key, kind (``+``/``-``), path, content; ``supported``: key, path,
    content of removed lines that trace to the original. A later removal matches an original
    addition and the reverse; only lines that say something count.
    """
    lines = lambda x, kind: x.where(F.col("kind") == kind).withColumn("content", substantive(F.col("content"))).where("content is not null").select(*key, "path", "content")
    by = [*key, "path"]
    undone = multiset_overlap(lines(original, "+"), lines(later, "-"), by, "content").select(*by, F.col("left_items").alias("added"), F.col("shared").alias("removed_again"))
    redone = multiset_overlap(lines(original, "-"), lines(later, "+"), by, "content").select(*by, F.col("left_items").alias("removed"), F.col("shared").alias("added_again"))
    proof = multiset_overlap(lines(original, "+"), supported.withColumn("content", substantive(F.col("content"))).where("content is not null").select(*by, "content"), by, "content").select(*by, F.col("shared").alias("supported"))
    n = lambda c: F.coalesce(c, F.lit(0))
    paths = undone.join(redone, by, "full").join(proof, by, "left")
    return paths.select(*by, *[n(c).alias(c) for c in REVERSAL_COUNTS])


REVERSAL_COUNTS = ("added", "removed", "removed_again", "added_again", "supported")


def reversal(original: DataFrame, later: DataFrame, supported: DataFrame, key: list[str], patches: DataFrame | None = None) -> DataFrame:
    """(key, counts, fraction, reversal_type, path_overlaps) over the paths of :func:`reversal_paths`.

    A candidate needs two matches in one path or one that is supported. ``patches``: key,
    original_patch, reverse_patch (of the later change read backwards); equal ids that are not
    empty make the reversal ``full``, whatever the lines say.
    """
    n = lambda c: F.coalesce(c, F.lit(0))
    out = reversal_paths(original, later, supported, key).groupBy(*key).agg(
        *[F.sum(c).alias(c) for c in REVERSAL_COUNTS],
        F.max((F.col("removed_again") + F.col("added_again") >= 2) | (F.col("supported") > 0)).alias("candidate"),
        F.array_sort(F.collect_list(F.struct("path", *REVERSAL_COUNTS))).alias("path_overlaps"),
    )
    total = F.col("added") + F.col("removed")
    overlap = F.col("removed_again") + F.col("added_again")
    if patches is not None:
        whole = patches.where((F.col("original_patch") != "") & (F.col("original_patch") == F.col("reverse_patch"))).select(*key).distinct().withColumn("full", F.lit(True))
        out = out.join(whole, key, "full")
    else:
        out = out.withColumn("full", F.lit(False))
    kind = F.when(F.coalesce("full", F.lit(False)), "full").when(F.col("candidate"), "partial_candidate").otherwise("none")
    return out.select(*key, *[n(c).alias(c) for c in REVERSAL_COUNTS], F.coalesce(F.try_divide(overlap, total), F.lit(0.0)).alias("fraction"), kind.alias("reversal_type"), "path_overlaps")
