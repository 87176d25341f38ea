"""References in commit messages, as column expressions.

Patterns are written so that Java and RE2 read them alike: white space is spelled out, and
``.`` is ``[^\\n]``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reference patterns, vocabulary and minimum length that results depend on.
FIXES_SHA = r"""(?i)(?:fixes|fixed-by|fixes[ \t\n\f\r]+commit|fixed[ \t\n\f\r]+by|fixes[ \t\n\f\r]+in):[ \t\n\f\r]*["']?([0-9a-f]{6,40})["']?"""
FIXES_PR = r"(?i)(?:fixes|fixed-by|closes|resolves|reverts)[ \t\n\f\r]*[:]?[ \t\n\f\r]*#([0-9]+)\b"
REVERT_COMMIT = r"""(?i)(?:this[ \t\n\f\r]+reverts[ \t\n\f\r]+commit|revert[ \t\n\f\r]+commit|reverts[ \t\n\f\r]+commit|reverted[ \t\n\f\r]+commit)[ \t\n\f\r]+["']?([0-9a-f]{6,40})["']?"""
REVERT_SUBJECT = r'(?i)Revert[ \t\n\f\r]+"([^\n]*)"'
REGRESSION = (
    r"(?i)(?:regression(?:[ \t\n\f\r]+(?:introduced[ \t\n\f\r]+in|caused[ \t\n\f\r]+by|in))?|broken[ \t\n\f\r]+by|introduced[ \t\n\f\r]+in|introduced[ \t\n\f\r]+by"
    r"|caused[ \t\n\f\r]+by|fault[ \t\n\f\r]+in|broke[ \t\n\f\r]+in)[ \t\n\f\r]+(?:commit[ \t\n\f\r]+([0-9a-f]{6,40})|#([0-9]+)|([0-9a-f]{6,40}))"
)
FIX_WORDS = r"(?i)\b(fix|fixes|fixed|crash|leak|race|panic|null|segfault|deadlock|regression|memory corruption|use-after-free)\b"
CITATION = r"fix|revert|regression|broken|caused|close|resolve"
MERGE_SUBJECT = r"^Merge pull request #([0-9]+)"
CVE = r"(?i)\bCVE-[0-9]{4}-[0-9]{4,7}\b"
NUMBER_REF = r"(?:^|[^0-9A-Za-z_/])#([0-9]+)\b"
SHA_LEAST = 6


_EDGE = "(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"


def java(pattern: str) -> str:
    """A pattern with word edges as RE2 has them: only ASCII letters make words."""
    return pattern.replace(r"\b", _EDGE)


def has_citation(message: Column) -> Column:
    """Whether a message can cite anything: a cheap test before the costly patterns."""
    return F.lower(message).rlike(CITATION)


def has_fix_words(subject: Column) -> Column:
    return subject.rlike(java(FIX_WORDS))


def found(message: Column, pattern: str, group: int = 1) -> Column:
    """All hits of a pattern in text order: array of (value, snippet)."""
    values = F.regexp_extract_all(message, F.lit(java(pattern)), F.lit(group))
    return F.zip_with(values, F.regexp_extract_all(message, F.lit(java(pattern)), F.lit(0)), lambda v, s: F.struct(v.alias("value"), s.alias("snippet")))


def regressions(message: Column) -> Column:
    """All regression mentions: array of (sha, number, snippet); absent groups are empty."""
    group = lambda k: F.regexp_extract_all(message, F.lit(REGRESSION), F.lit(k))
    sha = F.zip_with(group(1), group(3), lambda a, b: F.when(a != "", a).otherwise(b))
    return F.transform(F.arrays_zip(sha.alias("sha"), group(2).alias("number"), group(0).alias("snippet")), lambda x: F.struct(x["sha"].alias("sha"), x["number"].alias("number"), x["snippet"].alias("snippet")))


def untargeted(message: Column) -> tuple[Column, Column, Column]:
    """(shas, numbers, matched) of every strong reference, distinct and in pattern order."""
    all_of = lambda p, k: F.regexp_extract_all(message, F.lit(java(p)), F.lit(k))
    sha = F.transform(regressions(message), lambda r: r["sha"])
    number = F.transform(regressions(message), lambda r: r["number"])
    shas = F.concat(all_of(FIXES_SHA, 1), all_of(REVERT_COMMIT, 1), sha)
    numbers = F.transform(F.filter(F.concat(all_of(FIXES_PR, 1), number), lambda n: n != ""), lambda n: n.try_cast("bigint"))
    matched = message.rlike(FIXES_SHA) | message.rlike(java(FIXES_PR)) | message.rlike(REVERT_COMMIT) | message.rlike(REVERT_SUBJECT) | message.rlike(REGRESSION)
    return (
        F.array_distinct(F.filter(F.transform(shas, F.lower), lambda s: s != "")),
        F.array_distinct(F.filter(numbers, lambda n: n > 0)),
        matched,
    )


def digit_prefixes(subject: Column) -> Column:
    """Every non-empty beginning of each ``#digits`` run: containment of ``#N`` as an equi-join key."""
    runs = F.regexp_extract_all(subject, F.lit("#([0-9]+)"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r)), lambda n: F.substring(r, F.lit(1), n)))))
