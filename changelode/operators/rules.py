"""Configurable path and keyword rules, compiled to column expressions.

A rule set is data; it turns into generated columns that stay inside code generation, with no
Python per row. Weights are added in rule order, so scores are equal bit for bit whatever the
partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Score limits and the sentence for records that match nothing.
CAP, HIGH, MEDIUM = 1.0, 0.60, 0.30
NO_MATCH = "No stateful or distributed rules matched"


@dataclass(frozen=True)
class PathRule:
    name: str
    pattern: str
    weight: float


@dataclass(frozen=True)
class KeywordRule:
    name: str
    pattern: str
    weight: float
    fields: Sequence[str] = field(default_factory=tuple)


@dataclass(frozen=True)
class RuleSet:
    paths: Sequence[PathRule]
    keywords: Sequence[KeywordRule]
    cap: float = CAP
    high: float = HIGH
    medium: float = MEDIUM


#: Rules for the test data's own directory and symbol names.
SAMPLE = RuleSet(
    paths=(PathRule("daemon", r"^(ospreyd|beacond|tidald)/", 0.35), PathRule("library", r"^lib/", 0.25), PathRule("headers", r"\.h$", 0.1)),
    keywords=(
        KeywordRule("session", r"(?i)(?:^|[^a-zA-Z0-9])(session|peer|neighbor)(?:$|[^a-zA-Z0-9])", 0.3, ("diff_symbols", "commit_messages", "pr_title")),
        KeywordRule("timer", r"(?i)(?:^|[^a-zA-Z0-9])(timer|queue|keepalive)(?:$|[^a-zA-Z0-9])", 0.2, ("diff_symbols", "pr_body")),
        KeywordRule("restart", r"(?i)graceful restart|config reload", 0.15, ("pr_title", "pr_body")),
    ),
)


def _texts(name: str) -> tuple[str, Column] | None:
    """A field's label and its texts; unknown field names are ignored."""
    one = lambda c: F.array(F.col(c))
    many = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    return {
        "pr_title": ("title", one("title")), "pr_body": ("body", one("body")),
        "diff_symbols": ("symbol", many("changed_functions")), "commit_messages": ("commit_msg", many("commit_messages")),
    }.get(name)


def _hit(label: str, rule: PathRule | KeywordRule, matched: Column) -> Column:
    return F.when(matched.isNotNull(), F.struct(F.lit(rule.name).alias("rule_name"), F.lit(label).alias("location"), matched.alias("matched"), F.lit(rule.weight).alias("weight")))


def path_hit(rule: PathRule) -> Column:
    """The first file that matches, once a rule."""
    paths = F.transform(F.coalesce(F.col("changed_files"), F.array()), lambda f: f["path"])
    return _hit("path", rule, F.try_element_at(F.filter(paths, lambda p: p.rlike(rule.pattern)), F.lit(1)))


def keyword_hit(rule: KeywordRule) -> Column:
    """The first field of the rule's list with a match; symbols give themselves, texts the match."""
    hits = []
    for name in rule.fields:
        if (found := _texts(name)) is not None:
            label, texts = found
            first = F.try_element_at(F.filter(texts, lambda t: t.rlike(rule.pattern)), F.lit(1))
            hits.append(_hit(label, rule, first if label == "symbol" else F.when(first.isNotNull(), F.regexp_extract(first, rule.pattern, 0))))
    return F.coalesce(*hits) if hits else F.lit(None)


def evaluate(prs: DataFrame, rules: RuleSet) -> DataFrame:
    """``prs`` with hits, raw_points, score, category and explanation."""
    hits = F.array_compact(F.array(*[path_hit(r) for r in rules.paths], *[keyword_hit(r) for r in rules.keywords]))
    out = prs.withColumn("hits", hits)
    points = F.aggregate("hits", F.lit(0.0), lambda acc, h: acc + h["weight"])
    lines = F.transform("hits", lambda h: F.concat(h["location"], F.lit(":"), h["rule_name"], F.lit(" (+"), F.format_string("%.2f", h["weight"]), F.lit(")")))
    out = out.withColumn("raw_points", points).withColumn("score", F.least(F.lit(rules.cap), F.col("raw_points")))
    category = F.when(F.col("score") >= rules.high, "HIGH").when(F.col("score") >= rules.medium, "MEDIUM").otherwise("LOW")
    return out.withColumn("category", category).withColumn("explanation", F.when(F.size("hits") == 0, NO_MATCH).otherwise(F.array_join(lines, ", ")))


def matched_symbols(rules: RuleSet) -> Column:
    """All symbols that match a keyword rule whose symbol field is reached, sorted."""
    sets = []
    for rule in rules.keywords:
        before: list[Column] = []
        for name in rule.fields:
            if (found := _texts(name)) is None:
                continue
            label, texts = found
            if label == "symbol":
                free = reduce(lambda a, b: a & b, [~x for x in before], F.lit(True))
                sets.append(F.when(free, F.filter(texts, lambda t: t.rlike(rule.pattern))).otherwise(F.array().cast("array<string>")))
            before.append(F.coalesce(F.exists(texts, lambda t: t.rlike(rule.pattern)), F.lit(False)))
    return F.array_sort(F.array_distinct(F.flatten(F.array(*sets)))) if sets else F.array().cast("array<string>")
