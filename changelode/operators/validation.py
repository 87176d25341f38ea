"""Checks of finished documents: closed keys, times, forbidden values, provenance, names.

Each check is a column that holds the first problem, or null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from changelode.functions.times import parse_time

# The closed keys of both documents, the shortest text that can be forbidden, and
# file names that belong to an evaluator.
METADATA_KEYS = ["schema_version", "repository", "title", "description", "cutoff_timestamp", "base_branch", "commit_messages"]
MANIFEST_KEYS = ["schema_version", "case_id", "repository", "cutoff_timestamp", "base_commit", "cutoff_commit", "snapshot_format"]
FORBIDDEN_LEAST = 7
EVALUATOR_NAMES = [
    "oracle.json", "oracle.yaml", "oracle.yml", "ground_truth.json", "groundtruth.json", "answer_key.json", "answerkey.json", "expected_findings.json", "expected-findings.json", "retrospective.json",
]
FULL_ID = r"^[0-9a-fA-F]{40}\z"


def _first(*problems: tuple[Column, str]) -> Column:
    return reduce(lambda out, p: out.when(F.coalesce(p[0], F.lit(True)), p[1]), problems, F)


def _text(doc: Column, key: str) -> Column:
    return F.coalesce(F.get_json_object(doc, f"$.{key}"), F.lit(""))


def _nested(doc: Column, key: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(doc), f"$.{key}", "variant"))
    return F.coalesce(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.lit(False))


def metadata_problem(doc: Column, cutoff: Column, schema: str, forbidden: Column) -> Column:
    """A reviewer document: known flat keys, pinned version, equal cut-off, no forbidden value in it."""
    keys = F.json_object_keys(doc)
    held = F.filter(forbidden, lambda v: (F.octet_length(v) >= FORBIDDEN_LEAST) & doc.contains(v))
    return _first(
        (F.try_parse_json(doc).isNull() | keys.isNull(), "not one object"),
        (F.exists(keys, lambda k: ~k.isin(METADATA_KEYS)), "unknown field"),
        (reduce(lambda a, b: a | b, [_nested(doc, k) for k in METADATA_KEYS if k != "commit_messages"]), "nested value"),
        (_text(doc, "schema_version") != schema, "schema version"),
        ((_text(doc, "repository") == "") | (_text(doc, "cutoff_timestamp") == ""), "required field"),
        (~parse_time(_text(doc, "cutoff_timestamp")).eqNullSafe(cutoff), "cut-off"),
        (F.coalesce(F.size(held), F.lit(0)) > 0, "forbidden value"),
    )


def manifest_problem(doc: Column, cutoff: Column, schema: str, snapshot_format: str) -> Column:
    """A control manifest: exactly known keys, pinned versions, full commit ids, equal cut-off."""
    keys = F.json_object_keys(doc)
    return _first(
        (F.try_parse_json(doc).isNull() | keys.isNull(), "not one object"),
        (F.exists(keys, lambda k: ~k.isin(MANIFEST_KEYS)), "unknown field"),
        (_text(doc, "schema_version") != schema, "schema version"),
        (_text(doc, "snapshot_format") != snapshot_format, "snapshot format"),
        ((_text(doc, "case_id") == "") | (_text(doc, "repository") == "") | (_text(doc, "cutoff_timestamp") == ""), "required field"),
        (~_text(doc, "base_commit").rlike(FULL_ID) | ~_text(doc, "cutoff_commit").rlike(FULL_ID), "commit id"),
        (~parse_time(_text(doc, "cutoff_timestamp")).eqNullSafe(cutoff), "cut-off"),
    )


def decision_problem(included: Column, source: Column, method: Column, valid_at: Column, cutoff: Column) -> Column:
    """An included field needs provenance and a validity time at or before the cut-off."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    at = parse_time(valid_at)
    problem = _first((blank(source) | blank(method) | blank(valid_at), "no provenance"), (at.isNull(), "validity time"), (at > cutoff, "later than the cut-off"))
    return F.when(F.coalesce(included, F.lit(False)), problem)


def identity_problem(bundle: dict[str, Column], record: dict[str, Column]) -> Column:
    """Whether a cached bundle and a record are of one request: number, repository, base and head."""
    return _first(*[(F.coalesce(bundle[k].cast("string"), F.lit("")).isin("") | ~bundle[k].eqNullSafe(record[k]), k) for k in ("number", "repository", "base_sha", "head_sha")])


def is_evaluator_name(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]*\z", 0)).isin(EVALUATOR_NAMES)
