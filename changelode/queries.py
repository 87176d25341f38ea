"""The registered queries of the core: problems 2 to 4 and the reference's operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelode.operators import asof, drift, shred
from changelode.plans import catalog
from changelode.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return shred.evidence(table(spark, d, "pr_record"), table(spark, d, "evidence_raw"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every object at the four levels of evidence, with its links."""
    return shred.flat_positions(_evidence(spark, d))


def p2_strong_signals(spark: SparkSession, d: str) -> DataFrame:
    return shred.flat_table(_evidence(spark, d), "strong_signal")


def p2_commit_relationships(spark: SparkSession, d: str) -> DataFrame:
    return shred.flat_table(_evidence(spark, d), "commit_relationship")


def p2_reversals(spark: SparkSession, d: str) -> DataFrame:
    return shred.flat_table(_evidence(spark, d), "reversal")


def p2_path_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return shred.flat_table(_evidence(spark, d), "path_overlap")


def p2_changed_paths(spark: SparkSession, d: str) -> DataFrame:
    return shred.scalar_table(_evidence(spark, d), "changed_path")


def p2_matched_commits(spark: SparkSession, d: str) -> DataFrame:
    return shred.scalar_table(_evidence(spark, d), "matched_original_commit_sha")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Versions in force at the cut-offs, leaked descriptions, leaked decisions."""
    return asof.known_at_cutoff(table(spark, d, "body_edits"), table(spark, d, "review_metadata"), table(spark, d, "field_decisions"))


def p3_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """Each case's description as it was known at its cut-off."""
    return asof.described_as_known(table(spark, d, "body_edits"), table(spark, d, "review_metadata"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every change of shape between consecutive files."""
    return drift.drift(table(spark, d, "bundle_raw"))


def p4_table(spark: SparkSession, d: str) -> DataFrame:
    """All readable bundles in one consistent table: a row a line, a column a field, renames undone."""
    return drift.canonical(table(spark, d, "bundle_raw"))


def p4_branches(spark: SparkSession, d: str) -> DataFrame:
    """The typed branches and the canonical value of every path of every line."""
    return drift.branches(table(spark, d, "bundle_raw"))


def p4_lines(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of the table each file has: one for each of its readable lines."""
    return drift.canonical(table(spark, d, "bundle_raw")).groupBy("stream", "file_name").agg(F.count("*").alias("lines"))


def problem_queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p2_found, p2_strong_signals, p2_commit_relationships, p2_reversals, p2_path_overlaps, p2_changed_paths, p2_matched_commits, p3_found, p3_descriptions, p4_found, p4_table, p4_branches, p4_lines)}


#: Fixed spellings of times as DuckDB reads them.
_TIME = r"try_cast(regexp_replace(regexp_replace(replace({0}, ' ', 'T'), '(\.\d{{6}})\d+', '\1'), '([+-]\d{{2}})(\d{{2}})$', '\1:\2') AS TIMESTAMPTZ)"
_SQUEEZED = r"regexp_replace({0}, '[\s\p{{Z}}]+', '', 'g')"

P3_CASES = f"""
e AS (SELECT DISTINCT repository, pr, edit_id, edited_at, created_at, deleted_at, {_SQUEEZED.format("diff")} AS txt FROM body_edits WHERE edited_at IS NOT NULL AND edit_id IS NOT NULL),
c0 AS (SELECT DISTINCT case_id, repository, pr, {_SQUEEZED.format("description")} AS txt, {_TIME.format("cutoff_timestamp")} AS cutoff FROM review_metadata),
c AS (SELECT * FROM c0 WHERE cutoff IS NOT NULL AND case_id IS NOT NULL),
v AS (SELECT c.case_id, arg_max(e.edit_id, row(e.edited_at, e.edit_id)) AS ref_id, arg_max(coalesce(e.txt, chr(1)), row(e.edited_at, e.edit_id)) AS held
  FROM c JOIN e ON c.repository = e.repository AND c.pr = e.pr
  WHERE e.edited_at <= cutoff AND e.created_at <= cutoff AND (e.deleted_at IS NULL OR e.deleted_at > cutoff) GROUP BY c.case_id)
"""

P3_FOUND = f"""
WITH {P3_CASES}
SELECT case_id, 'version' AS kind, ref_id FROM v
UNION ALL
SELECT c.case_id, 'description_leak' AS kind, min(e.edit_id) AS ref_id
FROM c JOIN e ON c.repository = e.repository AND c.pr = e.pr AND c.txt = e.txt LEFT JOIN v ON v.case_id = c.case_id
WHERE (v.held IS NULL OR v.held <> c.txt) AND (e.edited_at > cutoff OR e.created_at > cutoff) GROUP BY c.case_id
UNION ALL
SELECT DISTINCT d.case_id, 'decision_leak' AS kind, d.decision_id AS ref_id
FROM (SELECT DISTINCT case_id, cutoff FROM c) c JOIN field_decisions d ON c.case_id = d.case_id WHERE d.included AND {_TIME.format("d.valid_at")} > cutoff
"""

P3_DESCRIPTIONS = f"""
WITH {P3_CASES}
SELECT c.case_id, v.ref_id AS edit_id, t.diff AS text FROM (SELECT DISTINCT case_id FROM c) c LEFT JOIN v ON v.case_id = c.case_id
LEFT JOIN (SELECT edit_id, any_value(diff) AS diff FROM body_edits GROUP BY edit_id) t ON t.edit_id = v.ref_id
"""


def _loose(x: str) -> str:
    return f"CASE WHEN json_type({x}) = 'VARCHAR' THEN (CASE WHEN json_valid({x} ->> '$') THEN ({x} ->> '$')::JSON END) ELSE {x} END"


def _items(x: str) -> str:
    return f"CASE json_type({x}) WHEN 'ARRAY' THEN json_extract({x}, '$[*]') WHEN 'OBJECT' THEN [{x}] ELSE [] END"


def _level(name: str, source: str, array: str) -> str:
    """Each slot of an array with its place; objects given as text are read."""
    return f"""{name}_ AS (SELECT *, {_loose(array)} AS arr FROM {source}), {name} AS (SELECT * EXCLUDE (arr, list, x), {_loose("x")} AS o FROM (SELECT *, unnest(list) AS x, generate_subscripts(list, 1) AS i FROM (SELECT *, {_items("arr")} AS list FROM {name}_)))"""


P2_LEVELS = f"""
WITH ev0 AS (SELECT record_id, to_json(retrospective) AS r FROM pr_record WHERE retrospective IS NOT NULL
 UNION ALL SELECT record_id, json_extract(payload::JSON, '$.retrospective') FROM (SELECT * FROM evidence_raw WHERE payload IS NOT NULL AND json_valid(payload))),
ev AS (SELECT DISTINCT record_id, r::VARCHAR AS t FROM ev0 WHERE record_id IS NOT NULL), top AS (SELECT record_id, {_loose("t::JSON")} AS r FROM ev),
{_level("st", "(SELECT record_id, 0 AS parent_pos, r FROM top)", "json_extract(r, '$.strong_signals')")},
{_level("cr", "(SELECT record_id, 0 AS parent_pos, r FROM top)", "json_extract(r, '$.commit_relationships')")},
rv AS (SELECT record_id, i AS parent_pos, 1 AS i, {_loose("json_extract(o, '$.reversal')")} AS o FROM cr WHERE json_type(o) = 'OBJECT'),
{_level("po", "(SELECT record_id, parent_pos, o AS r FROM rv WHERE json_type(o) = 'OBJECT')", "json_extract(r, '$.path_overlaps')")}
"""
P2_FOUND = f"""{P2_LEVELS}
SELECT DISTINCT record_id, level, parent_pos::INTEGER AS parent_pos, pos::INTEGER AS pos FROM (
 SELECT record_id, 'strong_signal' AS level, parent_pos, i AS pos, o FROM st UNION ALL SELECT record_id, 'commit_relationship', parent_pos, i, o FROM cr
 UNION ALL SELECT record_id, 'reversal', parent_pos, i, o FROM rv UNION ALL SELECT record_id, 'path_overlap', parent_pos, i, o FROM po) WHERE json_type(o) = 'OBJECT'
"""


def _flat(step: str, text: str, numbers: str = "", inner: str = "", **others: str) -> str:
    """The table of one level, written out of the JSON objects: columns by their type."""
    cols = [(n, "o", n, "VARCHAR") for n in text.split()] + [(n, "o", n, "BIGINT") for n in numbers.split()] + [(n, "o", n, t) for n, t in others.items()]
    if inner:
        cols += [(f"{inner}_{n}", inner, n, t) for n, t in INNER[inner].items()]
    picks = ", ".join(f"try_cast(json_extract_string({o}, '$.{key}') AS {t}) AS \"{name}\"" for name, o, key, t in cols)
    source = f"(SELECT *, {_loose(f"json_extract(o, '$.{inner}')")} AS {inner} FROM {step} WHERE json_type(o) = 'OBJECT')" if inner else f"(SELECT * FROM {step} WHERE json_type(o) = 'OBJECT')"
    return f"{P2_LEVELS} SELECT DISTINCT record_id, parent_pos::INTEGER AS parent_pos, i::INTEGER AS pos, {picks} FROM {source}"


INNER = {"lineage": {"later_removed_line_count": "BIGINT", "analyzed_removed_line_count": "BIGINT", "lines_blamed_to_original_pr": "BIGINT", "direct_lineage_fraction": "DOUBLE", "method": "VARCHAR"}}


def _scalars(step: str, holder: str, key: str, name: str) -> str:
    """One row a slot of a list of scalars inside the objects of a level."""
    arr = f"(SELECT *, json_extract({holder}, '$.{key}') AS a FROM (SELECT *, {_loose("json_extract(o, '$.lineage')")} AS lineage FROM {step} WHERE json_type(o) = 'OBJECT'))"
    read = "CASE WHEN json_type(a) = 'VARCHAR' AND starts_with(ltrim(a ->> '$'), '[') AND json_valid(a ->> '$') THEN (a ->> '$')::JSON ELSE a END"
    listed = f"(SELECT *, CASE json_type(b) WHEN 'ARRAY' THEN json_extract(b, '$[*]') WHEN 'NULL' THEN [] ELSE [b] END AS list FROM (SELECT *, {read} AS b FROM {arr}) WHERE b IS NOT NULL)"
    return f"{P2_LEVELS} SELECT DISTINCT record_id, holder::INTEGER AS parent_pos, k::INTEGER AS pos, x ->> '$' AS {name} FROM (SELECT record_id, i AS holder, unnest(list) AS x, generate_subscripts(list, 1) AS k FROM {listed})"


P2 = {
    "p2_found": P2_FOUND,
    "p2_strong_signals": _flat("st", "signal_type source_type source_ref raw_snippet evidence_scope logical_patch_id", timestamp="TIMESTAMPTZ", confidence="DOUBLE"),
    "p2_commit_relationships": _flat("cr", "source_ref analysis_status analysis_note", inner="lineage"),
    "p2_reversals": _flat(
        "rv",
        "reversal_type method",
        "original_added_lines original_removed_lines total_original_substantive_lines later_removed_lines_matching_original_additions later_added_lines_matching_original_removals"
        " lineage_supported_removed_overlap_count reversed_line_overlap_count",
        full_reverse_patch_match="BOOLEAN",
        reversed_line_overlap_fraction="DOUBLE",
    ),
    "p2_path_overlaps": _flat("po", "path", "original_added_lines original_removed_lines later_removed_matching_original_additions later_added_matching_original_removals lineage_supported_removed_overlap_count"),
    "p2_changed_paths": _scalars("st", "o", "changed_paths", "changed_path"),
    "p2_matched_commits": _scalars("cr", "lineage", "matched_original_commit_shas", "matched_original_commit_sha"),
}


def queries() -> dict[str, Query]:
    return problem_queries() | catalog.QUERIES


def oracle_sql() -> dict[str, str]:
    lines = "SELECT stream, file_name, count(DISTINCT line_no) AS lines FROM (SELECT * FROM bundle_raw WHERE json_valid(raw)) WHERE json_type(raw::JSON) = 'OBJECT' GROUP BY ALL"
    return P2 | {"p4_lines": lines, "p3_found": P3_FOUND, "p3_descriptions": P3_DESCRIPTIONS} | catalog.SQL
