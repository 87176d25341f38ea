"""Problem 2: nested records into linked flat tables, by columnar shredding.

Every record is taken apart into one sequence per leaf path of (repetition level, definition
level, value). Repetition says which repeated ancestor the entry continues, definition how much
of its path is present. Tables of any repeated or optional ancestor come out of the level
sequences alone, with array arithmetic over a whole batch, never by walking objects again.

A node of the schema is ``("leaf", name, type)``, ``("group", name, children)`` or
``("list", name, children)``; a list of scalars has one unnamed leaf and gives a child table of its own. Levels per step: an
optional group or leaf adds one when present; a list adds one when it is a list, one for each
slot, and one when the slot holds an object.

Loose writing is read as follows: JSON text inside a string where an object or array belongs is
parsed; a lone object where an array belongs is its only element. Null elements keep their
slot, and so their position, but are no objects. Null, absent or ill-typed parts, and payloads
that are null or not valid JSON, give no rows. Repeated records give one set of rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Node = tuple


def leaf(name: str, kind: str = "string") -> Node:
    return ("leaf", name, kind)


def leaves(names: str, kind: str = "string") -> list[Node]:
    return [leaf(n, kind) for n in names.split()]


SIGNAL = [*leaves("signal_type source_type source_ref"), leaf("timestamp", "timestamp"), leaf("raw_snippet"), leaf("confidence", "double"), *leaves("evidence_scope logical_patch_id"), ("list", "changed_paths", [leaf("")])]
OVERLAP = [leaf("path"), *leaves("original_added_lines original_removed_lines later_removed_matching_original_additions later_added_matching_original_removals lineage_supported_removed_overlap_count", "bigint")]
REVERSAL = [
    leaf("full_reverse_patch_match", "boolean"), leaf("reversal_type"),
    *leaves("original_added_lines original_removed_lines total_original_substantive_lines later_removed_lines_matching_original_additions", "bigint"),
    *leaves("later_added_lines_matching_original_removals lineage_supported_removed_overlap_count reversed_line_overlap_count", "bigint"),
    leaf("reversed_line_overlap_fraction", "double"), leaf("method"), ("list", "path_overlaps", OVERLAP),
]
LINEAGE = [*leaves("later_removed_line_count analyzed_removed_line_count lines_blamed_to_original_pr", "bigint"), leaf("direct_lineage_fraction", "double"), leaf("method"), ("list", "matched_original_commit_shas", [leaf("")])]
RELATIONSHIP = [*leaves("source_ref analysis_status analysis_note"), ("group", "lineage", LINEAGE), ("group", "reversal", REVERSAL)]
EVIDENCE: list[Node] = [("list", "strong_signals", SIGNAL), ("list", "commit_relationships", RELATIONSHIP)]


def _loose(value: Any) -> Any:
    if isinstance(value, str):
        try:
            return _loose(json.loads(value, parse_constant=_refuse))
        except (ValueError, RecursionError):
            return None
    return value


def _refuse(name: str) -> Any:
    raise ValueError(name)


class Columns:
    """Level sequences of a batch: per leaf path the record, repetition, definition and value."""

    def __init__(self, schema: list[Node]) -> None:
        self.schema = schema
        self.rows: dict[str, list[tuple[int, int, int, Any]]] = {}
        self.steps: dict[str, list[tuple[str, int, int]]] = {}  # path -> (ancestor, its repetition level, definition when present)
        self.kinds: dict[str, str] = {}
        self._plan(schema, "", 0, 0, [])

    def _plan(self, nodes: list[Node], at: str, rep: int, level: int, above: list[tuple[str, int, int]]) -> None:
        for node in nodes:
            path = f"{at}.{node[1]}" if at and node[1] else at or node[1]
            if node[0] == "leaf":
                self.rows[path] = []
                self.steps[path] = above
                self.kinds[path] = node[2]
            elif node[0] == "group":
                self._plan(node[2], path, rep, level + 1, [*above, (path, rep, level + 1)])
            else:
                scalar = node[2][0][1] == ""
                self._plan(node[2], path + "[]", rep + 1, level + (2 if scalar else 3), [*above, (path + "[]", rep + 1, level + (2 if scalar else 3))])

    def add(self, record: int, value: Any) -> None:
        self._put(self.schema, "", value if isinstance(value, dict) else None, record, 0, 0, 0)

    def _put(self, nodes: list[Node], at: str, obj: dict | None, rec: int, rep: int, depth: int, level: int) -> None:
        for node in nodes:
            name = node[1]
            path = f"{at}.{name}" if at and name else at or name
            value = None if obj is None else obj.get(name)
            if node[0] == "leaf":
                self.rows[path].append((rec, rep, level + (value is not None), value))
            elif node[0] == "group":
                value = _loose(value)
                there = isinstance(value, dict)
                self._put(node[2], path, value if there else None, rec, rep, depth, level + there)
            else:
                self._list(node, path + "[]", value, rec, rep, depth, level)

    def _list(self, node: Node, path: str, value: Any, rec: int, rep: int, depth: int, level: int) -> None:
        scalar = node[2][0][1] == ""
        if not scalar or (isinstance(value, str) and value.lstrip()[:1] == "["):
            value = _loose(value)
        if value is not None and not isinstance(value, list):
            value = [value] if scalar or isinstance(value, dict) else None
        if not value:
            self._put(node[2], path, None, rec, rep, depth + 1, level + (value is not None)) if not scalar else self.rows[path].append((rec, rep, level + (value is not None), None))
            return
        for i, item in enumerate(value):
            r = rep if i == 0 else depth + 1
            if scalar:
                self.rows[path].append((rec, r, level + 2 + (item is not None), item))
            else:
                there = isinstance(item := _loose(item) if isinstance(item, str) else item, dict)
                self._put(node[2], path, item if there else None, rec, r, depth + 1, level + 2 + there)

    def arrays(self, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[Any]]:
        rows = self.rows[path]
        if not rows:
            return (np.zeros(0, np.int64),) * 3 + ([],)
        rec, rep, level, values = zip(*rows)
        return np.array(rec), np.array(rep), np.array(level), list(values)


def positions(cols: Columns, ancestor: str) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """Records, position per repeated step, and entry numbers of all objects at ``ancestor``.

    An object begins where an entry's repetition level is at most the ancestor's and its
    definition level reaches it. The position within an array counts slots: entries that
    continue this array's level, restarted whenever an outer level restarts.
    """
    path = next(p for p, steps in cols.steps.items() if any(s[0] == ancestor for s in steps) and p.rpartition(".")[0] in (ancestor, p) or p == ancestor)
    rec, rep, level, _ = cols.arrays(path)
    steps = cols.steps[path]
    rep_a, level_a = next((s[1], s[2]) for s in steps if s[0] == ancestor)
    here = np.arange(len(rec))
    pos: dict[str, np.ndarray] = {}
    for name, r, _ in steps:
        if name.endswith("[]"):
            slot = np.cumsum(rep <= r)
            start = np.maximum.accumulate(np.where(rep < r, here, 0)) if len(rec) else here
            pos[name] = slot - slot[start] + 1 if len(rec) else here
        if name == ancestor:
            break
    begins = (rep <= rep_a) & (level >= level_a)
    return rec[begins], {k: v[begins] for k, v in pos.items()}, np.flatnonzero(begins)


#: level name -> (ancestor path, steps that give parent_pos and pos)
LEVELS = {
    "strong_signal": ("strong_signals[]", None, "strong_signals[]"),
    "commit_relationship": ("commit_relationships[]", None, "commit_relationships[]"),
    "reversal": ("commit_relationships[].reversal", "commit_relationships[]", None),
    "path_overlap": ("commit_relationships[].reversal.path_overlaps[]", "commit_relationships[]", "commit_relationships[].reversal.path_overlaps[]"),
}


def level_rows(cols: Columns, level: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ancestor, parent, own = LEVELS[level]
    rec, pos, entry = positions(cols, ancestor)
    n = len(rec)
    return rec, pos[parent] if parent else np.zeros(n, int), pos[own] if own else np.ones(n, int), entry


def shredded(payloads: pd.Series) -> Columns:
    cols = Columns(EVIDENCE)
    for i, text in enumerate(payloads):
        top = _loose(text) if text else None
        cols.add(i, _loose(top.get("retrospective")) if isinstance(top, dict) else None)
    return cols


def evidence(pr_record: DataFrame, evidence_raw: DataFrame) -> DataFrame:
    """Both carriers of evidence as (record_id, payload); typed records are written as JSON.

    Second deliveries stay here; they give equal rows, which the flat tables drop by their keys.
    """
    whole = F.struct(F.struct("retrospective.strong_signals", "retrospective.commit_relationships").alias("retrospective"))
    typed = pr_record.where(F.col("retrospective").isNotNull()).select("record_id", F.to_json(whole, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("payload"))
    return typed.unionByName(evidence_raw.select("record_id", "payload")).where(F.col("payload").isNotNull())


def flat_positions(records: DataFrame) -> DataFrame:
    """(record_id, level, parent_pos, pos) of every object at the four levels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cols = shredded(b["payload"])
            ids = b["record_id"].to_numpy()
            for level in LEVELS:
                rec, parent, pos, _ = level_rows(cols, level)
                yield pd.DataFrame({"record_id": ids[rec] if len(rec) else ids[:0], "level": level, "parent_pos": parent.astype("int32"), "pos": pos.astype("int32")})

    out = records.where(F.col("record_id").isNotNull()).mapInPandas(run, "record_id bigint, level string, parent_pos int, pos int")
    return out.distinct()


def columns(level: str) -> dict[str, str]:
    """Column name -> leaf path of a level's table.

    Groups below the ancestor that are no level themselves give columns with their name before;
    lists of scalars have tables of their own (:func:`scalar_table`).
    """
    ancestor = LEVELS[level][0] + "."
    inner = tuple(a + "." for a, _, _ in LEVELS.values() if a.startswith(ancestor))
    return {p[len(ancestor) :].replace(".", "_"): p for p in Columns(EVIDENCE).rows if p.startswith(ancestor) and not p.startswith(inner) and not p.endswith("[]")}


def flat_table(records: DataFrame, level: str) -> DataFrame:
    """The flat table of one level: keys, positions and every scalar, each in the type of its leaf.

    A column is read from its own level sequence: entries of a leaf below the ancestor, outside
    of lists, correspond one to one to the ancestor's objects. A value that is not of its leaf's
    type, nor text that reads as such, is null.
    """
    names = columns(level)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cols = shredded(b["payload"])
            ids = b["record_id"].to_numpy()
            rec, parent, pos, entry = level_rows(cols, level)
            out = {"record_id": ids[rec] if len(rec) else ids[:0], "parent_pos": parent.astype("int32"), "pos": pos.astype("int32")}
            for name, path in names.items():
                values = cols.arrays(path)[3]
                out[name] = pd.Series([_text(values[e]) for e in entry], dtype=object)
            yield pd.DataFrame(out)

    kinds = Columns(EVIDENCE).kinds
    ddl = "record_id bigint, parent_pos int, pos int, " + ", ".join(f"`{n}` string" for n in names)
    flat = records.where(F.col("record_id").isNotNull()).mapInPandas(run, ddl).dropDuplicates(["record_id", "parent_pos", "pos"])
    return flat.select("record_id", "parent_pos", "pos", *[F.col(n).try_cast(kinds[p]).alias(n) for n, p in names.items()])


#: list of scalars -> (its leaf path, the step that gives parent_pos)
SCALARS = {
    "changed_path": ("strong_signals[].changed_paths[]", "strong_signals[]"),
    "matched_original_commit_sha": ("commit_relationships[].lineage.matched_original_commit_shas[]", "commit_relationships[]"),
}


def scalar_table(records: DataFrame, name: str) -> DataFrame:
    """The child table of a list of scalars: (record_id, parent_pos, pos, value), one row a slot.

    Rows come from the list's own level sequence: an entry is a slot if its definition level
    reaches the list's, and its place restarts with every object that holds a list. A null
    element keeps its row; a lone scalar is the only element of its list.
    """
    path, holder = SCALARS[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cols = shredded(b["payload"])
            ids = b["record_id"].to_numpy()
            rec, pos, entry = positions(cols, path)
            values = cols.arrays(path)[3]
            yield pd.DataFrame(
                {"record_id": ids[rec] if len(rec) else ids[:0], "parent_pos": pos[holder].astype("int32"), "pos": pos[path].astype("int32"), name: pd.Series([_text(values[e]) for e in entry], dtype=object)}
            )

    out = records.where(F.col("record_id").isNotNull()).mapInPandas(run, f"record_id bigint, parent_pos int, pos int, {name} string")
    return out.dropDuplicates(["record_id", "parent_pos", "pos"])


def _text(value: Any) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, separators=(",", ":"))
