import json
import random

import pandas as pd

from changelode.operators import shred

PAYLOADS = [
    None,
    "",
    "not json",
    '{"retrospective": null}',
    "[1, 2]",
    '{"retrospective": {"strong_signals": {"signal_type": "A"}}}',
    '{"retrospective": {"strong_signals": [null, {"signal_type": "B", "changed_paths": ["x", null]}, 7, {}]}}',
    json.dumps({"retrospective": {"commit_relationships": json.dumps([{"reversal": json.dumps({"path_overlaps": [None, {"path": "p"}, {}]})}, None, {"reversal": None}])}}),
    '{"retrospective": {"commit_relationships": {"source_ref": "s", "reversal": {"path_overlaps": {"path": "q"}}}}}',
    '{"retrospective": {"strong_signals": "[]", "commit_relationships": "oops"}}',
    '{"retrospective": {"strong_signals": [{"confidence": NaN}]}}',
]


def brute(text):
    def loose(v):
        if isinstance(v, str):
            try:
                return json.loads(v, parse_constant=lambda _: 1 / 0)
            except (ValueError, ZeroDivisionError):
                return None
        return v

    def items(v):
        v = loose(v)
        return [v] if isinstance(v, dict) else v if isinstance(v, list) else []

    out = set()
    top = loose(text) if text else None
    r = loose(top.get("retrospective")) if isinstance(top, dict) else None
    if not isinstance(r, dict):
        return out
    out |= {("strong_signal", 0, i) for i, x in enumerate(items(r.get("strong_signals")), 1) if isinstance(x, dict)}
    for i, x in enumerate(items(r.get("commit_relationships")), 1):
        if isinstance(x, dict):
            out.add(("commit_relationship", 0, i))
            v = loose(x.get("reversal"))
            if isinstance(v, dict):
                out.add(("reversal", i, 1))
                out |= {("path_overlap", i, k) for k, y in enumerate(items(v.get("path_overlaps")), 1) if isinstance(y, dict)}
    return out


def positions(payloads):
    cols = shred.shredded(pd.Series(payloads, dtype=object))
    got = [set() for _ in payloads]
    for level in shred.LEVELS:
        rec, parent, pos, _ = shred.level_rows(cols, level)
        for r, a, b in zip(rec, parent, pos):
            got[r].add((level, int(a), int(b)))
    return got


def test_positions_equal_a_walk():
    assert positions(PAYLOADS) == [brute(p) for p in PAYLOADS]


def test_random_nesting_equals_a_walk():
    rng = random.Random(5)

    def maybe(f):
        return rng.choice([None, f(), f(), f(), json.dumps(f())])

    def overlaps():
        return rng.choice([[rng.choice([None, {}, {"path": "a"}]) for _ in range(rng.randrange(4))], {"path": "x"}])

    def relation():
        return {k: v for k, v in {"source_ref": "s", "reversal": maybe(lambda: {"path_overlaps": maybe(overlaps), "method": "m"})}.items() if rng.random() < 0.9}

    def record():
        return {"retrospective": {"strong_signals": maybe(lambda: [rng.choice([None, {}, {"changed_paths": ["q"] * rng.randrange(3)}]) for _ in range(rng.randrange(4))]), "commit_relationships": maybe(lambda: [rng.choice([None, relation()]) for _ in range(rng.randrange(4))])}}

    payloads = [json.dumps(record()) for _ in range(400)]
    assert positions(payloads) == [brute(p) for p in payloads]


def test_tables(spark):
    rows = [(i, p) for i, p in enumerate(PAYLOADS)] + [(6, PAYLOADS[6]), (None, PAYLOADS[5])]
    df = spark.createDataFrame(rows, "record_id bigint, payload string").selectExpr("*", "'c' AS level", "1 AS pos", "2 AS path")
    found = {tuple(r) for r in shred.flat_positions(df).collect()}
    assert found == {(i, *x) for i, p in enumerate(PAYLOADS) for x in brute(p)}
    table = {(r.record_id, r.parent_pos, r.pos): r.path for r in shred.flat_table(df, "path_overlap").collect()}
    assert table == {(7, 1, 2): "p", (7, 1, 3): None, (8, 1, 1): "q"}
    assert shred.flat_positions(df.limit(0)).count() == 0


def test_lists_of_scalars_are_child_tables(spark):
    signals = [[{"signal_type": "A", "changed_paths": ["a", "b", None]}, None, {"signal_type": "B", "changed_paths": []}, {"signal_type": "C"}, {"signal_type": "D", "changed_paths": ["c", "d"]}], [{"signal_type": "E", "changed_paths": "e"}, {"signal_type": "F", "changed_paths": ["f", "g"]}]]
    rows = [(i, json.dumps({"retrospective": {"strong_signals": s}})) for i, s in enumerate(signals)]
    df = spark.createDataFrame(rows, "record_id bigint, payload string").coalesce(1)
    got = {tuple(r) for r in shred.scalar_table(df, "changed_path").collect()}
    assert got == {(0, 1, 1, "a"), (0, 1, 2, "b"), (0, 1, 3, None), (0, 5, 1, "c"), (0, 5, 2, "d"), (1, 1, 1, "e"), (1, 2, 1, "f"), (1, 2, 2, "g")}
    assert {(r.record_id, r.pos, r.signal_type) for r in shred.flat_table(df, "strong_signal").collect()} == {(0, 1, "A"), (0, 3, "B"), (0, 4, "C"), (0, 5, "D"), (1, 1, "E"), (1, 2, "F")}
    assert shred.scalar_table(df.limit(0), "changed_path").count() == 0


def test_fields_of_inner_groups_are_typed_columns(spark):
    lineage = {"later_removed_line_count": 4, "direct_lineage_fraction": 0.5, "method": "blame", "matched_original_commit_shas": ["a1", "b2"]}
    relations = [{"source_ref": "s", "lineage": lineage, "reversal": {"method": "m", "full_reverse_patch_match": True}}, None, {"source_ref": "t", "lineage": json.dumps({"lines_blamed_to_original_pr": "2", "later_removed_line_count": "many"})}, {"source_ref": "u"}]
    df = spark.createDataFrame([(1, json.dumps({"retrospective": {"commit_relationships": relations}}))], "record_id bigint, payload string")
    names = ["source_ref", *("lineage_" + n for n in ("later_removed_line_count", "lines_blamed_to_original_pr", "direct_lineage_fraction", "method"))]
    table = shred.flat_table(df, "commit_relationship")
    got = {r.pos: tuple(r[n] for n in names) for r in table.collect()}
    assert got == {1: ("s", 4, None, 0.5, "blame"), 3: ("t", None, 2, None, None), 4: ("u", None, None, None, None)}
    assert {tuple(r) for r in shred.scalar_table(df, "matched_original_commit_sha").collect()} == {(1, 1, 1, "a1"), (1, 1, 2, "b2")}
    assert not [n for n in table.columns if n.startswith("reversal")]
    assert [(r.method, r.full_reverse_patch_match) for r in shred.flat_table(df, "reversal").collect()] == [("m", True)]


def test_every_leaf_is_in_one_table():
    paths = [p for level in shred.LEVELS for p in shred.columns(level).values()]
    paths += [p for p, _ in shred.SCALARS.values()]
    assert sorted(paths) == sorted(shred.Columns(shred.EVIDENCE).rows)
