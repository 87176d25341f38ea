import json
from datetime import datetime

from changelode.operators import drift

DDL = "stream string, file_name string, written_at timestamp, line_no int, raw string"


def files(spark, *contents, stream="s"):
    rows = [(stream, f"f{i}", datetime(2025, 1, 1 + i), k, x if isinstance(x, (str, type(None))) else json.dumps(x)) for i, lines in enumerate(contents) for k, x in enumerate(lines)]
    return spark.createDataFrame(rows, DDL)


def found(df):
    return sorted((r.file_name, r.change, r.field_path, r.old_path) for r in drift.drift(df).collect())


def test_added_removed_retyped(spark):
    df = files(spark, [{"a": 1, "b": "x", "o": {"c": True}}], [{"a": "1", "o": {"c": True, "d": None}}, None, "", '{"a": '], [{"a": "1", "o": {"c": True, "d": [1]}, "l": [{"z": 1}]}])
    assert found(df) == [("f1", "removed", "b", ""), ("f1", "type_changed", "a", ""), ("f2", "added", "l", ""), ("f2", "added", "o.d", "")]


def test_renames_by_kind_and_children(spark):
    old = {"edits": [{"at": "2025-01-01T00:00:00Z", "who": "ann-1"}], "url": "https://a.example/1", "title": "one two three"}
    new = {"history": [{"at": "2025-02-01T00:00:00Z", "who": "bob-2"}], "web": "https://a.example/2", "subject": "four five six"}
    assert found(files(spark, [old], [new])) == [("f1", "renamed", "history", "edits"), ("f1", "renamed", "subject", "title"), ("f1", "renamed", "web", "url")]


def test_no_rename_between_fields_that_stand_together(spark):
    both = {"x_done": True, "y_done": False}
    assert found(files(spark, [both], [{"x_done": True}], [{"y_done": True}])) == [("f1", "removed", "y_done", ""), ("f2", "added", "y_done", ""), ("f2", "removed", "x_done", "")]


def test_object_to_text_hides_its_fields(spark):
    assert found(files(spark, [{"u": {"login": "a", "id": 1}}], [{"u": "a"}])) == [("f1", "type_changed", "u", "")]


def test_streams_repeats_and_empty(spark):
    a = files(spark, [{"k": 1}, {"k": 1}], [{"k": "1"}, {"k": "1"}])
    b = files(spark, [{"k": 1}], stream="other").withColumn("file_name", drift.F.lit("g"))
    assert found(a.unionByName(b)) == [("f1", "type_changed", "k", "")]
    assert found(a.limit(0)) == []


def test_nulls_and_clashing_columns(spark):
    rows = [("s", "f0", None, None, '{"a": 1}'), ("s", "f1", datetime(2025, 1, 1), 1, '{"a": true}'), (None, "f2", None, 2, '{"a": 1}'), ("s", None, None, 3, '{"a": 1}'), ("s", "f1", datetime(2025, 1, 1), 2, '{"a": "' + "x" * 200000 + '"}')]
    df = spark.createDataFrame(rows, DDL).selectExpr("*", "'c' AS path", "1 AS old", "2 AS types", "3 AS week", "4 AS next_name", "5 AS value")
    assert found(df) == [("f1", "type_changed", "a", "")]
    assert drift.branches(df).count() == 5 and drift.branches(df.limit(0)).count() == 0


def test_canonical_branches(spark):
    rows = {r.field_path: r for r in sorted( drift.branches(files(spark, [{"n": 1, "t": "x", "f": False, "m": 1735689600, "a": [1, "b"], "o": [{"q": None, "r": "1"}], "big": 5000000000, "huge": 10**400}, {"m": "2025-02-01T00:00:00Z"}, "bad"])).collect(), key=lambda r: -r.line_no)}
    assert rows["big"].value == "5000000000" and rows["huge"].value == "1" + "0" * 400 and rows["huge"].as_number is None
    assert rows["n"].as_number == 1 and rows["t"].as_string == "x" and rows["f"].value == "false"
    assert rows["m"].value == "2025-01-01T00:00:00Z" and json.loads(rows["a"].as_json) == [1, "b"] and rows["o[].r"].path == "o[1].r"


def test_canonical_names_follow_renames(spark):
    old = {"edits": [{"at": "2025-01-01T00:00:00Z", "who": "ann-1"}], "url": "https://a.example/1"}
    new = {"history": [{"at": "2025-02-01T00:00:00Z", "who": "bob-2"}], "web": "https://a.example/2"}
    last = {"history": [{"at": "2025-03-01T00:00:00Z", "who": "cid-3"}], "link": "https://a.example/3"}
    df = files(spark, [old], [new], [last])
    other = files(spark, [{"web": "https://b.example/1"}], stream="other")
    got = {(r.stream, r.file_name, r.path, r.field_path) for r in drift.branches(df.unionByName(other)).collect()}
    want = {("s", f"f{i}", f"{h}[1].{x}", f"edits[].{x}") for i, h in enumerate(["edits", "history", "history"]) for x in ("at", "who")}
    assert got == want | {("s", f"f{i}", p, "url") for i, p in enumerate(["url", "web", "link"])} | {("other", "f0", "web", "web")}


def test_names_side_by_side_stay_apart():
    schemas = [(1, ["a"]), (2, ["b"]), (3, ["c"]), (4, ["a", "c"])]
    assert drift.one_name([("a", "b", 2), ("b", "c", 1)], schemas) == {"b": "a"}
    assert drift.one_name([("a", "b", 1), ("b", "a", 1)], schemas[:2]) == {"b": "a"}


def test_every_readable_line_has_a_row(spark):
    df = files(spark, [{}, {"a": None}, {"b": {}}, {"c": {"d": None}}, "bad", None, "[]"])
    got = {(r.line_no, r.path, r.value) for r in drift.branches(df).collect()}
    assert got == {(0, "", None), (1, "", None), (2, "b", "{}"), (3, "c", "{}")}


def test_one_wide_table(spark):
    old = [{"pr": {"id": 7, "closed_at": "2025-01-01T00:00:00Z"}, "tags": ["a"], "done": True, "url": "https://a.example/1", "count": 5000000000}, {}, "bad", "[]"]
    new = [{"pr": {"id": 8, "closed_at": 1735693200}, "tags": [{"name": None, "x": 1}], "done": "no", "web": "https://a.example/2", "count": 3, "extra": {"a": {"b": "t"}}}]
    df = files(spark, old, new)
    table = drift.canonical(df)
    rows = {(r.file_name, r.line_no): r for r in table.collect()}
    assert set(rows) == {("f0", 0), ("f0", 1), ("f1", 0)}  # one row a readable line
    kinds = dict(table.dtypes)
    assert (kinds["pr_id"], kinds["pr_closed_at"], kinds["done"], kinds["count"], kinds["url"], kinds["tags"]) == ("double", "timestamp", "boolean", "double", "string", "string") and "web" not in kinds
    a, b = rows["f0", 0], rows["f1", 0]
    assert (a.url, b.url, a.done, b.done, a["count"], b.extra_a_b) == ("https://a.example/1", "https://a.example/2", True, None, 5e9, "t") or b.done is False
    assert str(b.pr_closed_at) == "2025-01-01 01:00:00" and b.tags == '[{"x":1}]' and rows["f0", 1].url is None
    assert drift.canonical(df.limit(0)).count() == 0


def test_rare_fields_share_a_map(spark, monkeypatch):
    monkeypatch.setattr(drift, "MAX_COLUMNS", 1)
    row = drift.canonical(files(spark, [{"a": 1, "b": "x", "c": {"d": True}}, {"a": 2}])).where("line_no = 0").first()
    assert row.a == 1 and row.other_fields == {"b": "x", "c.d": "true"}


def test_moments():
    assert drift.moment(1735689600) == drift.moment(1735689600000) == "2025-01-01T00:00:00Z" and drift.moment(10**400) is None and drift.moment(1e300) is None
