import ast
from pathlib import Path

from changelode.llm import queries

ROOT = Path(__file__).resolve().parents[2]


def test_run_and_columns(spark, small):
    want = {"p1_found": ["field", "record_id", "kind", "start_pos"], "p5_found": ["doc_id", "item_id"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "start_pos"], "p7_fill": None}
    for name, columns in want.items():
        df = queries.queries()[name](spark, small)
        assert df.count() > 0 and columns in (None, df.columns)
        assert df.dropDuplicates().count() == df.count()


def test_all_three_fields_are_masked(spark, small):
    places = {}
    for r in queries.p1_found(spark, small).where("field = 'body_edits.editor'").collect():
        places.setdefault(r.record_id, []).append(r)
    raw = {r.edit_id: r.editor for r in spark.read.parquet(f"{small}/body_edits.parquet").select("edit_id", "editor").collect()}
    masked = {r.edit_id: r.editor_masked for r in queries.queries()["p1_masked_editors"](spark, small).collect()}
    assert masked.keys() == raw.keys() and places
    for i, editor in raw.items():
        if i in places:
            first = min(places[i], key=lambda r: r.start_pos)
            assert masked[i].startswith(f"{editor[: first.start_pos - 1]}[{first.kind.upper()}]")
        else:
            assert masked[i] == editor


def test_nothing_outside_imports_the_subpackage():
    for path in (ROOT / "changelode").rglob("*.py"):
        if "llm" not in path.parts:
            names = [n for x in ast.walk(ast.parse(path.read_text())) if isinstance(x, (ast.Import, ast.ImportFrom)) for n in ([x.module or ""] if isinstance(x, ast.ImportFrom) else [a.name for a in x.names])]
            assert not any("llm" in n for n in names), path
