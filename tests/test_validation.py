import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from changelode.operators import validation as v

CUT = datetime(2025, 1, 1)
META = {"schema_version": "m/v2", "repository": "o/r", "title": "{x", "cutoff_timestamp": "2025-01-01T00:00:00Z", "commit_messages": ["a"]}
MANIFEST = {"schema_version": "c/v1", "case_id": "c", "repository": "o/r", "cutoff_timestamp": "2025-01-01T01:00:00+01:00", "base_commit": "a" * 40, "cutoff_commit": "b" * 40, "snapshot_format": "f"}


def pick(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "change, problem",
    [({}, None), ({"extra": 1}, "unknown field"), ({"title": {"a": 1}}, "nested value"), ({"description": []}, "nested value"), ({"schema_version": "m/v1"}, "schema version"), ({"repository": ""}, "required field"), ({"cutoff_timestamp": "2025-01-02T00:00:00Z"}, "cut-off"), ({"title": "has secret-value"}, "forbidden value"), ({"title": "short"}, None), (None, "not one object")],
)
def test_metadata(spark, change, problem):
    doc = "{broken" if change is None else json.dumps(META | change)
    assert pick(spark, v.metadata_problem(F.lit(doc), F.lit(CUT), "m/v2", F.array(F.lit("secret-value"), F.lit("short"), F.lit(None)))) == problem


@pytest.mark.parametrize("change, problem", [({}, None), ({"digest": "x"}, "unknown field"), ({"base_commit": "abc"}, "commit id"), ({"case_id": ""}, "required field"), ({"snapshot_format": "z"}, "snapshot format"), ({"cutoff_timestamp": "soon"}, "cut-off")])
def test_manifest(spark, change, problem):
    assert pick(spark, v.manifest_problem(F.lit(json.dumps(MANIFEST | change)), F.lit(CUT), "c/v1", "f")) == problem


@pytest.mark.parametrize("row, problem", [((True, "s", "m", "2025-01-01T00:00:00Z"), None), ((True, "", "m", "2025-01-01T00:00:00Z"), "no provenance"), ((True, "s", "m", "never"), "validity time"), ((True, "s", "m", "2025-01-01T00:00:01Z"), "later than the cut-off"), ((False, None, None, None), None), ((None, None, None, None), None)])
def test_decisions(spark, row, problem):
    cols = [F.lit(x).cast(t) for x, t in zip(row, ("boolean", "string", "string", "string"))]
    assert pick(spark, v.decision_problem(*cols, F.lit(CUT))) == problem


def test_identity_and_names(spark):
    side = lambda **kw: {k: F.lit(x) for k, x in ({"number": 1, "repository": "o/r", "base_sha": "a", "head_sha": "b"} | kw).items()}
    assert pick(spark, v.identity_problem(side(), side())) is None
    assert pick(spark, v.identity_problem(side(number=2), side())) == "number"
    assert pick(spark, v.identity_problem(side(head_sha=""), side(head_sha=""))) == "head_sha"
    assert pick(spark, v.is_evaluator_name(F.lit("x/Oracle.JSON"))) and not pick(spark, v.is_evaluator_name(F.lit("oracle.json/x")))
