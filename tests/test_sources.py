import json
import subprocess
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from changelode.sources import arguments, bundles, gitlog, jsonl, sinks
from changelode.streaming import incremental


def test_jsonl(spark, tmp_path):
    f = tmp_path / "x.jsonl"
    f.write_text('{"number": 2, "extra": [1]}\n\n{"number": 1}\n{"number": 2, "late": true}\n')
    assert sorted(r.number for r in jsonl.read(spark, str(f), "number bigint").collect()) == [1, 2, 2]
    assert json.loads(jsonl.lookup_first(spark, str(f), "number", "2").first().raw)["extra"] == [1]
    assert json.loads(jsonl.lookup_only(spark, str(f), "number", "1")) == {"number": 1}
    for value in ("2", "9"):
        with pytest.raises(LookupError):
            jsonl.lookup_only(spark, str(f), "number", value)
    assert jsonl.ingest(spark, str(f), "number bigint", str(tmp_path / "p")).count() == 3
    f.write_text('{"number": \n')
    with pytest.raises(Exception):
        jsonl.read(spark, str(f), "number bigint").collect()


def test_publish_is_new_only(tmp_path):
    target = tmp_path / "out"
    with pytest.raises(RuntimeError):
        jsonl.publish(str(target), lambda p: (_ for _ in ()).throw(RuntimeError()))
    assert not target.exists()
    write = lambda p: __import__("os").makedirs(p)
    jsonl.publish(str(target), write)
    with pytest.raises(FileExistsError):
        jsonl.publish(str(target), write)
    assert [x.name for x in tmp_path.iterdir()] == ["out"]


def test_bundles(spark, tmp_path):
    place = tmp_path / bundles.path_of("o/n", 7)
    place.parent.mkdir(parents=True)
    place.write_text(json.dumps({"pull_request": {"number": 7, "title": "t", "body": "Fixes #3, see #2", "labels": [{"name": "bug"}]}, "commits": [{"sha": "a", "commit": {"message": "m"}}, None, {"sha": ""}]}, indent=1))
    row = bundles.original(bundles.read(spark, str(tmp_path))).first()
    assert (row.repository_dir, row.number, row.labels, row.commit_shas, row.commit_messages, row.pre_merge_issue_refs) == ("o_n", 7, ["bug"], ["a"], ["m"], [2, 3])


@pytest.mark.parametrize(
    "renames, complete, want",
    [([], True, "C"), ([(5, "B", "C")], True, "B"), ([(5, "A", "B"), (6, "B", "C")], True, "A"), ([(2, "A", "C")], True, "C"), ([(5, "A", "X")], True, None), ([(None, "A", "C")], True, None), ([(5, "", "C")], True, None), ([], False, None)],
)
def test_title_at(spark, renames, complete, want):
    events = [{"event": "renamed", "created_at": d and datetime(2025, 1, d), "rename": {"from": a, "to": b}} for d, a, b in renames] + [{"event": "closed", "created_at": None, "rename": None}]
    df = spark.createDataFrame([("C", events, complete)], "title string, ev array<struct<event:string,created_at:timestamp,rename:struct<`from`:string,`to`:string>>>, ok boolean")
    assert df.select(bundles.title_at(F.col("title"), F.col("ev"), F.col("ok"), F.lit(datetime(2025, 1, 3))).alias("t")).first().t == want


def test_gitlog(spark, tmp_path):
    git = lambda *a, **env: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=T", "-c", "user.email=t@example.org", *a], check=True, capture_output=True, env={"PATH": "/usr/bin:/bin", **env})
    git("init", "-q")
    for i, at in enumerate(("2024-01-01T00:00:00+00:00", "2024-06-01T00:00:00+00:00", "2025-01-01T00:00:00+00:00")):
        (tmp_path / "a.txt").write_text("x\n" * (i + 1))
        git("add", ".")
        git("commit", "-qm", f"change {i}\n\nbody {i}", GIT_COMMITTER_DATE=at, GIT_AUTHOR_DATE=at)
    spark.dataSource.register(gitlog.GitLogSource)
    log = spark.read.format("gitlog").option("repo", str(tmp_path)).option("slice_days", "100").load()
    assert sorted((r.subject, r.body) for r in log.collect()) == [(f"change {i}", f"body {i}") for i in range(3)]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    late = log.sparkSession.read.format("gitlog").option("repo", str(tmp_path)).option("pushdown", "true").load().where(F.col("committer_date") >= datetime(2024, 5, 1))
    assert sorted(r.subject for r in late.collect()) == ["change 1", "change 2"]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    stat = spark.read.format("gitlog").option("repo", str(tmp_path)).option("numstat", "true").option("since", "2024-05-01").load()
    assert [(r.path, r.additions, r.deletions) for r in stat.collect()] == [("a.txt", 1, 0)] * 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "n int, t string").coalesce(1)
    sinks.markdown(df, str(tmp_path / "r.md"))
    assert (tmp_path / "r.md").read_text().splitlines()[2:] == [r"| 1 | a\|b |", "| 2 |  |"]
    sinks.csv(df, str(tmp_path / "c"), ["n"])
    assert sinks.checksums(spark, str(tmp_path / "c")).where("path like '%.csv'").count() == 1
    assert df.select(sinks.cut(F.lit("é" * 40), 5).alias("x")).first().x == "éé..."


def test_arguments(tmp_path):
    assert arguments.source("h1=/d/x.jsonl") == ("h1", "/d/x.jsonl") and arguments.source("/d/x.jsonl") == ("d", "/d/x.jsonl")
    assert arguments.numbers("3, #1,3") == [1, 3] and arguments.numbers('[{"pr": 4}, 2]') == [2, 4]
    with pytest.raises(ValueError):
        arguments.source("a=")
    f = tmp_path / "r.json"
    f.write_text(json.dumps({"heuristics": {"path_rules": [{"name": "p", "pattern": "^a", "weight": 0.5}], "keyword_rules": [], "scoring": {"max_cap": 0}}}))
    rules, digest = arguments.rule_set(str(f))
    assert rules.cap == 1.0 and rules.paths[0].weight == 0.5 and len(digest) == 64


def test_stream_appends_once(spark, tmp_path):
    row = lambda k, text: ("r", k, datetime(2025, 1, 1), text)
    ddl = "repository string, sha string, committer_date timestamp, full_message string"
    put = lambda rows: spark.createDataFrame(rows, ddl).write.mode("append").parquet(str(tmp_path / "in"))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    put([row("a", "Fixes #1"), row("a", "Fixes #1"), row("b", "nothing")])
    for more in ([], [row("c", "Fixes: abcdef1 and closes #2")], []):
        if more:
            put(more)
        incremental.run(incremental.references(incremental.commit_stream(spark, str(tmp_path / "in"))), out, ck).awaitTermination()
    assert sorted((r.sha, r.kind, r.ref) for r in spark.read.parquet(out).collect()) == [("a", "FIXES_PR", "1"), ("c", "FIXES_PR", "2"), ("c", "FIXES_SHA", "abcdef1")]
