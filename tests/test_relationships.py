"""From a made repository to relationships, and the operators on lists, batches and reports."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from changelode.operators import admission, baseline, diffs, keys, merging, ranking, relations, reports
from changelode.sources import bundles, gitrel, jsonl, sinks

BODY = [f"int value_{i} = {i} + call_{i}();" for i in range(8)]


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")

    def git(*a):
        env = {"PATH": "/usr/bin:/bin", "GIT_COMMITTER_DATE": "2024-01-01T00:00:00Z", "GIT_AUTHOR_DATE": "2024-01-01T00:00:00Z"}
        return subprocess.run(["git", "-C", str(root), "-c", "user.name=T", "-c", "user.email=t@example.org", *a], check=True, capture_output=True, env=env, text=True).stdout.strip()

    def save(text, message):
        (root / "a.c").write_text(text)
        git("add", "-A")
        git("commit", "-qm", message)
        return git("rev-parse", "HEAD")

    git("init", "-q", "-b", "main")
    ids = {"base": save("\n".join(BODY) + "\n", "start")}
    git("checkout", "-qb", "topic")
    ids["own"] = save("\n".join(BODY[:4] + ["int added_one(void);", "int added_two(void);"] + BODY[4:]) + "\n", "topic")
    git("checkout", "-q", "main")
    git("merge", "-q", "--no-ff", "-m", "Merge pull request #7", "topic")
    ids["merge"] = git("rev-parse", "HEAD")
    ids["part"] = save("\n".join(BODY[:4] + ["int added_one(void);", "int other(int);"] + BODY[4:]) + "\n", "part")
    ids["back"] = save("\n".join(BODY[:4] + ["int added_one(void);", "int added_two(void);"] + BODY[4:]) + "\n", "back")
    ids["undo"] = save("\n".join(BODY) + "\n", "undo")
    (root / "link").symlink_to("a.c")
    (root / "second").symlink_to("a.c")
    ids["tree"] = save("\n".join(BODY) + "\n", "links")
    return str(root), ids


def table(spark, ddl, *rows):
    return spark.createDataFrame(list(rows), ddl)


def test_git_relations(spark, repo):
    path, ids = repo
    pairs = table(spark, "base string, head string", (ids["base"], ids["own"]), (ids["part"], ids["own"]), ("", "x"), ("0" * 40, ids["own"]))
    got = {(r.base, r.head): r for r in gitrel.request_diffs(pairs, path).collect()}
    own = got[ids["base"], ids["own"]]
    assert own.merge_base == ids["base"] and [(f.path, f.status, f.additions, f.deletions) for f in own.files] == [("a.c", "added", 2, 0)]
    assert got[ids["part"], ids["own"]].raw_diff == "" and got[ids["part"], ids["own"]].patch_id is None
    assert got["", "x"].status == "error" and got["0" * 40, ids["own"]].status == "error"
    ends = {r.base: r for r in gitrel.endpoint_diffs(pairs.limit(2), path).collect()}
    assert "other" in ends[ids["part"]].raw_diff and ends[ids["base"]].patch_id == own.patch_id
    shas = table(spark, "sha string", *[(x,) for x in (ids["base"], ids["merge"], ids["undo"], "f" * 40)])
    assert {r.sha: r.parents for r in gitrel.parents(shas, path).collect()} == {ids["base"]: 0, ids["merge"]: 2, ids["undo"]: 1, "f" * 40: None}
    gone = gitrel.removed_lines(shas, path).where("error is null").collect()
    assert sorted((r.sha, r.line, r.content) for r in gone) == [(ids["undo"], 5, "int added_one(void);"), (ids["undo"], 6, "int added_two(void);")]
    back = {r.sha: r for r in gitrel.reverse_patches(shas, path).collect()}
    assert back[ids["undo"]].patch_id == own.patch_id and back["f" * 40].error and back[ids["base"]].error
    meta = {r.sha: r for r in gitrel.exported(shas, path).collect()}
    assert [meta[ids[k]].patch_method for k in ("base", "merge", "undo")] == ["root", "first_parent", "parent"]
    assert "added_one" in meta[ids["merge"]].patch and meta[ids["undo"]].changed_paths == ["a.c"] and meta[ids["undo"]].message == "undo" and meta["f" * 40].error
    assert {r.head: r.merge_base for r in gitrel.merge_bases(pairs.limit(1), path).collect()} == {ids["own"]: ids["base"]}
    names = {r.name: r.sha for r in gitrel.resolved(table(spark, "name string", ("main",), ("nothing",)), path).collect()}
    assert names == {"main": ids["tree"], "nothing": None} and gitrel.head(path) == ids["tree"]


def test_trees_are_written_when_admissible(spark, repo, tmp_path):
    path, ids = repo
    entries = gitrel.tree(table(spark, "commitish string", (ids["tree"],), (ids["own"],)), path)
    assert {r.path: r.link_target for r in entries.where(F.col("commitish") == ids["tree"]).collect()} == {"a.c": None, "link": "a.c", "second": "a.c"}
    assert gitrel.materialize(entries, path, ids["tree"], str(tmp_path / "out")) == 3
    assert (tmp_path / "out" / "link").read_text() == "\n".join(BODY) + "\n"
    bad = entries.withColumn("link_target", F.when(F.col("mode") == "120000", "../x"))
    with pytest.raises(ValueError):
        gitrel.materialize(bad, path, ids["tree"], str(tmp_path / "bad"))
    pairs = table(spark, "base string, head string", (ids["base"], ids["tree"]), ("", ids["own"]), (ids["base"], ids["own"]))
    bases = gitrel.merge_bases(pairs, path)
    assert {(r.base, r.head): r.blocker for r in gitrel.exportable(pairs, entries, bases).collect()} == {(ids["base"], ids["tree"]): None, ("", ids["own"]): "base or head is unknown", (ids["base"], ids["own"]): None}
    assert gitrel.exportable(pairs, bad, bases).where("blocker like 'link:%'").count() == 1


def test_relationships(spark, repo):
    path, ids = repo
    later = [ids["part"], ids["undo"], ids["merge"], ids["base"], "f" * 40]
    candidates = table(spark, "record_id bigint, sha string", *[(7, x) for x in later], (8, ids["undo"]), (7, "e" * 40))
    shas = table(spark, "sha string", *[(x,) for x in later])
    heads = gitrel.parents(shas, path)
    removed = gitrel.removed_lines(shas, path).where("error is null").drop("error")
    ranges = removed.groupBy("sha", "path").agg(F.min("line").cast("int").alias("first"), F.max("line").cast("int").alias("last"))
    request = gitrel.request_diffs(table(spark, "base string, head string", (ids["base"], ids["own"])), path)
    lines = diffs.diff_lines(request.select(F.lit(7).cast("bigint").alias("record_id"), "raw_diff"), "record_id")
    commits = gitrel.commit_diffs(shas, path)
    requests = request.select(F.lit(7).cast("bigint").alias("record_id"), "patch_id", "error").unionByName(table(spark, "record_id bigint, patch_id string, error string", (8, None, "no base")))
    out = relations.relationships(
        candidates, heads, removed, gitrel.blame(ranges, path), table(spark, "record_id bigint, target string", (7, ids["own"])), requests, lines, commits, diffs.diff_lines(commits.where("raw_diff is not null")), gitrel.reverse_patches(shas, path),
    )
    got = {(r.record_id, r.source_ref): r for r in out.collect()}
    assert {k: r.analysis_status for k, r in got.items()} == {
        (7, ids["part"]): "complete", (7, ids["undo"]): "complete", (7, ids["merge"]): "skipped_merge", (7, ids["base"]): "skipped_root", (7, "f" * 40): "error", (7, "e" * 40): "unavailable", (8, ids["undo"]): "partial",
    }
    undo, part = got[7, ids["undo"]], got[7, ids["part"]]
    assert undo.reversal.reversal_type == "full" and undo.reversal.full_reverse_patch_match and undo.reversal.removed_again == 2 and undo.reversal.fraction == 1.0
    assert (part.reversal.reversal_type, part.lineage.removed_lines, part.lineage.blamed_lines, part.reversal.supported) == ("partial_candidate", 1, 1, 1)
    assert undo.lineage.matched == [ids["own"]] and [o.path for o in undo.reversal.path_overlaps] == ["a.c"]
    assert got[8, ids["undo"]].reversal is None and "request diff: no base" in got[8, ids["undo"]].analysis_note and got[7, ids["merge"]].lineage is None


def test_lists_unions_and_batches(spark):
    rows = table(spark, "k int, v string", (1, "a"), (2, "b"), (3, None))
    members = table(spark, "k int, extra int", (1, 0), (1, 1), (9, 0))
    assert [r.k for r in merging.listed(rows, members, ["k"]).collect()] == [1]
    assert sorted(r.k for r in merging.listed(rows, members, ["k"], keep=False).collect()) == [2, 3]
    with pytest.raises(ValueError, match="9"):
        merging.listed(rows, members, ["k"], complete=True)
    assert merging.united({"x": rows.limit(1), "y": rows.where("k > 1")}, ["k"]).count() == 3
    with pytest.raises(ValueError):
        merging.united({"x": rows, "y": rows}, ["k"])
    with pytest.raises(ValueError):
        merging.united({}, ["k"])
    assert merging.finalized(rows, rows, ["k"]).count() == 3
    bad = rows.where("k != 2").unionByName(table(spark, "k int, v string", (1, "z"), (4, "z")))
    assert {r.k: r.problem for r in merging.coverage(rows, bad, ["k"]).collect()} == {1: "more than once", 2: "missing", 4: "not in the input"}
    with pytest.raises(ValueError):
        merging.finalized(rows, bad, ["k"])
    assert merging.replaced(rows, rows.where("k = 3"), ["k"], {"v": "v"}).count() == 3
    for wrong in (table(spark, "k int, v string", (3, "c")), table(spark, "k int, v string", (5, "c"))):
        with pytest.raises(ValueError):
            merging.replaced(rows, wrong, ["k"], {"v": "v"})
    numbered = merging.batches(table(spark, "g string, n bigint, id int", *[("g", 1, i) for i in range(5)], ("g", None, 9)), ["g"], "n", size=2, tie="id").collect()
    assert sorted((r.batch, r.id) for r in numbered) == [(0, 0), (0, 9), (1, 1), (1, 2), (2, 3), (2, 4)]
    pairs = ranking.pair_ids(table(spark, "r string, positive bigint", ("a", 30), ("a", 5), ("b", 7)), "positive", ["r"])
    assert sorted((r.r, r.positive, r.pair_id) for r in pairs.collect()) == [("a", 5, "pair-0001"), ("a", 30, "pair-0002"), ("b", 7, "pair-0001")]
    assert [tuple(r) for r in ranking.first_by(table(spark, "n int, sha string, place int", (1, "b", 2), (1, "a", 1)), ["n"], "sha", "place").collect()] == [(1, "a")]


def test_states_of_records(spark, small):
    from changelode.operators import records

    with pytest.raises(ValueError):
        records.is_positive("weak")
    rows = spark.read.parquet(f"{small}/pr_record.parquet").select(records.is_counted().alias("c"), records.is_positive("any").alias("a"), records.is_positive().alias("s"))
    assert rows.where("c is null or a is null or s is null or (s and not a)").count() == 0


def test_touched_order(spark):
    lines = table(spark, "case_id string, subsystem string, lines bigint", ("c", "lib", 9), ("c", "doc", 50), ("c", "z", 9), ("c", "new", 9))
    scored = table(spark, "case_id string, subsystem string, score double, tercile int", ("c", "lib", 0.1, 1), ("c", "z", 0.9, 3))
    primary = table(spark, "case_id string, subsystem string", ("c", "lib"))
    got = sorted((r.place, r.subsystem) for r in baseline.touched(lines, scored, primary).collect())
    assert got == [(1, "lib"), (2, "doc"), (3, "z"), (4, "new")]


def test_report_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(reports.human_bytes(F.lit(n))) for n in (0, 1023, 1536, 3 << 30)] == ["0 B", "1023 B", "1.5 KB", "3.0 GB"]
    assert one(reports.shortened(F.lit("abcdefgh"), 6)) == "abc..." and one(reports.shortened(F.lit("abc"), 6)) == "abc"
    assert one(reports.tier_label(F.lit(0), F.lit(2), F.lit(5))) == "2 medium" and one(reports.tier_label(F.lit(0), F.lit(0), F.lit(0))) == "-"
    report = table(spark, "subsystem string, blocker string", ("a", None), ("a", "x"), ("b", None))
    assert tuple(reports.totals(report).first()) == (3, 2, 2, 1) and tuple(reports.totals(report.limit(0)).first()) == (0, 0, 0, 0)


def test_evidence_of_one_record(spark, small):
    records = spark.read.parquet(f"{small}/pr_record.parquet")
    signals = reports.signal_rows(records)
    assert signals.groupBy("record_id", "signal_id").count().where("count > 1").count() == 0
    assert signals.where("commit is not null and commit not rlike '^[0-9a-f]{40}$'").count() == 0
    sha = signals.where("commit is not null").first().commit
    exported = table(spark, "sha string, subject string, patch string, error string", (sha, "s", "p", None))
    related = table(spark, "record_id bigint, commit string, place bigint", (1, "a" * 40, 0))
    states = {r.state for r in reports.commit_rows(signals, related, exported).collect()}
    assert states == {"materialized", "missing"}
    assert reports.patch_manifests(signals).where("size(signals) = 0").count() == 0
    lines = sinks.evidence_lines(records.dropDuplicates(["record_id"]))
    assert lines.count() == signals.count() and lines.where("line is null").count() == 0
    values = keys.forbidden(records)
    assert values.where("octet_length(value) < 7").count() == 0 and values.count() > 0


def test_contracts_and_cache(spark, tmp_path):
    assert [admission.contract(x) for x in ("", "v1", "v2")] == ["v1", "v1", "v2"]
    with pytest.raises(ValueError):
        admission.contract("v3")
    for n in (1, 2):
        bundles.store(str(tmp_path / "cache"), "o/n", n, json.dumps({"pull_request": {"number": n, "title": "t", "updated_at": f"2024-01-0{n}T00:00:00Z"}}))
    bundles.store(str(tmp_path / "cache"), "o/n", 2, json.dumps({"pull_request": {"number": 2, "title": "new", "updated_at": "2024-01-02T00:00:00Z"}}))
    cached = bundles.read(spark, str(tmp_path / "cache"))
    limit = F.lit("2024-01-01T12:00:00Z").cast("timestamp")
    assert {r.number: r.title for r in cached.select("number", *[c.alias(n) for n, c in admission.unchanged_since(limit).items()]).collect()} == {1: "t", 2: None}
    wanted = table(spark, "repository string, number bigint", ("o/n", 1), ("o/n", 3))
    with pytest.raises(LookupError, match="o/n#3"):
        bundles.cached_first(spark, wanted, str(tmp_path / "cache"))
    fetched = lambda lack: lack.select(F.lit("o_n").alias("repository_dir"), "number")
    assert sorted(r.number for r in bundles.cached_first(spark, wanted, str(tmp_path / "cache"), fetched).collect()) == [1, 3]
    counts = admission.outcomes(table(spark, "field string, outcome string", ("title", "admitted"), ("title", "admitted"), ("title", None)))
    assert {(r.field, r.outcome): r.n for r in counts.collect()} == {("title", "admitted"): 2, ("title", None): 1}
    lines = tmp_path / "cases.jsonl"
    lines.write_text('{"schema_version": "case/v4"}\n')
    assert jsonl.read_version(spark, str(lines), "schema_version string", "case/").count() == 1
    lines.write_text('{"schema_version": "other/v4"}\n')
    with pytest.raises(Exception, match="is no case/"):
        jsonl.read_version(spark, str(lines), "schema_version string", "case/").collect()
