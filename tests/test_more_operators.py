import subprocess
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from changelode.functions import tree
from changelode.operators import admission, baseline, diffs, keys, ranking, rebuild, relations
from changelode.sources import gitrel
from changelode.sources.bundles import BUNDLE

CUT = datetime(2026, 1, 1)


def day(n):
    return CUT + timedelta(days=n)


def test_months_before(spark):
    rows = [datetime(2024, 2, 29), datetime(2024, 3, 31, 5), datetime(2026, 1, 1)]
    got = [r.t for r in spark.createDataFrame([(x,) for x in rows], "t timestamp").select(baseline.months_before(F.col("t"), 24).alias("t")).collect()]
    assert got == [datetime(2022, 3, 1), datetime(2022, 3, 31, 5), datetime(2024, 1, 1)]


def changes(extra_lib=0):
    """bgpd 25 commits and one defect, zebra 22 and three, lib 5; one too old, one at the cut-off."""
    out = [("r", "bgpd", day(-10 - i), 1, 10, int(i == 0)) for i in range(25)]
    out += [("r", "zebra", day(-10 - i), 1, 40 if i < 19 else 1, int(i < 3)) for i in range(22)]
    out += [("r", "lib", day(-5 - i), 1, 1, 0) for i in range(5 + extra_lib)]
    return out + [("r", "bgpd", day(-800), 1, 999, 1), ("r", "bgpd", CUT, 1, 999, 1), ("q", "bgpd", day(-3), 1, 999, 1)]


@pytest.mark.parametrize("extra, want", [(0, {"zebra": (22, 3, 2, False), "bgpd": (25, 1, 1, False), "lib": (5, 0, None, False), "doc": (0, 0, None, False)}), (20, {"zebra": (22, 3, 3, True), "bgpd": (25, 1, 2, False), "lib": (25, 0, 1, False)})])
def test_baseline(spark, extra, want):
    rows = spark.createDataFrame(changes(extra), "repository string, subsystem string, at timestamp, commits bigint, churn bigint, defects bigint")
    cases = spark.createDataFrame([(s, "r", CUT, s) for s in want], "case_id string, repository string, cutoff timestamp, subsystem string")
    totals = baseline.window_totals(rows, cases.select("case_id", "repository", "cutoff"), ["repository", "subsystem"], ["commits", "churn", "defects"])
    got = {r.subsystem: (r.commits, r.defects, r.tercile, r.risky) for r in baseline.verdicts(totals.drop("repository"), cases).collect()}
    assert got == want


def test_lineage_and_limits(spark):
    a, b = "a" * 40, "b" * 40
    cand = spark.createDataFrame([(1, "s"), (1, "s"), (2, "s"), (1, "t")], "record_id bigint, sha string")
    removed = spark.createDataFrame([("s", "x", n) for n in (1, 2, 3, 3)], "sha string, path string, line bigint")
    blame = spark.createDataFrame([("s", "x", 1, a.upper()), ("s", "x", 2, b)], "sha string, path string, line bigint, origin_sha string")
    targets = spark.createDataFrame([(1, a), (1, "short"), (2, b)], "record_id bigint, target string")
    got = {(r.record_id, r.sha): (r.removed_lines, r.analyzed_lines, r.blamed_lines, r.fraction, r.matched) for r in relations.lineage(cand, removed, blame, targets).collect()}
    assert got == {(1, "s"): (3, 2, 1, 0.5, [a]), (2, "s"): (3, 2, 1, 0.5, [b]), (1, "t"): (0, 0, 0, 0.0, [])}
    many = spark.createDataFrame([("big", f"p{i}", 1) for i in range(21)] + [("ok", "p", n) for n in (1, 2, 9)], "sha string, path string, line bigint")
    assert {r.sha: (r.paths, r.ranges, r.lines, r.over) for r in relations.over_limits(many).collect()} == {"big": (21, 1, 21, True), "ok": (1, 2, 3, False)}
    states = spark.createDataFrame([(None, True), (2, True), (0, True), (1, True), (1, False)], "p int, ok boolean").select(relations.status(F.col("p"), F.col("ok")).alias("s"))
    assert [r.s for r in states.collect()] == ["error", "skipped_merge", "skipped_root", "complete", "partial"]


def bundle(spark, **kw):
    base = {n: None for n in spark.createDataFrame([], BUNDLE).columns}
    pr = dict(number=1, title="C", body="text", created_at=day(-9), updated_at=day(2), merged_at=day(-1), commits=1, html_url=None, user=None, base={"ref": "main", "sha": None}, head=None, merge_commit_sha=None, labels=None)
    pr.update(kw.pop("pr", {}))
    base |= {"pull_request": pr, "issue_events": [], "issue_events_complete": True, "body_edits": [], "body_edits_complete": True} | kw
    return spark.createDataFrame([tuple(base.values())], BUNDLE)


def edit(at, deleted=None):
    return {"created_at": None, "edited_at": at, "updated_at": None, "deleted_at": deleted, "editor": None, "diff": None}


def rename(at, a, b):
    return {"event": "renamed", "created_at": at, "rename": {"from": a, "to": b}}


@pytest.mark.parametrize(
    "kw, outcome",
    [
        ({}, "admitted"), ({"body_edits": [edit(day(-2))]}, "admitted"), ({"body_edits": [edit(CUT)]}, "admitted"), ({"body_edits": [edit(day(1))]}, "omitted-post-cutoff-edit"), ({"body_edits": None}, "admitted"),
        ({"body_edits_complete": False}, "omitted-unverifiable"), ({"body_edits": [edit(day(-2), day(-1))]}, "omitted-unverifiable"), ({"body_edits": [edit(None)]}, "omitted-unverifiable"),
        ({"pr": {"created_at": day(1)}}, "omitted-unverifiable"), ({"pr": {"created_at": None}}, "omitted-unverifiable"),
    ],
)
def test_description_outcomes(spark, kw, outcome):
    assert bundle(spark, **kw).select(admission.description(F.lit(CUT)).alias("d")).first().d.outcome == outcome


@pytest.mark.parametrize(
    "kw, want",
    [
        ({}, ("admitted", "current", "C")), ({"issue_events": [rename(day(1), "B", "C")]}, ("admitted", "reconstructed", "B")), ({"issue_events": [rename(day(-1), "B", "C")]}, ("admitted", "current", "C")),
        ({"issue_events": [rename(day(1), "A", "B"), rename(day(2), "B", "C")]}, ("admitted", "reconstructed", "A")), ({"issue_events": [rename(day(1), "B", "X")]}, ("omitted-unverifiable", None, None)),
        ({"issue_events": [rename(None, "B", "C")]}, ("omitted-unverifiable", None, None)), ({"issue_events_complete": False}, ("omitted-unverifiable", None, None)), ({"pr": {"created_at": day(3)}}, ("omitted-unverifiable", None, None)),
    ],
)
def test_title_outcomes(spark, kw, want):
    assert tuple(bundle(spark, **kw).select(admission.title(F.lit(CUT)).alias("t")).first().t) == want


def test_branch_and_messages(spark):
    commit = lambda at, m="m": {"sha": "s", "commit": {"message": m, "author": {"date": at}, "committer": {"date": None}}}
    pick = lambda **kw: bundle(spark, **kw).select(admission.base_branch(F.lit(CUT)).alias("b"), admission.commit_messages(F.lit(CUT)).alias("m")).first()
    assert tuple(pick(pr={"updated_at": day(-1)}, commits=[commit(day(-3))])) == ("main", ["m"])
    assert tuple(pick(commits=[commit(day(1))])) == (None, None)
    assert pick(pr={"merged_at": day(1)}, commits=[commit(day(-3))]).m is None and pick(commits=[]).m is None and pick(commits=[commit(day(-3), None)]).m is None


def test_keys(spark):
    a, b = "a" * 40, "b" * 40
    signal = "array<struct<source_ref:string,signal_type:string>>"
    recs = spark.createDataFrame([(1, {"repository": "r"}, {"strong_signals": [(a, "X"), None, (a, "Y"), ("abc", "Z")], "medium_signals": [(a, "M"), (b, "N"), (b, "O")]}), (2, {"repository": "r"}, None)], f"record_id bigint, original struct<repository:string>, retrospective struct<strong_signals:{signal},medium_signals:{signal}>")
    fixing = keys.fixing_commits(recs)
    assert sorted(tuple(r) for r in fixing.collect()) == [(1, a, "strong", "Y"), (1, b, "medium", "N")]
    assert [tuple(r) for r in keys.unresolved(recs).collect()] == [(1, "strong", "Z", "abc")]
    log = spark.createDataFrame([("r", a, "see #7, x/#8 #9 and cve-2024-0001 CVE-2024-0001")], "repository string, sha string, full_message string")
    found = keys.texts(fixing, recs, log)
    nums = lambda *n: spark.createDataFrame([(1, x) for x in n], "record_id bigint, number bigint")
    assert [r.number for r in keys.issues(found, nums(9), nums(1)).collect()] == [7]
    assert [r.cve for r in keys.cves(found).collect()] == ["CVE-2024-0001"]
    assert [r.what for r in keys.incomplete(fixing, recs, log).collect()] == [f"commit message {b}"]


def test_rebuild(spark):
    seed = spark.createDataFrame([(1,), (1,), (2,)], "number bigint")
    bundles = spark.createDataFrame([(1, "a"), (3, "c")], "number bigint, title string")
    found = spark.createDataFrame([(2, "d")], "number bigint, diff string")
    assert sorted(tuple(r) for r in rebuild.missing(seed, bundles, found, ["number"]).collect()) == [(1, "diff"), (2, "bundle")]
    assert [tuple(r) for r in rebuild.rebuild(seed, bundles, found, ["number"]).collect()] == [(1, "a", None)]


def test_tree_problems(spark):
    rows = [("a/b.c", "100644", None), ("/abs", "100644", None), ("a/../x", "100644", None), ("x/.git/y", "100644", None), ("sub", "160000", None), ("a/ok", "120000", "b.c"), ("a/dir", "120000", "../a"), ("out", "120000", "../x"), ("abs", "120000", "/etc"), ("none", "120000", "zz"), ("empty", "120000", ""), ("chain", "120000", "a/ok")]
    df = spark.createDataFrame([("c", *r) for r in rows], "commitish string, path string, mode string, link_target string")
    got = {r.path: r.problem for r in tree.problems(df).collect()}
    assert got == {"/abs": "absolute path", "a/../x": "path is not literal", "x/.git/y": "name of repository data", "sub": "mode", "out": "target escapes", "abs": "absolute target", "none": "target is absent", "empty": "empty target", "chain": "target is a link"}


def test_git_relations(spark, tmp_path):
    def git(*a):
        return subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=T", "-c", "user.email=t@example.org", *a], check=True, capture_output=True, text=True).stdout.strip()

    git("init", "-q")
    shas = []
    for text in ("one();\ntwo();\n", "one();\ntwo();\nthree();\n", "one();\nthree();\n"):
        (tmp_path / "a.c").write_text(text)
        git("add", ".")
        git("commit", "-qm", "x")
        shas.append(git("rev-parse", "HEAD"))
    (tmp_path / "link").symlink_to("a.c")
    git("add", ".")
    git("commit", "-qm", "link")
    keys_df = spark.createDataFrame([(s,) for s in [*shas, shas[0], "0" * 40]], "sha string")
    got = gitrel.commit_diffs(keys_df, str(tmp_path))
    rows = {r.sha: r for r in got.collect()}
    assert len(rows) == 4 and rows["0" * 40].status == "error" and rows["0" * 40].error and rows[shas[1]].changed_files == ["a.c"] and rows[shas[0]].parents == 0
    removed = diffs.diff_lines(got.where("status = 'ok'").select("sha", "raw_diff")).where("kind = '-'")
    ranges = ranking.islands(removed, ["sha", "path"], "line")
    origin = {(r.sha, r.path, r.line): r.origin_sha for r in gitrel.blame(ranges.select("sha", "path", "first", "last"), str(tmp_path)).collect()}
    assert origin == {(shas[2], "a.c", 2): shas[0]}
    entries = gitrel.tree(spark.createDataFrame([("HEAD",)], "commitish string"), str(tmp_path))
    assert sorted((r.path, r.mode, r.link_target) for r in entries.collect()) == [("a.c", "100644", None), ("link", "120000", "a.c")]
    assert tree.problems(entries).count() == 0
    tried = spark.createDataFrame([(1, "0" * 40, 5), (1, shas[0], 6)], "record_id bigint, sha string, log_idx bigint")
    assert tuple(gitrel.uninspected(tried, got).first()) == (1, 1, ["0" * 40])


def test_defect_origins(spark):
    a, b, c = "a1" * 20, "b2" * 20, "abcdef" + "0" * 34
    prs = spark.createDataFrame(
        [(1, "r", 7, day(1), None, a, None, [c], [("bgpd/x.c", 5, 0)]), (2, "r", 8, day(2), None, b, None, [], [("zebra/y.c", 1, 1)]), (3, "r", 9, day(3), None, None, None, [], [("lib/z.c", 1, 0)])],
        "record_id bigint, repository string, number bigint, merged_at timestamp, observation_end timestamp, merge_commit_sha string, head_sha string, commit_shas array<string>, changed_files array<struct<path:string,additions:bigint,deletions:bigint>>",
    )
    messages = {
        "id": f"Fixes: {a[:8]}", "second": f"Fixes: 999999999\nFixes: {b[:8]}", "number": "Fixes #8", "both": f"Fixes #8\nThis reverts commit {a}", "revert": 'Revert "x"', "open": "closes #9",
        "merge": "resolves #50", "vague": "Fixes: abcdef", "regress": "regression introduced in #7", "plain": "tidy", "other": "broken by #1234",
    }
    rows = [(k, "s", m, i, "r") for i, (k, m) in enumerate(messages.items())] + [("m" * 40, "Merge pull request #50 from x", "m", 98, "r"), ("n" * 40, "Merge pull request #50 again", "m", 99, "r"), ("abcdef" + "1" * 34, "s", "m", 97, "r")]
    log = spark.createDataFrame(rows, "sha string, subject string, full_message string, log_idx bigint, repository string")
    changed = spark.createDataFrame([("r", "revert", "ospfd/a.c"), ("r", "revert", "doc/a.rst"), ("r", "revert", "doc/b.rst"), ("r", "m" * 40, "pimd/a.c"), ("r", "n" * 40, "isisd/a.c")], "repository string, sha string, path string")
    got = {r.sha: (r.attributed_by, r.fixed_ref, r.subsystem) for r in relations.defect_origins(log, prs, changed).collect()}
    assert got == {
        "id": ("fixed_commit", a, "bgpd"), "second": ("fixed_commit", b, "zebra"), "number": ("fixed_pr_merge", "#8", "zebra"), "both": ("fixed_commit", a, "bgpd"), "revert": ("self", None, "ospfd"), "open": ("self", None, None),
        "merge": ("fixed_pr_merge", "#50", "pimd"), "vague": ("self", None, None), "regress": ("fixed_pr_merge", "#7", "bgpd"), "other": ("self", None, None),
    }
