import itertools
import random
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from changelode.functions import paths, refs
from changelode.operators import correlate, diffs, matching, merging, ranking, records, rules


def one(spark, column, **values):
    ddl = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], ddl).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, pattern, hits",
    [
        ("Fixes: 1fb48f5", refs.FIXES_SHA, ["1fb48f5"]), ("fixed-by: 1fb48f5", refs.FIXES_SHA, ["1fb48f5"]), ("Fixes 1fb48f5", refs.FIXES_SHA, []), ("Fixes: commit 1fb48f5", refs.FIXES_SHA, []),
        ("Reverts #12", refs.FIXES_PR, ["12"]), ("prefixes #12", refs.FIXES_PR, ["12"]), ("fix #12", refs.FIXES_PR, []), ("closes #12は", refs.FIXES_PR, ["12"]), ("", refs.FIXES_PR, []),
    ],
)
def test_reference_patterns(spark, text, pattern, hits):
    assert [h.value for h in one(spark, refs.found(F.col("m"), pattern), m=("string", text))] == hits


def test_regression_groups(spark):
    got = one(spark, refs.regressions(F.col("m")), m=("string", "broken by commit 1fb48f5, regression in #16194, caused by defaced links; introduced in version"))
    assert [(h.sha, h.number) for h in got] == [("1fb48f5", ""), ("", "16194"), ("defaced", "")]


def test_digit_prefixes_equal_containment(spark):
    rng = random.Random(2)
    subjects = ["".join(rng.choice("#0123 a") for _ in range(14)) for _ in range(150)]
    df = spark.createDataFrame([(s,) for s in subjects], "s string").select("s", refs.digit_prefixes(F.col("s")).alias("p"))
    for r in df.collect():
        for n in range(1, 400):
            assert (f"#{n}" in r.s) == (str(n) in r.p)


@pytest.mark.parametrize("names, scope", [(["tests/a.py"], "test"), (["d/x.c", "d/y.h"], "code"), (["a.rst", "b.md"], "docs"), (["debian/x", "a.spec"], "packaging"), (["a.c", "doc/x"], "mixed"), ([], "unknown"), (None, "unknown"), ([None], "unknown")])
def test_scope(spark, names, scope):
    assert one(spark, paths.evidence_scope(F.col("p")), p=("array<string>", names)) == scope


@pytest.mark.parametrize("path, name", [("bgpd/x.c", "bgpd"), ("internal/cli/x.go", "internal/cli"), ("src/x.c", "src"), ("./lib/a.c", "lib"), ("Makefile", "Makefile"), ("/abs/x", "(root)")])
def test_subsystem(spark, path, name):
    assert one(spark, paths.subsystem(F.col("p")), p=("string", path)) == name


@pytest.mark.parametrize("lines, band", [(0, "0"), (1, "1-10"), (10, "1-10"), (11, "11-50"), (50, "11-50"), (51, "51-200"), (200, "51-200"), (201, "201-1000"), (1000, "201-1000"), (1001, "1001+")])
def test_bands(spark, lines, band):
    assert one(spark, paths.size_band(F.col("n")), n=("bigint", lines)) == band


PRS = """record_id bigint, repository string, number bigint, merged_at timestamp, observation_end timestamp, merge_commit_sha string, head_sha string, commit_shas array<string>,
changed_files array<struct<path:string,additions:bigint,deletions:bigint>>, changed_functions array<string>, changed_function_locations array<struct<path:string,function:string>>"""
T = lambda d: datetime(2024, 3, d)


def request(i, **kw):
    base = dict(record_id=i, repository="r", number=i, merged_at=T(1), observation_end=None, merge_commit_sha=f"abcdef{i:034d}", head_sha=None, commit_shas=None, changed_files=None, changed_functions=None, changed_function_locations=None)
    return tuple((base | kw).values())


def commits(spark, *rows):
    return spark.createDataFrame([("r", f"{k:040d}", T(day), text.split("\n")[0], text) for k, (day, text) in enumerate(rows)], "repository string, sha string, author_date timestamp, subject string, full_message string")


def test_strong_signals_and_rank(spark):
    prs = spark.createDataFrame([request(14000), request(1234, observation_end=T(20))], PRS)
    log = commits(
        spark,
        (6, f"x\n\nFixes: abcdef{0:06d}"), (16, "Regression introduced in #14000"), (1, "Fixes #14000"), (7, 'Revert "y (#12345)"'), (25, "Fixes #1234"), (8, "Fixes: abcdef\nFixes: abcdef0"), (9, "nothing to see"),
    )
    got = {(r.record_id, r.signal_type) for r in correlate.strong(log, prs).collect()}
    assert got == {(14000, "FIXES_SHA"), (14000, "REGRESSION_MENTION"), (1234, "FIXES_SHA"), (1234, "EXPLICIT_REVERT")}
    none = spark.createDataFrame([], "record_id bigint, sha string")
    ranks = {r.record_id: r.rank_score for r in correlate.rank(prs, correlate.strong(log, prs), none, none.select("record_id")).collect()}
    assert ranks == {14000: 1.0, 1234: 1.0}
    empty = {r.record_id: r.rank_score for r in correlate.rank(prs, none, none, none.select("record_id")).collect()}
    assert empty == {14000: 0.0, 1234: 0.0}


def test_medium_and_weak_signals(spark):
    loc = lambda p, f: {"path": p, "function": f}
    file = lambda p: {"path": p, "additions": 1, "deletions": 0}
    prs = spark.createDataFrame([request(1, changed_function_locations=[loc("a.c", "go"), None, loc("", "x")], changed_files=[file("a.c"), file("0.c"), None], merged_at=T(1)), request(2, changed_functions=["long_name", "abc"])], PRS)
    log = commits(spark, (5, "fix long_name"), (6, "tidy"), (7, "fix other"))
    symbols = spark.createDataFrame([("r", f"{k:040d}", p, f) for k, p, f in [(0, "a.c", "go"), (0, "b.c", "go"), (1, "a.c", "go"), (2, "a.c", "stop")]], "repository string, sha string, path string, function string")
    assert [(r.record_id, r.function_or_path) for r in correlate.same_function(log, symbols, prs).collect()] == [(1, "a.c:go")]
    touched = spark.createDataFrame([("r", f"{k:040d}", p) for k, p in [(0, "a.c"), (0, "0.c"), (1, "a.c")]], "repository string, sha string, path string")
    assert [(r.record_id, r.path) for r in correlate.same_file(log, touched, prs).collect()] == [(1, "0.c")]
    assert [(r.record_id, r.function) for r in correlate.legacy_names(log, prs, touched).collect()] == [(2, "long_name")]
    # Inside a longer word, for a merge and for an unknown diff also with locations, each commit once though delivered twice.
    prs = spark.createDataFrame([request(3, changed_functions=["walk_peer", "tiny"], changed_function_locations=[loc("a.c", "walk_peer")])], PRS)
    rows = [("r", k * 40, T(9), "fix it", text, parents, i) for i, (k, text, parents) in enumerate([("a", "in rib_walk_peer_all()", ["p"]), ("b", "walk_peer", ["p", "q"]), ("c", "walk_peer", ["p"]), ("d", "walk peer", ["p"]), ("c", "walk_peer", ["p"])])]
    log = spark.createDataFrame(rows, "repository string, sha string, author_date timestamp, subject string, full_message string, parents array<string>, log_idx bigint")
    seen = spark.createDataFrame([("r", k * 40, "z") for k in "bc"], "repository string, sha string, path string")
    assert sorted(r.sha[0] for r in correlate.legacy_names(log, prs, seen).collect()) == ["a", "b"]
    symbols = spark.createDataFrame([("r", k * 40, "a.c", "walk_peer") for k in "bc"], "repository string, sha string, path string, function string")
    assert [r.sha[0] for r in correlate.same_function(log, symbols, prs).collect()] == ["c"]
    # Two commits with one patch are one lead.
    lead = spark.createDataFrame([(3, "a"), (3, "b"), (3, "c")], "record_id bigint, sha string")
    patches = spark.createDataFrame([(3, "a", "p1"), (3, "b", "p1"), (3, "c", "")], "record_id bigint, sha string, patch string")
    assert correlate.rank(prs, lead, lead, lead.select("record_id"), patches).select("strong_leads", "medium_leads").first() == (2, 2)


def test_rules_fold_in_order(spark):
    r = rules.RuleSet((rules.PathRule("p", "^bgpd/", 0.35),), (rules.KeywordRule("k", "(?i)fsm", 0.3, ("diff_symbols", "pr_title")), rules.KeywordRule("t", "timer", 0.25, ("diff_symbols", "unknown"))))
    ddl = "title string, body string, changed_files array<struct<path:string>>, changed_functions array<string>, commit_messages array<string>"
    df = spark.createDataFrame([("t", None, [("bgpd/x.c",)], ["bgp_fsm_change", "a_timer"], None), ("docs", None, [("doc/x",)], None, [None]), (None, None, None, None, None)], ddl)
    a, b, c = rules.evaluate(df, r).select("raw_points", "category", "explanation", rules.matched_symbols(r).alias("s")).collect()
    assert (a.raw_points, a.category, a.explanation, a.s) == ((0.35 + 0.3) + 0.25, "HIGH", "path:p (+0.35), symbol:k (+0.30), symbol:t (+0.25)", ["a_timer", "bgp_fsm_change"])
    assert (b.raw_points, b.category, b.explanation) == (0.0, "LOW", rules.NO_MATCH) and c.category == "LOW"


def test_percentile_and_tercile(spark):
    df = spark.createDataFrame([("g", float(x)) for x in (1, 2, 2, 5)] + [("h", 0.9)] * 3 + [("h", 0.2), ("h", 0.5), ("h", 0.5), ("h", None)], "g string, x double")
    out = ranking.below_and_equal(df, ["g"], "x", F.floor("x")).select("g", "x", ranking.midrank_percentile().alias("p"), ranking.tercile().alias("t")).collect()
    assert {(r.x): r.p for r in out if r.g == "g"} == {1.0: 0.125, 2.0: 0.5, 5.0: 0.875}
    assert {(r.x): r.t for r in out if r.g == "h"} == {0.2: 1, 0.5: 1, 0.9: 2}


def test_islands(spark):
    df = spark.createDataFrame([("g", n) for n in (1, 2, 3, 10, 11, 20, 20, 0, -5, None)], "g string, n bigint")
    assert sorted((r["first"], r["last"]) for r in ranking.islands(df, ["g"], "n", chunk_size=4).collect()) == [(1, 3), (10, 11), (20, 20)]


def test_numstat(spark):
    text = "junk line\n10\t2\tbgpd/bgpd.c\r\n-\t-\tbinary/blob.bin\n0\t20\ta b.c\n45 0 new.c\nx\t1\ty\n\n"
    got = one(spark, diffs.numstat(F.col("t")), t=("string", text))
    assert [(f.path, f.status, f.additions, f.deletions) for f in got] == [("a b.c", "deleted", 0, 20), ("bgpd/bgpd.c", "modified", 10, 2), ("binary/blob.bin", "modified", 0, 0), ("new.c", "added", 45, 0)]


DIFF = """diff --git a/x/a.c b/x/a.c
--- a/x/a.c
+++ b/x/a.c
@@ -10,4 +10,8 @@ static int bgp_stop(struct peer *p)
 context
-	old_call(p);
+	bgp_call(p);
+int bgp_peer_restart(struct peer *peer)
+{
+	return 1;
+}
+int proto(void);
diff --git a/y.py b/y.py
--- a/y.py
+++ b/y.py
@@ -1 +1 @@ def nothing(
-a
+b
"""


@pytest.mark.parametrize(
    "lines, name",
    [
        (["int foo_bar(int a)", "{"], "foo_bar"), (["static void *make_it(void) {"], "make_it"), (["int proto(void);"], ""), (["x = call(y)"], ""), (["if (go(x))", "{"], ""), (["return go(x)", "{"], ""),
        (["int late(int a,", "         int b)", "{"], "late"), (["int gone(void)", "x();", "{"], ""), (["int far(void)", "", "", "", "{"], ""), (["DEFUN(show_it)", "{"], ""), (["int main(void)", "{"], ""),
    ],
)
def test_added_definitions(lines, name):
    diff = "--- a/x.c\n+++ b/x.c\n@@ -1,0 +1,9 @@\n" + "\n".join("+" + x for x in lines) + "\n"
    assert diffs.symbols(diff) == ([("x.c", name)] if name else [])


def test_diff_walk_and_symbols(spark):
    assert diffs.symbols(DIFF) == [("x/a.c", "bgp_peer_restart"), ("x/a.c", "bgp_stop")]
    df = spark.createDataFrame([("s", DIFF), ("n", None), ("e", "")], "sha string, raw_diff string")
    removed = [(r.path, r.line, r.content) for r in diffs.diff_lines(df).where("kind = '-'").collect()]
    assert removed == [("x/a.c", 11, "\told_call(p);"), ("y.py", 1, "a")]
    assert diffs.diff_symbols(df).count() == 2


@pytest.mark.parametrize("line, kept", [("  int a = 10;  ", "int a = 10;"), ("{", None), ("};", None), ("// x y", None), ("/* x */", None), ("*ptr = 1;", None), ("a;", None), ("é;", "é;"), ("", None), (None, None)])
def test_substantive(spark, line, kept):
    assert one(spark, diffs.substantive(F.col("l")), l=("string", line)) == kept


def test_reversal(spark):
    ddl = "key string, kind string, path string, content string"
    original = spark.createDataFrame([("k", "+", "a.c", "line one;"), ("k", "+", "a.c", "line two;"), ("k", "-", "b.c", "gone now;")], ddl)
    later = spark.createDataFrame([("k", "-", "a.c", " line one;"), ("k", "-", "a.c", "line two;"), ("k", "-", "a.c", "line two;")], ddl)
    proof = spark.createDataFrame([("k", "a.c", "line one;")], "key string, path string, content string")
    r = diffs.reversal(original, later, proof, ["key"]).first()
    assert (r.added, r.removed, r.removed_again, r.added_again, r.supported, r.reversal_type) == (2, 1, 2, 0, 1, "partial_candidate") and abs(r.fraction - 2 / 3) < 1e-12
    patches = spark.createDataFrame([("k", "p", "p"), ("l", "q", "q"), ("m", "", "")], "key string, original_patch string, reverse_patch string")
    whole = {x.key: (x.reversal_type, x.added) for x in diffs.reversal(original, later, proof, ["key"], patches).collect()}
    assert whole == {"k": ("full", 2), "l": ("full", 0)}


def brute_pairs(cands, fallback):
    used, out = set(), set()
    cat = lambda c: matching.CATEGORY_RANK.get(c["category"], 0)
    band = lambda c: ([*matching.BAND_ORDER, "1001+"]).index(c["size_band"])
    for p in sorted((c for c in cands if c["is_positive"]), key=lambda c: c["number"]):
        free = [c for c in cands if not c["is_positive"] and c["number"] not in used and c["subsystem"] == p["subsystem"]]
        close = lambda c: (abs(c["score"] - p["score"]), abs(c["changed_lines"] - p["changed_lines"]), c["number"])
        full = [c for c in free if c["category"] == p["category"] and c["size_band"] == p["size_band"]]
        best = min(full, key=close) if full else min(free, key=lambda c: (abs(cat(c) - cat(p)), abs(band(c) - band(p)), *close(c))) if free and fallback else None
        if best:
            used.add(best["number"])
            out.add((p["number"], best["number"], not full))
    return out


@pytest.mark.parametrize("fallback", [False, True])
def test_pairs_against_brute_force(spark, fallback):
    rng = random.Random(3)
    cands = [dict(repository="r", number=n, is_positive=rng.random() < 0.4, score=rng.choice([0.1, 0.4, 0.9]), changed_lines=rng.choice([1, 5, 60]), category=rng.choice(["HIGH", "LOW"]), subsystem=rng.choice("ab"), size_band=rng.choice(["1-10", "51-200"])) for n in range(40)]
    got = {(r.positive, r.negative, r.relaxed) for r in matching.pairs(spark.createDataFrame(pd.DataFrame(cands)), fallback=fallback).collect()}
    assert got == brute_pairs(cands, fallback)
    with pytest.raises(ValueError):
        matching.cell_key(["colour"])


def test_merging(spark):
    base = spark.createDataFrame([(1, "none"), (2, "weak"), (3, "none"), (4, "none")], "k int, class string")
    subset = spark.createDataFrame([(1, "weak"), (2, "medium"), (3, "none")], "k int, class string")
    moves = merging.transitions(base, subset, ["k"], "class")
    assert tuple(merging.flip_report(moves).first()) == (3, 1, 2, 1)
    assert tuple(merging.flip_report(moves.limit(0)).first()) == (0, 0, 0, 0)
    assert sorted(tuple(r) for r in merging.replace_by_key(base, subset, ["k"]).collect()) == [(1, "weak"), (2, "medium"), (3, "none"), (4, "none")]
    assert merging.strangers(base, subset, ["k"]).count() == 0
    rows = spark.createDataFrame([("g", n) for n in range(125)], "g string, n bigint")
    numbered = merging.batches(rows, ["g"], "n", size=50, chunk=40)
    assert [(r.batch, r["count"]) for r in numbered.groupBy("batch").count().orderBy("batch").collect()] == [(0, 50), (1, 50), (2, 25)]
    assert merging.unfinished(numbered, spark.createDataFrame([(0,), (1,)], "batch bigint")).count() == 25


def test_digest_ignores_order(spark):
    rows = [("g", f"{i:02x}{i}") for i in range(50)]
    a, b = (records.two_level_digest(spark.createDataFrame(x, "g string, h string"), ["g"], "h").first() for x in (rows, rows[::-1]))
    assert a == b and a.n == 50


def test_exposure(spark):
    for end, days in ((datetime(2024, 8, 28), 180), (datetime(2024, 8, 27, 23), 179), (datetime(2024, 2, 1), None), (None, None)):
        assert one(spark, records.exposure(F.col("m"), F.col("e")), m=("timestamp", T(1)), e=("timestamp", end)) == days


def test_prefix_blocking_is_exact(spark):
    rng = random.Random(4)
    digits = lambda n: "".join(rng.choice("ab") for _ in range(n))
    named, held = [digits(rng.randint(6, 9)) for _ in range(40)], [digits(rng.randint(6, 9)) for _ in range(40)]
    for a, b in itertools.product(named, held):
        assert (a.startswith(b) or b.startswith(a)) == (a[:6] == b[:6] and (a.startswith(b) or b.startswith(a)))
