import random
from datetime import datetime, timedelta, timezone

from changelode.functions.times import parse_time
from changelode.operators import asof
from pyspark.sql import functions as F

T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)


def day(n):
    return None if n is None else T0 + timedelta(hours=6 * n)


def brute(edits, cases, decisions):
    out = set()
    squeeze = lambda s: None if s is None else "".join(s.split())
    for case, repo, pr, text, cut in cases:
        if cut is None:
            continue
        own = [e for e in edits if e[1] == repo and e[2] == pr and e[4] is not None]
        known = [e for e in own if e[4] <= cut and e[3] is not None and e[3] <= cut and (e[5] is None or e[5] > cut)]
        held = max(known, key=lambda e: (e[4], e[0])) if known else None
        if held:
            out.add((case, "version", held[0]))
        if text is not None and not (held and squeeze(held[6]) == squeeze(text)):
            late = [e[0] for e in own if squeeze(e[6]) == squeeze(text) and (e[4] > cut or (e[3] is not None and e[3] > cut))]
            if late:
                out.add((case, "description_leak", min(late)))
        out |= {(case, "decision_leak", d[0]) for d in decisions if d[1] == case and d[2] and d[3] is not None and d[3] > cut}
    return out


def test_against_brute_force(spark):
    rng = random.Random(11)
    n = lambda: rng.choice([None, *range(12)] if rng.random() < 0.2 else range(12))
    edits = [(i, "r", rng.choice([1, 1, 1, 2]), day(n()), day(n()), day(rng.choice([None, None, n()])), rng.choice(["a b", "ab", "c", None, ""])) for i in range(80)]
    cases = [(f"c{i}", "r", rng.choice([1, 2, 3]), rng.choice(["a  b", "c", None, "", "zz"]), day(n())) for i in range(60)]
    decisions = [(i, f"c{rng.randrange(60)}", rng.choice([True, False, None]), day(n())) for i in range(60)]
    text = lambda t: None if t is None else t.strftime("%Y-%m-%dT%H:%M:%SZ")
    e = spark.createDataFrame(edits + edits[:7], "edit_id bigint, repository string, pr bigint, created_at timestamp, edited_at timestamp, deleted_at timestamp, diff string").withColumn("number", F.lit(1))
    c = spark.createDataFrame([(a, b, p, d, text(t)) for a, b, p, d, t in cases] * 2, "case_id string, repository string, pr bigint, description string, cutoff_timestamp string").withColumn("rank", F.lit("x"))
    d = spark.createDataFrame([(i, k, inc, text(t)) for i, k, inc, t in decisions] + [(decisions[0][0], decisions[0][1], decisions[0][2], text(decisions[0][3]))], "decision_id bigint, case_id string, included boolean, valid_at string")
    got = [tuple(r) for r in asof.known_at_cutoff(e, c, d).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(edits, cases, decisions)
    assert asof.known_at_cutoff(e.limit(0), c, d).where("kind = 'version'").count() == 0
    assert asof.known_at_cutoff(e, c.limit(0), d).count() == 0
    texts = {r.case_id: r.text for r in asof.described_as_known(e, c).collect()}
    assert set(texts) == {k for k, *_, t in cases if t is not None}


def test_dyadic_cover(spark):
    rows = [(s, e) for s in range(0, 20) for e in range(s, 40, 3)]
    got = spark.createDataFrame(rows, "s bigint, e bigint").select("s", "e", asof.dyadic_cover(F.col("s"), F.col("e")).alias("n")).collect()
    for r in got:
        covered = sorted(x for node in r.n for x in range(node["index"] << node["level"], (node["index"] + 1) << node["level"]))
        assert covered == list(range(r.s, r.e))


def test_times(spark):
    texts = ["2025-06-17T11:32:49-03:00", "2025-06-17 14:32:49+0000", "2025-06-17T14:32:49.000000000Z", "2025-06-17T14:32:49", " 2025-06-17T16:32:49+02 ", "soon", None, ""]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "x string").select(parse_time(F.col("x")).cast("string").alias("t")).collect()]
    assert got == ["2025-06-17 14:32:49"] * 5 + [None] * 3
