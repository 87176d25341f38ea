import random
from collections import Counter, defaultdict

from changelode.llm import packing
from pyspark.sql import functions as F


def brute(sizes, capacity):
    """Best fit, largest first, one item at a time."""
    gaps = []
    for s in sorted((x for n in sizes for x in [capacity] * (n // capacity) + [n % capacity] if x), reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


def check(rows, sizes, capacities):
    load, pieces = defaultdict(int), defaultdict(list)
    for r in rows:
        load[r.window_id, r.container_id] += r.n_tokens
        pieces[r.window_id, r.doc_id].append((r.piece, r.start_token, r.n_tokens))
    for w, capacity in capacities.items():
        assert all(0 <= used <= capacity for (x, _), used in load.items() if x == w)
        for doc, n in sizes:
            got = sorted(pieces[w, doc])
            assert sum(p[2] for p in got) == n and [p[0] for p in got] == list(range(1, len(got) + 1))
            assert len(got) == max(1, -(-n // capacity))
            assert [p[1] for p in got] == [capacity * i for i in range(len(got))]
    return {w: len({c for (x, c), used in load.items() if x == w and used}) for w in capacities}


def test_as_tight_as_one_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 20)  # several groups a size
    monkeypatch.setattr(packing, "BLOCK", 16)
    rng = random.Random(9)
    sizes = [(i, rng.choice([0, 1, 1, 1, rng.randint(1, 40), rng.randint(1, 130)])) for i in range(600)]
    windows = {1: 32, 2: 50, 3: 100}
    df = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint").withColumn("piece", F.lit("clash")).withColumn("rank", F.lit(0))
    win = spark.createDataFrame([*windows.items(), (4, None), (5, 0), (1, 32)], "window_id bigint, capacity_tokens bigint")
    rows = packing.pack(df, win).collect()
    used = check(rows, sizes, windows)
    assert used == {w: brute([n for _, n in sizes], c) for w, c in windows.items()}
    report = {r.window_id: r for r in packing.fill_report(packing.pack(df, win), win).collect()}
    assert all(report[w].fullest <= c and report[w].least <= report[w].containers for w, c in windows.items())


def test_windows_in_groups_and_large_plans(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_WINDOWS", 1)
    monkeypatch.setattr(packing, "SENT", 0)
    sizes = [(i, i % 23) for i in range(200)]
    df = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint")
    win = spark.createDataFrame([(1, 32), (2, 10), (2, 50), (3, 5_000_000)], "window_id bigint, capacity_tokens bigint")
    windows = {1: 32, 2: 50, 3: 5_000_000}
    assert len(list(packing.capacities(win))) >= 2
    assert check(packing.pack(df, win).collect(), sizes, windows) == {w: brute([n for _, n in sizes], c) for w, c in windows.items()}


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    win = spark.createDataFrame([(1, 10)], "window_id bigint, capacity_tokens bigint")
    assert packing.pack(empty, win).count() == 0
    assert packing.pack(empty, win.limit(0)).count() == 0
    zeros = spark.createDataFrame([(1, 0), (2, 0)], "doc_id bigint, n_tokens bigint")
    assert [(r.doc_id, r.n_tokens, r.container_id) for r in packing.pack(zeros, win).orderBy("doc_id").collect()] == [(1, 0, 1), (2, 0, 1)]
    same = spark.createDataFrame([(i, 5) for i in range(101)], "doc_id bigint, n_tokens bigint")
    assert sorted(Counter(r.container_id for r in packing.pack(same, win).collect()).values()) == [1] + [2] * 50
