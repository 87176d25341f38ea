import random

import numpy as np
import pandas as pd

from changelode.llm import leak

WORDS = [f"w{i}" for i in range(300)]


def test_suffix_array():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 400):
        text = rng.integers(-1, 3, n).astype(np.int32)
        order = leak.suffix_array(text, 64)
        key = lambda i: [(x, 0) if x >= 0 else (-1, i + k) for k, x in enumerate(text[i : i + 64])]
        assert sorted(order) == list(range(n))
        plain = [tuple(text[i : i + 64]) for i in order]
        cut = [p[: next((k for k, x in enumerate(p) if x < 0), len(p))] for p in plain]
        assert all(a[: min(len(a), len(b))] <= b[: min(len(a), len(b))] for a, b in zip(cut, cut[1:]))
        assert key(0)


def test_matches_equal_brute_force():
    rng = random.Random(3)
    items = leak.Items([(i, " ".join(rng.choice("abc") for _ in range(12)), None) for i in range(3)])
    text = np.array([rng.choice([*items.number.values(), -1]) for _ in range(200)], np.int32)
    p, q, n = leak.matches(text, items)
    got = set(zip(p.tolist(), q.tolist(), n.tolist()))
    want = set()
    for a in range(len(text)):
        for b in range(len(items.text)):
            if items.text[b] < 0 or (a and b and items.text[b - 1] >= 0 and text[a - 1] == items.text[b - 1]):
                continue
            k = 0
            while a + k < len(text) and items.text[b + k] >= 0 and text[a + k] == items.text[b + k]:
                k += 1
            if k >= leak.SEED:
                want.add((a, b, k))
    assert got == want


def test_repeated_trigrams_do_not_break_a_passage():
    # Document and item repeat phrases, so very many short matches lie between true neighbours.
    rng = random.Random(8)
    phrase = "see the log".split()
    w = [x for i in range(60) for x in (f"k{i}", *phrase)]
    doc = [x for i, x in enumerate(w[:160])  if i % 19 != 4]
    noise = phrase * 80
    text = np.array([], np.int32)
    items = leak.Items([(1, " ".join(w), None)])
    text = np.array([items.number.get(x, -1) for x in noise[:60] + doc + noise], np.int32)
    p, q, n = leak.matches(text, items)
    got = leak.passages(p, q, n)
    assert got.span >= 150 and got.matched >= 120

    def brute(p, q, n):  # every chain against every earlier one
        order = sorted(range(len(p)), key=lambda i: (p[i], q[i]))
        best, top = {}, 0
        for i in order:
            best[i] = max([(float(n[i]), q[i])] + [
                (best[j][0] + n[i] - over - 0.1 * abs((p[i] - p[j]) - (q[i] - q[j])), best[j][1]) for j in best
                if q[j] < q[i] and p[j] < p[i] and p[i] - p[j] - n[j] <= leak.REACH and q[i] - q[j] - n[j] <= leak.REACH and (over := max(0, p[j] + n[j] - p[i], q[j] + n[j] - q[i])) < n[i]
            ], key=lambda t: t[0])
            span = q[i] + n[i] - best[i][1]
            if best[i][0] >= leak.DENSE * span:
                top = max(top, span)
        return top

    assert brute(p.tolist(), q.tolist(), n.tolist()) == got.span
    assert rng


def test_blocks_find_what_one_search_finds(monkeypatch):
    rng = random.Random(9)
    items = [(i, " ".join(item(rng, 40)), None) for i in range(5)]
    docs = [" ".join([*item(rng, 10), *body.split()[5:30], *item(rng, 10)]) for _, body, _ in items] * 2
    whole = found(docs, items)
    monkeypatch.setattr(leak, "BLOCK_PAIRS", 7)
    assert found(docs, items) == whole and len(whole) == 10


def test_locations_equal_find():
    rng = random.Random(10)
    w = item(rng)
    passage = " ".join(w[10:60])
    docs = [f"Intro, here: {passage}. The end", f"> quoted\n> é\u200bx <b>{passage.upper()}</b> end", f"long-\nword ﬁne {passage}"]
    rows = list(leak._leaks(pd.DataFrame({"doc_id": range(3), "text": docs}), leak.Items([(1, " ".join(w), None)])))
    assert [(r[0], r[1], r[6]) for r in rows] == [(0, 1, 10), (1, 1, 10), (2, 1, 10)]
    for r, text in zip(rows, docs):
        at = text.lower().find(passage)
        assert (r[4] - 1, r[5]) == (at, at + len(passage))
    sha = "0123456789abcdef0123456789abcdef01234567"
    assert [r[4:6] for r in leak._leaks(pd.DataFrame({"doc_id": [1], "text": [f"see {sha} and {sha}"]}), leak.Items([(1, None, [sha])]))] == [(5, 44)]


def item(rng, n=100):
    return [rng.choice(WORDS) for _ in range(n)]


def found(docs, items):
    return {(d, i) for d, i, *_ in leak._leaks(pd.DataFrame({"doc_id": range(len(docs)), "text": docs}), leak.Items(items))}


def test_passages():
    rng = random.Random(4)
    w = item(rng)
    noisy = [x for i, x in enumerate(w[20:75]) for x in ([] if i % 13 == 5 else [x.upper(), "put"] if i % 11 == 3 else ["other"] if i % 9 == 7 else [f"**{x}**"])]
    wrapped = "> " + "\n> ".join(" ".join(noisy[i : i + 6]) for i in range(0, len(noisy), 6))
    parts = " ".join(w[:12]) + " filler" * 60 + " " + " ".join(w[50:62])
    docs = ["intro " + wrapped + " outro", " ".join(w), " ".join(w[:26]), " ".join(w[:9]), parts, " ".join(sorted(w)), None, "", "\n".join(x[:1] + "\u200b" + x[1:] for x in w)]
    assert found(docs, [(7, " ".join(w), None), (8, None, None), (9, "", [])]) == {(0, 7), (1, 7), (2, 7), (8, 7)}


def test_characters_without_blanks():
    rng = random.Random(5)
    w = "".join(chr(0x4E00 + rng.randrange(500)) for _ in range(120))
    assert found([w[30:70], w[:8], "前文" + w[:20] + "，" + w[20:40]], [(1, w, None)]) == {(0, 1), (2, 1)}


def test_commit_ids():
    sha = "0123456789abcdef0123456789abcdef01234567"
    docs = [f"see {sha}", f"({sha[:12].upper()})", f"{sha[:11]}", f"{sha[:13]}0000", f"x{sha[:12]}", f"{sha}00"]
    assert found(docs, [(1, None, [sha, None, "short"])]) == {(0, 1), (1, 1)}


def test_operator(spark, monkeypatch):
    rng = random.Random(6)
    w = " ".join(item(rng))
    docs = spark.createDataFrame([(1, w), (1, w), (2, w), (3, None), (4, "x" * 200000), (None, w), (2**60 + 1, w)], "doc_id bigint, text string").selectExpr("*", "1 AS item_id", "2 AS share")
    keys = spark.createDataFrame([(5, w, []), (5, w, []), (None, w, []), (6, None, None)], "item_id bigint, body string, fixing_shas array<string>")
    out = leak.leaks(docs, keys)
    assert sorted((r.doc_id, r.item_id, r.share) for r in out.collect()) == [(1, 5, 1.0), (2, 5, 1.0), (2**60 + 1, 5, 1.0)]
    assert sorted(r.doc_id for r in leak.without_leaks(docs, out).where("doc_id is not null").collect()) == [3, 4]
    monkeypatch.setattr(leak, "GROUP_ITEMS", 1)
    assert len(leak.held_out(keys)) == 2 and sorted((r.doc_id, r.item_id) for r in leak.leaks(docs, keys).collect()) == [(1, 5), (2, 5), (2**60 + 1, 5)]
    assert leak.leaks(docs.limit(0), keys).count() == 0 and leak.leaks(docs, keys.limit(0)).count() == 0
