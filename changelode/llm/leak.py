"""Problem 5: evaluation texts in training text, by suffix arrays over training shards.

A shard of documents becomes one sequence of word numbers (words of spaced scripts, single
characters of others; case, markup, line prefixes and layout do not count). Its suffix array is
built by prefix doubling. Every suffix of every held-out item is then searched in it, all at
once: binary search narrows the interval of training suffixes that share its first words, word
by word, until none shares one more. The suffixes that fall out of the interval at a step are
those whose match has just this length, so every place with its longest verbatim match comes
out of the search itself. Matches of one document and item that run along each other chain into
passages; words changed, lost or put in are the gaps of a chain. A document leaks an item whose
passage spans a quarter of the item; where it lies in the text is reported.

The held-out set travels to the shards, in groups of bounded size, never the other way round.
Shards are independent, so the training text is read once a group and not shuffled. Item
suffixes are searched in blocks, so that what is held is bounded however common a phrase is.

Defined results: null or empty texts and items, and rows without an id, match nothing; repeated rows count once;
identical documents are all reported, under their own ids.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelode.plans.durable import durable
from changelode.plans.spread import spread

GROUP_ITEMS = 50_000  # held-out items that are sent out together
GROUP_CHARS = 64_000_000  # and their characters
BLOCK_PAIRS = 4_000_000  # matches of a shard that are held at once
SEED = 3  # words that a match shares at least
REACH = 7  # words that a gap within a passage may have, on either side
QUARTER = 0.25
DENSE = 0.55  # share of a passage's words that match verbatim
LEAST = 8  # words that match verbatim in a passage: a phrase of a few words is no case
SHARD_WORDS = 1_000_000

_TOKEN = re.compile(
    r"[぀-ヿ㐀-䶿一-鿿豈-﫿฀-๿ກ-໿က-႟ក-៿]|[^\W_぀-ヿ㐀-䶿一-鿿豈-﫿฀-๿ກ-໿က-႟ក-៿]+"
)
_HEX = re.compile(r"(?<![0-9A-Za-z_])[0-9A-Fa-f]{12,64}(?![0-9A-Za-z_])")
_BROKEN = re.compile(r"(?<=[^\W\d_])(?:-)[ \t]*\r?\n[ \t>+|*#]*(?=[^\W\d_])")
_UNSEEN = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,80}>|&(?:nbsp|amp|quot|lt|gt);")


def words(text: str | None) -> list[str]:
    """The words of a text, without case, marks, markup and layout."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _UNSEEN.sub("", text))
    text = _TAG.sub(" ", text) if "<" in text or "&" in text else text
    return _TOKEN.findall(text.casefold())


class Items:
    """The held-out items as word numbers, all suffixes side by side, and their commit ids."""

    def __init__(self, rows: list[tuple[int, str | None, list[str] | None]]) -> None:
        self.number: dict[str, int] = {}
        self.ids: list[int] = []
        seqs: list[np.ndarray] = []
        self.commits: dict[str, list[tuple[str, int]]] = defaultdict(list)
        for item, body, shas in rows:
            for sha in shas or []:
                if sha and len(sha) >= 12:
                    self.commits[sha[:12].lower()].append((sha.lower(), item))
            if w := words(body):
                self.ids.append(item)
                seqs.append(np.array([self.number.setdefault(x, len(self.number)) for x in w], np.int32))
        self.length = np.array([len(s) for s in seqs], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length + 1)]) if seqs else np.zeros(1, np.int64)
        end = np.full(1, -2, np.int32)
        self.text = np.concatenate([x for s in seqs for x in (s, end)]) if seqs else np.zeros(0, np.int32)
        self.owner = np.repeat(np.arange(len(seqs)), self.length + 1) if seqs else np.zeros(0, np.int64)

    def commit_items(self, text: str) -> dict[int, tuple[int, int]]:
        """Items whose commit ids the text carries, with the first place of each."""
        out: dict[int, tuple[int, int]] = {}
        for m in _HEX.finditer(text):
            for sha, item in self.commits.get(m[0][:12].lower(), ()):
                if sha.startswith(m[0].lower()):
                    out.setdefault(item, m.span())
        return out


def suffix_array(text: np.ndarray, longest: int) -> np.ndarray:
    """Starts of all suffixes in the order of their first ``longest`` numbers, by prefix doubling.

    Negative numbers end a suffix: they differ from each other, so nothing matches across them.
    """
    n = len(text)
    rank = np.where(text < 0, -1 - np.arange(n), text).astype(np.int64)
    _, rank = np.unique(rank, return_inverse=True)
    order = np.argsort(rank, kind="stable")
    k = 1
    while k < longest:
        if rank[order[-1]] == n - 1 if n else True:
            break
        later = np.zeros(n, np.int64)
        later[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + later
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            break
        k *= 2
    return order


def narrow(text: np.ndarray, sa: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, want: np.ndarray, upper: bool) -> np.ndarray:
    """For each interval of ``sa`` the first place whose word at ``depth`` is at least (or, with ``upper``, above) ``want``."""
    lo, hi = lo.copy(), hi.copy()
    n = len(text)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        at = sa[np.minimum(mid, n - 1)] + depth
        value = np.where(at < n, text[np.minimum(at, n - 1)], -1)
        before = ((value <= want) if upper else (value < want)) & open_
        lo = np.where(before, mid + 1, lo)
        hi = np.where(open_ & ~before, mid, hi)


def matches(text: np.ndarray, items: Items, sa: np.ndarray | None = None, query: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place in the shard, in the items, and length of every verbatim match that no word before or behind extends.

    ``query``: places in the items to search from, all by default. Matches have SEED words at
    least. The interval of a suffix narrows from depth to depth; what falls out of it on either
    side at a depth matches exactly so far.
    """
    none = (np.zeros(0, np.int64),) * 3
    if not len(text) or not len(items.text):
        return none
    sa = suffix_array(text, int(items.length.max())) if sa is None else sa
    query = np.flatnonzero(items.text >= 0) if query is None else query
    lo, hi = np.zeros(len(query), np.int64), np.full(len(query), len(sa), np.int64)
    ranges: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []  # item place, from, to, length
    depth = 0
    while len(query):
        at = query + depth
        want = np.where(at < len(items.text), items.text[np.minimum(at, len(items.text) - 1)], -2)
        down, up = narrow(text, sa, lo, hi, depth, want, False), narrow(text, sa, lo, hi, depth, want, True)
        ends = want < 0  # the item is over: all that are left match exactly so far
        down, up = np.where(ends, hi, down), np.where(ends, hi, up)
        if depth >= SEED:
            ranges += [(query, lo, down, depth), (query, up, hi, depth)]
        found = (down < up) & ~ends
        query, lo, hi = query[found], down[found], up[found]
        depth += 1
    if not ranges:
        return none
    q, a, b = (np.concatenate([r[i] for r in ranges]) for i in range(3))
    n = np.concatenate([np.full(len(r[0]), r[3], np.int64) for r in ranges])
    size = b - a
    q, n = np.repeat(q, size), np.repeat(n, size)
    p = sa[np.repeat(a, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
    before = (p > 0) & (q > 0)
    left = before & (text[np.maximum(p - 1, 0)] == items.text[np.maximum(q - 1, 0)]) & (items.text[np.maximum(q - 1, 0)] >= 0)
    return p[~left], q[~left], n[~left]


def blocks(text: np.ndarray, sa: np.ndarray, items: Items) -> Iterator[np.ndarray]:
    """Places of whole items to search from, in blocks that match about BLOCK_PAIRS places of the shard."""
    query = np.flatnonzero(items.text >= 0)
    lo, hi = np.zeros(len(query), np.int64), np.full(len(query), len(sa), np.int64)
    for depth in range(SEED):
        at = query + depth
        want = np.where(at < len(items.text), items.text[np.minimum(at, len(items.text) - 1)], -2)
        lo, hi = np.where(want < 0, lo, narrow(text, sa, lo, hi, depth, want, False)), np.where(want < 0, lo, narrow(text, sa, lo, hi, depth, want, True))
    owner = items.owner[query]
    pairs = np.bincount(owner, weights=hi - lo, minlength=len(items.ids))
    block = (np.cumsum(pairs) // BLOCK_PAIRS).astype(np.int64)
    kept = hi > lo
    query, mine = query[kept], block[owner[kept]]
    for k in np.unique(mine):
        yield query[mine == k]


class Passage(NamedTuple):
    span: int = 0  # words of the item, first to last
    matched: int = 0  # of them verbatim
    first: int = 0  # place of the first word in the document
    last: int = 0  # place behind the last
    item_first: int = 0


def passages(p: np.ndarray, q: np.ndarray, length: np.ndarray) -> Passage:
    """The longest passage of one document and item.

    A chain takes matches in order whose distances on both sides stay within REACH; the span
    runs from its first to its last matched word in the item. A match looks at all chains that
    end within reach before it, however many there are.
    """
    order = np.lexsort((q, p))
    p, q, n = p[order].tolist(), q[order].tolist(), length[order].tolist()
    alive: list[tuple[int, int, int, int, float, int, int]] = []  # p, q, end in p, end in q, matched words, first q, first p
    top = Passage()
    for i in range(len(p)):
        a, b, k = p[i], q[i], n[i]
        score, first, begin = float(k), b, a
        alive = [c for c in alive if c[2] >= a - REACH]
        for cp, cq, cpe, cqe, matched, first_q, first_p in alive:
            if cq < b and cp < a and b - cqe <= REACH:
                over = max(0, cpe - a, cqe - b)
                if over < k:
                    s = matched + k - over - 0.1 * abs((a - cp) - (b - cq))
                    if s > score:
                        score, first, begin = s, first_q, first_p
        alive.append((a, b, a + k, b + k, score, first, begin))
        span = b + k - first
        if score >= DENSE * span and span > top.span:
            top = Passage(span, int(round(score)), begin, a + k, first)
    return top


def word_places(text: str) -> list[tuple[int, int]]:
    """(start, end) in ``text`` of each of its words as :func:`words` reads them, after joining broken lines.

    A word that normalising splits or joins takes the place of the run without blanks it stands in.
    """
    at = list(range(len(text) + 1))
    for pattern, new in ((_BROKEN, ""), (_UNSEEN, ""), (_TAG, " ")):
        out, places, done = [], [], 0
        for m in pattern.finditer(text):
            out += [text[done : m.start()], new]
            places += at[done : m.start()] + at[m.start() : m.start() + len(new)]
            done = m.end()
        if out:
            text, at = "".join([*out, text[done:]]), places + at[done:]
    found: list[tuple[int, int]] = []
    for run in re.finditer(r"\S+", text):
        plain = [m.span() for m in _TOKEN.finditer(run[0])]
        n = len(words(run[0]))
        here = plain if len(plain) == n else [(plain[0][0] if plain else 0, plain[-1][1] if plain else len(run[0]))] * n
        found += [(at[run.start() + a], at[run.start() + b - 1] + 1) for a, b in here]
    return found


COLUMNS = ["doc_id", "item_id", "share", "matched_words", "start_pos", "end_pos", "item_word"]


def _leaks(batch: pd.DataFrame, items: Items) -> Iterator[tuple[int, int, float, int, int, int, int]]:
    docs, texts, seqs, at = [], [], [], [0]
    for doc, text in zip(batch["doc_id"], batch["text"]):
        if not text:
            continue
        if items.commits:
            for item, (a, b) in items.commit_items(text).items():
                yield doc, item, 1.0, 0, a + 1, b, 0
        w = np.array([items.number.get(x, -1) for x in words(_BROKEN.sub("", text) if "\n" in text else text)], np.int32)
        if len(w) >= SEED:
            docs.append(doc)
            texts.append(text)
            seqs += [w, np.full(1, -1, np.int32)]
            at.append(at[-1] + len(w) + 1)
    if not docs or not items.ids:
        return
    text, starts = np.concatenate(seqs), np.array(at)
    sa = suffix_array(text, int(items.length.max()))
    for query in blocks(text, sa, items):
        p, q, n = matches(text, items, sa, query)
        doc = np.searchsorted(starts, p, side="right") - 1
        key = doc * len(items.ids) + items.owner[q]
        order = np.argsort(key, kind="stable")
        key, p, q, n = key[order], p[order], q[order], n[order]
        cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]) if len(key) else np.zeros(1, np.int64)
        total = np.add.reduceat(n, cuts[:-1]) if len(key) else []
        for a, b, words_matched in zip(cuts[:-1], cuts[1:], total):
            d, i = divmod(int(key[a]), len(items.ids))
            if words_matched < max(LEAST, DENSE * QUARTER * items.length[i]):  # cannot reach a passage
                continue
            found = passages(p[a:b] - starts[d], q[a:b] - items.start[i], n[a:b])
            if found.matched >= LEAST and found.span >= QUARTER * items.length[i]:
                places = word_places(texts[d])
                begin, end = (places[found.first][0], places[found.last - 1][1]) if found.last <= len(places) else (0, len(texts[d]))
                yield docs[d], items.ids[i], found.span / items.length[i], found.matched, begin + 1, end, found.item_first


def held_out(eval_keys: DataFrame) -> list[Items]:
    """The held-out items in groups of bounded size; one group is usual.

    A group is cut by item ids, collected apart, and holds about GROUP_ITEMS items or
    GROUP_CHARS characters at most, whatever the size of the set.
    """
    rows = durable(eval_keys.where("item_id is not null").select("item_id", "body", "fixing_shas").dropDuplicates(["item_id"]))
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("body")), F.lit(0))).first()
    groups = max(1, -(-n // GROUP_ITEMS), -(-chars // GROUP_CHARS))
    parts = [rows.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).collect() for g in range(groups)]
    return [Items(sorted(((r[0], r[1], r[2]) for r in part), key=lambda r: r[0])) for part in parts]


def leaks(documents: DataFrame, eval_keys: DataFrame) -> DataFrame:
    """(doc_id, item_id, share, matched_words, start_pos, end_pos, item_word): documents with the items they disclose.

    ``share`` is the part of the item that the passage spans, 1 for a commit id. The passage
    stands in the text from character ``start_pos`` to ``end_pos``, counted from 1, and begins
    with word ``item_word`` of the item, from 0. Of several, the largest share is reported.
    """

    def search(items: Items) -> DataFrame:
        shared = documents.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                size = b["text"].str.len().fillna(0).cumsum()
                for _, shard in b.groupby((size // (4 * SHARD_WORDS)).astype("int64")):
                    yield pd.DataFrame(_leaks(shard, shared.value), columns=COLUMNS)

        return spread(texts, "doc_id").mapInPandas(run, "doc_id bigint, item_id bigint, share double, matched_words bigint, start_pos bigint, end_pos bigint, item_word bigint")

    texts = documents.select("doc_id", "text").where("doc_id is not null and text is not null and text != ''")
    out = functools.reduce(DataFrame.unionByName, [search(items) for items in held_out(eval_keys)])
    best = F.max(F.struct("share", "matched_words", (-F.col("start_pos")).alias("before"), *COLUMNS[4:])).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", *[f"b.{c}" for c in COLUMNS[2:]])


def without_leaks(documents: DataFrame, found: DataFrame) -> DataFrame:
    """``documents`` less those that disclose an item."""
    return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
