"""Problem 6: exact byte-pair encoding by dynamic programming over prefixes.

For every prefix of a piece there is one encoding, so one last token. Candidates for a
prefix's last token are the vocabulary entries that end there, found by an automaton over the
piece's bytes. A candidate is right if the prefix before it ends in a token with which it is
compatible, that is, if merging would leave the border between the two alone. The unique last
token of each prefix is stored with its back-pointer; following the pointers from the end
gives the ids. Time is linear in the piece, also for scripts without blanks.

Defined results: null and empty texts have no ids (an empty array).
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from changelode.plans.spread import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the public vocabulary's rule for cutting a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEEP = 200_000
LAST = sys.maxsize


def byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in plain)
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """An encoder for one byte-level vocabulary, given as the text of its JSON file."""

    def __init__(self, vocabulary: str) -> None:
        model = json.loads(vocabulary)["model"]
        letters = byte_letters()
        raw = {t: "".join(chr(letters[c]) for c in t) for t in model["vocab"] if all(c in letters for c in t)}
        self.id = {raw[t]: i for t, i in model["vocab"].items() if t in raw}
        self.pair: dict[tuple[int, int], int] = {}  # two ids -> the time at which they merge
        self.born: dict[int, int] = {}  # id -> that time
        half: dict[int, tuple[int, int]] = {}
        for time, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, whole = self.id[raw[a]], self.id[raw[b]], self.id[raw[a] + raw[b]]
            self.pair[left, right] = time
            if whole not in half:
                half[whole], self.born[whole] = (left, right), time
        self.right_edge = {t: self._edge(t, half, 1) for t in self.id.values()}
        self.left_edge = {t: self._edge(t, half, 0) for t in self.id.values()}
        self.ends = ahocorasick.Automaton()
        for text, i in self.id.items():
            if len(text) == 1 or i in half:
                self.ends.add_word(text, (i, len(text)))
        self.ends.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(PIECES).findall

    def _edge(self, token: int, half: dict[int, tuple[int, int]], side: int) -> list[tuple[int, int]]:
        """The parts of a token at one border, each with the time it is absorbed into the next."""
        out, until = [(token, LAST)], token
        while until in half:
            part = half[until][side]
            out.append((part, self.born[until]))
            until = part
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves the border between ``a`` and ``b`` alone.

        A merge over the border happens if its time comes while both its parts stand there.
        At equal times the one further left goes first: the left part is then already absorbed,
        the right part is not yet.
        """
        if (got := self.fits.get((a, b))) is None:
            if len(self.fits) > 10 * KEEP:
                self.fits.clear()
            got = self.fits[a, b] = not any(
                (time := self.pair.get((x, y))) is not None and time < until_x and time <= until_y for x, until_x in self.right_edge[a] for y, until_y in self.left_edge[b]
            )
        return got

    def piece(self, text: str) -> tuple[int, ...]:
        data = text.encode().decode("latin-1")
        if (whole := self.id.get(data)) is not None and len(data) == 1:
            return (whole,)
        last, back = [-1] * (len(data) + 1), [0] * (len(data) + 1)
        for end, (token, length) in self.ends.iter(data):
            end += 1
            if last[end] < 0 and ((before := end - length) == 0 or (last[before] >= 0 and self.compatible(last[before], token))):
                last[end], back[end] = token, before
        out, at = [], len(data)
        while at:
            out.append(last[at])
            at = back[at]
        return tuple(reversed(out))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known = self.known
        for p in self.split(text):
            if (ids := known.get(p)) is None:
                if len(known) > KEEP:
                    known.clear()
                ids = self.piece(p)
                if len(p) < 200:
                    known[p] = ids
            out += ids
        return out


_ENCODERS: dict[int, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One encoder a worker process and vocabulary."""
    key = hash(vocabulary)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


def encode(documents: DataFrame, path: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids): one row for each row of ``documents``, in one pass without a shuffle.

    The vocabulary, a file of fixed size, is read once and sent to the workers.
    """
    shared = documents.sparkSession.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                ids = [enc.encode(t) for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.fromiter((i for x in ids for i in x), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[id_column, "ids"])

    return spread(documents.select(id_column, text_column), id_column).mapInArrow(run, f"{id_column} bigint, ids array<int>")


def count_tokens(documents: DataFrame, path: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens): the number of ids of each text; 0 for null and empty texts."""
    shared = documents.sparkSession.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for b in batches:
            n = pa.array([len(enc.encode(t)) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n], names=[id_column, "n_tokens"])

    return spread(documents.select(id_column, text_column), id_column).mapInArrow(run, f"{id_column} bigint, n_tokens bigint")
