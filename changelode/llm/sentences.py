"""Problem 8: sentence units across languages and scripts, by document-centred disambiguation.

A text is first cut into blocks by its layout: fenced code, headings, log lines, attribution
lines, trailers and list items are one unit each; what remains are paragraphs, whose lines are
joined without quoting marks while every character keeps its place in the text. In a paragraph
each terminator of the script at hand is a candidate. Most marks decide by themselves. A full
stop is decided by the word before it and what follows, in this order:

1. the document: unambiguous places elsewhere in it. A word that also stands small without a
   stop is an ordinary word; one whose stop is followed by a small word is an abbreviation; a
   next word that also stands small is no name, one that stands large inside a sentence and
   never small is a proper name;
2. the corpus, where the document is silent: how often the word's stop is followed by a small
   word, a digit, a common word or a name, and how often it closes a paragraph. Ordinary words
   do close paragraphs; titles and ``e.g.`` never do;
3. a short list of abbreviations, where the corpus has seen the word fewer than five times.

Texts are read once for the counts and once for the units. A stop that the document leaves open
leaves the scan as a narrow row with its word, which meets the corpus evidence in a join; so
evidence of any size works and nothing is collected: counted small evidence is sent to all
tasks, larger is shuffled.

Defined results: null and empty texts, and texts without letters and digits, have no units. A
run of more than 4,096 characters without a blank is no word, so a stop in it is judged by its
last 4,096 characters.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelode.plans.durable import durable
from changelode.plans.spread import spread

# ------------------------------------------- fixed values: words, the last resort

#: Abbreviations that something always follows.
LEADING = set("dr prof mr mrs ms st vs cf vgl bzw ca nr no fig vol pp e.g i.e z.b d.h т.е см рис mme sr sra".split())
#: Abbreviations after which a small word goes on.
TRAILING = set("etc ltd inc co usw u.s a.m p.m т.д al".split())
#: Words before a German ordinal, and those after one.
ARTICLES = set("im am der dem den des die das vom zum zur beim ab seit bis ein eine einem einen eines jeder jedem jeden dieser diesem pro je unser ihr sein".split())
MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember jänner".split())

# ------------------------------------------------------------------------ layout

_FENCE = re.compile(r"^[\s\ufeff]*((?:>+\s?|\+\s)*)\s*(`{3,}|~{3,})")
_QUOTE = re.compile(r"^[\s\ufeff]*(?:(?:>+|\|(?=\s)|\+(?=\s))[ \t]?)+")
_HEADING = re.compile(r"^\s*#{1,6}\s+\S")
_RULE = re.compile(r"^\s*(?:=+|-{3,}|\*{3,}|_{3,}|~+)\s*$")
_ITEM = re.compile(r"^\s*(?:[-*•·‣–◦]|\(?\d{1,3}[.)]|\(?[a-z][.)])[ \t\u3000]+\S")
_LOG = re.compile(
    r"^\s*(?:\d{4}-\w{1,2}-\w{1,2}\S*(?:\s+[\d:.,]+\S*)?\s+\[|(?:TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERR|ERROR|CRIT|FATAL)\b:?\s+\S+|[\w.-]+\[\d+\]:\s|kernel:\s|\[\s*\d+\.\d+\]\s|[A-Z][a-z]{2}\s+\d+\s\d\d:\d\d:\d\d\s|\d\d:\d\d:\d\d[.,\d]*\s+\S)"
)
_ATTRIBUTION = re.compile(r"^\s*(?:On|Am|Le|El|Em|Il|Op|Den|В|Στις|\d).{4,160}\b(?:wrote|writes|schrieb|a écrit|écrit|escribió|написал\w*|пишет|έγραψε)\s*:\s*$")
_TRAILER = re.compile(r"^\s*(?:Fixes|Closes|Resolves|Refs?|References|See|Bug|Issue|Link|Cc|Related|Backports|[A-Z][A-Za-z]*(?:-[A-Za-z]+)+):\s+\S(?:(?![.!?]\s+\S).){0,160}$")
_PICKED = re.compile(r"^\s*\((?:cherry picked|backported) from (?:commit )?[0-9a-f]{7,40}\)\s*$")
_LETTER = re.compile(r"[^\W_]")


class Block:
    """Joined text of some lines; every place in it has its place in the source."""

    __slots__ = ("at", "from_", "kind", "length", "parts")

    def __init__(self, kind: str) -> None:
        self.kind, self.parts, self.at, self.from_, self.length = kind, [], [], [], 0

    def add(self, line: str, start: int) -> None:
        self.at.append(self.length)
        self.from_.append(start)
        self.parts.append(line)
        self.length += len(line) + 1

    @property
    def text(self) -> str:
        return "\n".join(self.parts)

    def source(self, place: int) -> int:
        i = bisect_right(self.at, place) - 1
        return self.from_[i] + place - self.at[i]


def blocks(text: str) -> Iterator[Block]:
    """The blocks of a text in order."""
    block: Block | None = None
    fence = ""
    depth = ""
    start = 0
    for raw in text.splitlines(keepends=True):
        line_start, start = start, start + len(raw)
        line = raw.rstrip()
        if fence:
            m = _FENCE.match(line)
            if m and m[2].startswith(fence) and not line[m.end() :].strip(fence[0]).strip():
                yield block
                block, fence = None, ""
            else:
                block.add(line, line_start)
            continue
        if ("`" in line or "~" in line) and (m := _FENCE.match(line)):
            if block:
                yield block
            block, fence = Block("code"), m[2][:3]
            block.add(line[m.end() :], line_start + m.end())
            continue
        m = _QUOTE.match(line) if ">" in line or "+" in line or "|" in line else None
        cut = m.end() if m else 0
        mark = re.sub(r"\s", "", m[0]).lstrip("\ufeff") if m else ""
        body = line[cut:]
        at = line_start + cut
        if not body.strip("\ufeff \t\u3000\xa0\u200b") or mark != depth:
            if block:
                yield block
            block = None
            depth = mark
            if not body.strip("\ufeff \t\u3000\xa0\u200b"):
                continue
        bare = body.lstrip("\ufeff")
        kind = ""
        first, last = bare.lstrip()[:1], bare[-1:]
        if first == "#" and _HEADING.match(bare):
            kind = "heading"
        elif (block is None or block.kind != "text") and _LOG.match(bare):
            kind = "log"
        elif last == ":" and _ATTRIBUTION.match(bare):
            kind = "attribution"
        elif last in "=-*_~" and _RULE.match(bare):
            if block:
                yield block
            block = None
            continue
        elif first == "(" and _PICKED.match(bare):
            kind = "trailer"
            if block:
                yield block
            block = None
        elif (block is None or block.kind != "text") and _TRAILER.match(bare):
            kind = "trailer"
        elif (block is None or block.kind != "text") and _ITEM.match(bare):
            kind = "item"
        if kind:
            if block:
                yield block
            block = Block(kind)
            block.add(body, at)
            if kind != "item":
                yield block
                block = None
            continue
        if block is None:
            block = Block("text")
        block.add(body, at)
    if block and block.parts:
        yield block


# --------------------------------------------------------------------- sentences

#: Terminators; a full stop with a small letter or digit right behind it never ends anything.
_CANDIDATE = re.compile(r"(?:\.(?![a-z0-9_])|[!?…。！？｡．।॥؟۔;\u037e])+")
_INK = re.compile(r"\S")
_LETTER_ONLY = re.compile(r"[^\W\d_]")
_SMALL_NUMBER = re.compile(r"\d{1,3}")
_NUMERIC = re.compile(r"v?\d+(?:\.\d+)*|#?[A-Za-z]?\d+")
_LETTERS_END = re.compile(r"[^\W\d_]+$")
_TAIL = re.compile(r"[^\W\d_]+$|[)%]$")
_NUMBER_BEFORE = re.compile(r"\d[\s\xa0]$")
_TWICE = re.compile(r"([A-Z])\1")
_TWICE_NEXT = re.compile(r"([A-Z])\1\.")
_NAME = re.compile(r"\w*")
_CLOSER = "\"'”’»«“)]}）】」』〉》›〗＂"
_OPENER = "\"'“„‚«»‘([{（【「『〈《¿¡‹›"
_LEADS = " \t\n" + _OPENER
_ALWAYS = set("。！？｡।॥؟۔")
_PAIRS = {"“": "”", "„": "“”", "«": "»", "»": "«", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "‘": "’", "《": "》", "‹": "›", "›": "‹"}
_QUOTES = "\"'“„‚«「『"
_CASELESS = re.compile(r"[\u0590-\u0dff\u0e00-\u0fff\u3040-\u9fff]")
_DEVANAGARI = re.compile(r"[ऀ-ॣ०-ॿ]")
_GREEK = re.compile(r"[Ͱ-Ͽἀ-῿]")
_THAI = re.compile(r"[฀-๿]")
_THAI_END = re.compile(r"(?<=[฀-๿])[ \t\n\u3000]+(?=[\"'“(]?(?:[฀-๿]|[A-ZÀ-Þ#]|[a-z]+[_(]))")
_NEXT = re.compile(r"\s*[\"'“”„«»‘’(\[{（「『¿¡—–*_>\s-]*([^\s]{0,4096})")
#: Small-written words that can begin a sentence: identifiers, paths, mixed case, a list's first item.
_IDENTIFIER = re.compile(r"^(?:[\w.:/-]*(?:[_/()]|\d)|[a-z]+[A-Z]|[a-z]{1,4},$)")
_NAMELIKE = re.compile(r"^(?:[\w./:-]*[_()/]|[a-z]+\d|[a-z]+[A-Z]|[a-z]{1,4},$)")


_OPENING = re.compile(r"[\"'“„«»「『(（\[【‘《‹]")
_EDGE = frozenset("\"'“”„«»()[]{}（）「」") | {chr(c) for c in range(0x3001) if chr(c).isspace()}
WORD_MOST = 4096  # characters of a run without blanks that are looked at


def _token(text: str, low: int, at: int) -> str:
    """What stands before a place, back to a blank, quote or bracket."""
    k, least = at, max(low, at - WORD_MOST)
    while k > least and text[k - 1] not in _EDGE:
        k -= 1
    return text[k:at]


def spans(text: str) -> list[tuple[int, int]]:
    """Quoted and bracketed stretches of a paragraph, outermost only: (first place, place of the closer).

    A quotation or bracket closes anywhere in its paragraph, however long it is.
    """
    out: list[tuple[int, int]] = []
    i, n = 0, len(text)
    if not _OPENING.search(text):
        return out
    closers: dict[str, list[int]] = {}
    brackets: dict[int, int] | None = None
    while m := _OPENING.search(text, i):
        i, ch, close = m.start(), m[0], -1
        if ch in "\"'":
            before = not (text[i - 1].isalnum() or text[i - 1] in ".!?,") if ch == '"' else text[i - 1] in " \t\n(["
            if (i == 0 or before) and i + 1 < n and (not text[i + 1].isspace() if ch == '"' else text[i + 1].isalnum()):
                if ch not in closers:
                    closers[ch] = [k.start() for k in re.finditer(rf"(?<!\s){ch}(?![^\W_])", text)]
                close = _after(closers[ch], i)
        elif ch in "(（[【":
            if brackets is None:
                brackets = _brackets(text)
            close = brackets.get(i, -1)
        elif ch != "»" or (i + 1 < n and not text[i + 1].isspace() and (i == 0 or not text[i - 1].isalnum())):
            for c in _PAIRS[ch]:
                if c not in closers:
                    closers[c] = [k.start() for k in re.finditer(c, text)]
                if (k := _after(closers[c], i)) > 0 and (close < 0 or k < close):
                    close = k
        if close > i:
            out.append((i, close))
            i = close
        i += 1
    return out


def _after(places: list[int], i: int) -> int:
    k = bisect_right(places, i)
    return places[k] if k < len(places) else -1


def _brackets(text: str) -> dict[int, int]:
    """Place of every opening bracket that is closed -> place of its closer."""
    out: dict[int, int] = {}
    for a in "(（[【":
        open_: list[int] = []
        for m in re.finditer(rf"[\{a}\{_PAIRS[a]}]", text):
            if m[0] == a:
                open_.append(m.start())
            elif open_:
                out[open_.pop()] = m.start()
    return out


# ---------------------------------------------------------------------- evidence

KEY_MOST = 12  # letters of a word that may be an abbreviation
_PARAGRAPH = re.compile(r"\r?\n(?:[ \t>|+]*\r?\n)+")
_MARKS = frozenset(">|+")
_BULLETS = frozenset("-*•·‣–◦")
_LEAD = "\"'“„«»‘’([{（「『¿¡—–*_"
_LARGE_INSIDE = re.compile(r"(?<=[a-zà-ÿа-яё,] )([^\W\d_]\w*)")
_INITIAL = re.compile(r"(?<![^\s(„“«\"])([^\W\d_])\.[ \xa0\n]*$")
_ORDINAL = re.compile(r"\d{1,3}\.")

#: What may follow a stop: a small word, a digit, a word that also stands small, any other.
SMALL, DIGIT, COMMON, OTHER = "s", "d", "c", "p"


def contexts(text: str, words: set[str] | None = None) -> Iterator[tuple[str, str, str]]:
    """(word, what follows its stop, next word in small letters) of the stops of a text.

    ``what`` is one of the above, or ``f`` where a paragraph or list entry is over. The parts of
    an abbreviation written with blanks (``z. B.``) count as one word, ``z.b``. A word after a
    number with a stop is given as ``#word`` with ``o``, one after another stop with ``f``.
    """
    small = set(text.split()) if words is None else words
    for paragraph in _PARAGRAPH.split(text):
        tokens = paragraph.split()
        last = len(tokens) - 1
        for i in [i for i, t in enumerate(tokens) if t[-1] == "."]:
            token = tokens[i]
            k = i + 1
            while k <= last and tokens[k] in _MARKS:
                k += 1
            nxt = tokens[k].lstrip(_LEAD) if k <= last else ""
            bare = nxt.rstrip(".,;:!?)")
            if _ORDINAL.fullmatch(token):
                if bare.isalpha() and bare[0].isupper():
                    yield "#" + bare.lower(), "o", ""
                continue
            word = token[:-1].lstrip(_LEAD)
            if not word or len(word) > KEY_MOST or not word.replace(".", "").isalpha():
                if bare.isalpha() and bare[0].isupper():
                    yield "#" + bare.lower(), "f", ""
                continue
            key = word.lower()
            if len(word) == 1 and len(nxt) >= 2 and nxt[1] == "." and nxt[0].isalpha() and (word.isupper() or nxt[0].islower() or not i or len(tokens[i - 1]) != 2):
                continue  # the first part of one written with blanks, or an initial before another
            if len(word) == 1 and i and tokens[i - 1][-1].isdigit():
                continue  # a unit
            if len(word) <= 3 and i and len(tokens[i - 1]) == 2 and tokens[i - 1][1] == "." and tokens[i - 1][0].islower():
                key = f"{tokens[i - 1][0]}.{key}"
            if k > last or tokens[k] in _BULLETS:
                yield key, "f", ""
            elif not nxt:
                yield key, OTHER, ""
            elif nxt[0].islower():
                yield key, OTHER if _IDENTIFIER.match(nxt) else SMALL, ""
            elif nxt[0].isdigit():
                yield key, DIGIT, ""
            else:
                low = bare.lower()
                if len(word) > 2 and bare.isalpha():
                    yield "#" + low, "f", ""
                yield key, COMMON if low in small and bare != low else OTHER, low if bare.isalpha() and bare != low else ""


class Document:
    """What a document itself says on words and stops, read when first asked."""

    def __init__(self, text: str) -> None:
        self.text = text
        self._words: set[str] | None = None
        self._seen: dict[str, set[str]] | None = None
        self._large: set[str] | None = None

    @property
    def words(self) -> set[str]:
        if self._words is None:
            self._words = set(self.text.split())
        return self._words

    def seen(self, key: str) -> set[str]:
        """What follows the stops of a word, over all its places."""
        if self._seen is None:
            self._seen = {}
            for word, what, _ in contexts(self.text, self.words):
                self._seen.setdefault(word, set()).add(what)
        return self._seen.get(key, set())

    def ordinary(self, key: str) -> bool:
        """The word also stands small without a stop, and no stop of it is followed by a small word or digit."""
        return key in self.words and len(key) > 1 and not {SMALL, DIGIT} & self.seen(key)

    def abbreviation(self, key: str) -> bool:
        """A stop of the word is followed by a small word, and it never stands without one.

        A text that begins sentences small, as long words before stops show, says nothing so.
        """
        if SMALL not in (seen := self.seen(key)) or key in self.words or "f" in seen:
            return False
        return not any(len(k) > 6 and "." not in k and SMALL in v for k, v in self._seen.items())

    def common(self, word: str) -> bool:
        """A large-written word that also stands small."""
        return word != word.lower() and word.lower() in self.words

    def proper(self, word: str) -> bool:
        """Whether ``word`` stands large inside a sentence, and never small."""
        if self._large is None:
            self._large = {m[1] for m in _LARGE_INSIDE.finditer(self.text)}
        return word in self._large and word.lower() not in self.words


class Open(NamedTuple):
    """A stop that the document leaves open: its word, what follows, and the verdict without other evidence."""

    key: str
    what: str
    otherwise: bool


#: Verdicts by word and what follows; a missing one is no evidence.
Corpus = dict[str, dict[str, bool]]


def _stop_ends(text: str, at: int, end: int, doc: Document, start: int = 0, nxt: str | None = None) -> bool | Open:
    """Whether the full stop at ``at`` ends a sentence, given what stands around it."""
    if end >= len(text):
        return True
    if nxt is None:
        nxt = _NEXT.match(text, end)[1]
    first = nxt[:1]
    if not nxt:
        return True
    word = _token(text, start, at).lstrip("#*_-–—…")
    low = word.lower()
    if not text[end].isspace():
        if end > at + 1:  # a closing mark in between
            return False
        if (_NUMERIC.fullmatch(word) or text[at - 1] in ")]}>`»”") and first.isupper():
            return True
        tail = _TAIL.search(word)
        if not tail or "/" in word or "@" in word or "_" in word:
            return False
        unit = len(tail[0]) == 1 and _NUMBER_BEFORE.search(text[max(0, at - 3) : at - 1]) is not None
        if first.isupper() and (len(tail[0]) > 1 or tail[0] in ")%" or unit) and "." not in word:
            return Open(low, OTHER, low not in LEADING) if word.isalpha() and len(word) <= KEY_MOST and not doc.ordinary(low) else True
        return len(tail[0]) > 2 and first.isalpha() and not first.isupper() and not first.islower() and not first.isascii() and "." not in word
    small = first.islower() and not _IDENTIFIER.match(nxt)
    key = low
    if word.isalpha() and word[-1] < "\u0900":
        n = len(word)
        plain = not small or n > 2
        if n > KEY_MOST or (n == 1 and _NUMBER_BEFORE.search(text[max(0, at - 3) : at - 1])):
            return plain
        if n == 2 and _TWICE.fullmatch(word) and _TWICE_NEXT.match(nxt):
            return False
        if n <= 3:
            m = _INITIAL.search(text[max(0, at - n - 6) : at - n])
            if n == 1 and nxt[1:2] == "." and first.isalpha() and (word.isupper() or first.islower() or m is None):
                return False
            if m and m[1].islower():
                key = f"{m[1]}.{low}"
    else:
        if _SMALL_NUMBER.fullmatch(word) and first.isalpha():
            return _ordinal(text, at, nxt)
        if word and _DEVANAGARI.search(word[-1:]):
            return len(word) > 5 and "।" not in text
        letters = _LETTERS_END.search(word)
        plain = not small or (not word[-1:].isdigit() if letters is None else len(letters[0]) > 2 or "/" in word)
        if not word or len(word) > KEY_MOST or not word.replace(".", "").isalpha():
            return plain
    dotted = "." in key or len(word) == 1
    if not dotted and doc.ordinary(key):
        return plain
    name = _NAME.match(nxt)[0]
    large = first.isupper()
    what = SMALL if small else DIGIT if first.isdigit() else COMMON if large and doc.common(name) else OTHER
    if doc.abbreviation(key) and (what in (SMALL, DIGIT) or (what == OTHER and large and doc.proper(name))):
        return False
    return Open(key, what, _otherwise(key, what, plain, dotted, first, large and dotted and doc.proper(name)))


def _otherwise(key: str, what: str, plain: bool, dotted: bool, first: str, proper: bool) -> bool:
    """The verdict where neither document nor corpus says anything: by list, else by form."""
    if key in LEADING:
        return False
    if key in TRAILING:
        return what in (COMMON, OTHER) and not proper
    if len(key) == 1:
        return not (first.isalpha() or first.isdigit())
    if dotted:
        return what in (COMMON, OTHER) and not proper
    return plain


def _ordinal(text: str, at: int, nxt: str) -> bool | Open:
    """A small number with a stop before a word: an ordinal, or an end."""
    if nxt[0].islower():
        return bool(_NAMELIKE.match(nxt))
    name = re.match(r"[^\W\d_]*", nxt)[0].lower()
    lead = re.search(r"([^\W\d_]+)\s+\d{1,3}$", text[max(0, at - 24) : at])
    otherwise = not (name in MONTHS or (nxt[0].isupper() and lead is not None and lead[1].lower() in ARTICLES))
    return Open("#" + name, "o", otherwise) if nxt[0].isupper() and otherwise else otherwise


def _ends(text: str, m: re.Match, doc: Document, start: int = 0) -> tuple[int, bool | Open]:
    """The place after which a sentence that ends at this candidate is over, and whether it ends."""
    marks, at, end = m[0], m.start(), m.end()
    close = end
    while close < len(text) and text[close] in _CLOSER and not (text[close] in "“„«»\"'" and (close + 1 < len(text) and text[close + 1].isalnum()) and text[close - 1] in ".!?…" and text[close] != "”"):
        close += 1
    if close >= len(text) or marks[0] in _ALWAYS or (len(marks) > 1 and not _ALWAYS.isdisjoint(marks)) or not _INK.search(text, close):
        return close, True
    nxt = _NEXT.match(text, close)[1]
    if marks == ".":
        return close, _stop_ends(text, at, close, doc, start, nxt)
    blank = text[close].isspace()
    first = nxt[:1]
    if marks[-1] in ";\u037e":
        return close, _GREEK.search(text[max(0, at - 40) : at]) is not None and blank and not first.islower()
    if "!" in marks or "?" in marks:
        token = _token(text, start, at)
        if not blank:
            return close, (first.isupper() and "://" not in token and "/" not in token) or bool(first and not first.isascii() and first.isalpha() and "://" not in token and text[close] not in ",;:")
        ahead = text[_INK.search(text, close).start()]
        if ahead in ",;:":
            return close, False
        if ahead in _QUOTES or _CASELESS.match(text[at - 1 : at]):
            return close, True
        return close, not first.islower() or bool(_NAMELIKE.match(nxt))
    if "…" in marks or len(marks) > 1:
        if not blank:
            return close, first.isupper()
        return close, not first.islower() or bool(_NAMELIKE.match(nxt))
    return close, _stop_ends(text, at, close, doc, start, nxt)


def sentences(text: str, doc: Document) -> list[tuple[int, bool | Open]]:
    """Places in a paragraph at which a new sentence begins or may begin, 0 first."""
    inner = spans(text)
    out: list[tuple[int, bool | Open]] = [(0, True)]
    begin, k = 0, 0  # begin: the last beginning, as far as it is known
    greek = (";" in text or "\u037e" in text) and _GREEK.search(text) is not None

    def add(place: int, verdict: bool | Open) -> None:
        nonlocal begin
        if verdict is not False:
            out.append((place, verdict))
            if verdict is True or verdict.otherwise:
                begin = place

    for m in _CANDIDATE.finditer(text):
        if m.start() < begin or (not greek and m[0] in ";\u037e"):
            continue
        if m.start() - begin < 40 and not text[begin : m.start()].strip(_LEADS):
            continue  # leading marks belong to what follows
        while k < len(inner) and inner[k][1] < m.start():
            k += 1
        if k < len(inner) and inner[k][0] < m.start() < inner[k][1]:
            # Inside quotes or brackets: an end only together with the closer, before a new beginning.
            closer = inner[k][1]
            if m.end() != closer or text[closer] in "”」』）】" and closer + 1 < len(text) and not text[closer + 1].isspace():
                continue
            ink = _INK.search(text, closer + 1)
            if ink is None or ink.start() == closer + 1 or text[ink.start()] in "—–-,;:":
                continue
            nxt = _NEXT.match(text, closer + 1)[1]
            if nxt and not nxt[0].islower() and not nxt[0].isdigit() and (text[inner[k][0]] in "(（[【" or inner[k][0] <= begin + 1 or text[m.start()] in ".!?"):
                add(closer + 1, True if text[m.start()] != "." else _stop_ends(text, m.start(), closer + 1, doc, begin, nxt))
            continue
        place, verdict = _ends(text, m, doc, begin)
        if verdict is not False and _INK.search(text, place):
            add(place, verdict)
    if _THAI.search(text):
        firsts = [a for a, _ in inner]
        inside = lambda p: (i := bisect_left(firsts, p)) > 0 and inner[i - 1][1] > p
        known = dict(out) | {m.end(): True for m in _THAI_END.finditer(text) if not inside(m.start())}
        out = sorted(known.items())
    return out


def candidates(text: str | None) -> list[tuple[int, Open | None]]:
    """Places (from 0) of the first letter or digit of every unit, in order; those of stops left open with what decides them."""
    if not text:
        return []
    doc = Document(text)
    out: dict[int, Open | None] = {}
    for block in blocks(text):
        body = block.text
        for place, verdict in sentences(body, doc) if block.kind == "text" else [(0, True)]:
            if m := _LETTER.search(body, place):
                at = block.source(m.start())
                if verdict is True or at not in out:
                    out[at] = None if verdict is True else verdict
    return sorted(out.items())


def unit_starts(text: str | None, corpus: Corpus | None = None) -> list[int]:
    """Places (from 0) of the first letter or digit of every unit, in order, given what the corpus says on words."""
    known = corpus or {}
    return [at for at, v in candidates(text) if v is None or known.get(v.key, {}).get(v.what, v.otherwise)]


# --------------------------------------------------------------------- operators

HELD = 100_000  # words a task counts before it passes them on
LEAST = 5  # stops of a word that are evidence
SENT = 200_000  # rows of evidence, a few megabytes, that are sent to all tasks; more are joined by a shuffle of narrow rows
OFTEN = 40  # stops of a word of which an ordinary one would close a paragraph
_COUNTS = ["s", "d", "c", "p", "f", "o"]


def stop_counts(documents: DataFrame) -> DataFrame:
    """(key, next, s, d, c, p, f, o): what follows the stops of each word, over all documents; fused in tasks first.

    ``next`` is the large-written word that follows, else empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], list[int]] = {}
        column = {c: i for i, c in enumerate(_COUNTS)}
        for b in batches:
            for text in b.column(0).to_pylist():
                for key, what, low in contexts(text):
                    row = counts.get((key, low))
                    if row is None:
                        row = counts[key, low] = [0] * len(column)
                    row[column[what]] += 1
            if len(counts) > HELD:
                yield table(counts)
                counts.clear()
        yield table(counts)

    def table(counts: dict[tuple[str, str], list[int]]) -> pa.RecordBatch:
        arrays = [pa.array([k[i] for k in counts], pa.string()) for i in range(2)] + [pa.array([n[i] for n in counts.values()], pa.int64()) for i in range(len(_COUNTS))]
        return pa.RecordBatch.from_arrays(arrays, names=["key", "next", *_COUNTS])

    counted = spread(documents.select("text").where("text is not null")).mapInArrow(run, "key string, next string, " + ", ".join(f"{c} bigint" for c in _COUNTS))
    return counted.groupBy("key", "next").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def corpus_evidence(counts: DataFrame) -> DataFrame:
    """(key, s, d, c, p, o): verdicts on stops by what follows, true for an end, null for no evidence; of :func:`stop_counts`.

    Shares of the stops of a word decide: one often followed by small words or digits, or only
    by names, and never at the end of a paragraph, abbreviates. A large-written word is common
    if it often stands small in the documents where it follows a stop. Words without any
    verdict against an end are left out, as an end is what remains.
    """
    following = counts.where("next != ''").groupBy("next").agg((F.sum("c") >= 0.005 * F.sum(F.col("c") + F.col("p"))).alias("begins"))
    joined = counts.join(following, "next", "left")
    large = F.when(F.col("next") != "", F.col("c") + F.col("p"))
    words = joined.groupBy("key").agg(*[F.sum(c).alias(c) for c in _COUNTS], F.sum(large).alias("large"), F.sum(F.when(F.col("begins"), large)).alias("begun"))
    n = F.col("s") + F.col("d") + F.col("c") + F.col("p") + F.col("f")
    closes = F.col("f") >= 0.02 * n
    goes_on = F.col("s") + F.col("d") >= 0.5 * n
    begun = F.try_divide(F.coalesce("begun", F.lit(0)), "large")
    names = (F.coalesce(begun, F.lit(0)) < 0.1) & ((F.col("large") >= LEAST) | ((F.col("f") == 0) & (n >= OFTEN)))
    capital = F.when(closes, True).when(goes_on | names, False).when(begun >= 0.3, True)
    ordinal = F.try_divide("o", F.col("o") + F.col("f"))
    enough = (n >= LEAST) & ~F.col("key").startswith("#")
    verdicts = words.select(
        "key",
        F.when(enough & (F.col("s") >= 3) & (F.col("s") >= 0.15 * n), False).alias("s"),
        F.when(enough & (F.col("d") >= 0.3 * n), False).when(enough & (F.col("d") < 0.1 * n) & closes, True).alias("d"),
        F.when(enough, capital).alias("c"),
        F.when(enough, capital).alias("p"),
        F.when(F.col("key").startswith("#") & (F.col("o") + F.col("f") >= LEAST), F.when(ordinal >= 0.5, False).when(ordinal < 0.05, True)).alias("o"),
    )
    listed = F.col("key").isin(sorted(LEADING | TRAILING)) | F.col("key").contains(".") | (F.length("key") == 1)
    against = F.lit(False)
    for c in ("s", "d", "c", "p", "o"):
        against = against | F.coalesce(~F.col(c), F.lit(False))
    return verdicts.where(against | (listed & F.coalesce("s", "d", "c", "p", "o").isNotNull()))


def sentence_starts(documents: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """(doc_id, start_pos): one row for each unit; positions count characters from 1.

    Rows of certain beginnings meet no evidence; where a shuffle joins it, their keys spread them.
    """
    evidence = durable(corpus_evidence(durable(stop_counts(documents)))) if evidence is None else evidence
    sent = evidence.count() <= SENT
    if sent:
        evidence = F.broadcast(evidence)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                ids, places, keys, whats, verdicts = [], [], [], [], []
                for doc, text in zip(*(c.to_pylist() for c in b.slice(lo, 2000).columns)):
                    got = candidates(text)
                    certain = None if sent else f"!{doc % 4096}"
                    ids += [doc] * len(got)
                    for at, v in got:
                        places.append(at + 1)
                        keys.append(certain if v is None else v.key)
                        whats.append(None if v is None else v.what)
                        verdicts.append(v is None or v.otherwise)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(keys, pa.string()), pa.array(whats, pa.string()), pa.array(verdicts, pa.bool_())], names=["doc_id", "start_pos", "key", "what", "otherwise"]
                )

    texts = documents.select("doc_id", "text").where("doc_id is not null and text is not null and text != ''")
    found = spread(texts, "doc_id").mapInArrow(run, "doc_id bigint, start_pos bigint, key string, what string, otherwise boolean")
    verdict = F.lit(None).cast("boolean")
    for c in ("s", "d", "c", "p", "o"):
        verdict = F.when(F.col("what") == c, F.col(f"e.{c}")).otherwise(verdict)
    return found.alias("u").join(evidence.alias("e"), F.col("u.key") == F.col("e.key"), "left").where(F.coalesce(verdict, F.col("otherwise"))).select("doc_id", "start_pos")
