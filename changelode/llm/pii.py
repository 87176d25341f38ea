"""Problem 1: personal data in free text, by offset-preserving deobfuscation.

A text passes a chain of transducers (character folding, homoglyphs, entities, disguised
``at``/``dot``, spelled digits). Each keeps, for every character it emits, the source offset
it came from, so detectors run on plain text and spans map back to the original characters.

What a detector takes for a place rests on the form of the number, address or name and on what
stands around it: numbering plans and check digits, a street's words with the town, postcode or
preposition beside them, names with a title, mailbox, trailer or verb of saying. Bank accounts
and card numbers are recognised by their check digits and are no places.

Defined results: null and empty texts, and rows without an id, have no places; repeated rows give one set of places;
places never overlap (mail, phone, number, address, name, in this order of precedence).
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelode.plans.durable import durable
from changelode.plans.spread import spread

KINDS = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")
MAX_LEXICON_ROWS = 100_000  # names, or words of the texts that are names, that are sent to all tasks; more are joined

# ---------------------------------------------------------------- transducers

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("асеорхуіјԁɡАВСЕНІЈКМОРТХоɑαοΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aceopxyijdgABCEHIJKMOPTXoaaoABEZHIKMNOPTYX"))
# Words for the ten digits.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_FOLD: dict[str, str] = {}
_DASHES = "‐‑‒–—−－"
_SEPARATED = re.compile(r"\s?[\[({<]\s?(?:at|arroba|ät|собака)\s?[\])}>]\s?", re.I)
_DOTTED = re.compile(r"\s?[\[({<]\s?(?:dot|punto|punkt|point|точка)\s?[\])}>]\s?", re.I)
_ENTITY_AT = re.compile(r"&(?:#0*64|#x0*40|commat);", re.I)
_ENTITY_DOT = re.compile(r"&(?:#0*46|#x0*2e|period);", re.I)
_SPACED_AT = re.compile(r"(?<=[\w+]) ?@ ?(?=[\w-]+(?:\.[\w-]+)+)")
_SPOKEN = re.compile(r"(?<![\w.+-])[\w.+-]+( (?:at|arroba|chez) )[\w-]+(?:(?: dot | punto | point |\.)[\w-]+)+", re.I)
_SPOKEN_DOT = re.compile(r" (?:dot|punto|point) ", re.I)
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?<!\w)(?:{_WORD})(?:[ ,-]+(?:{_WORD})){{4,}}(?!\w)", re.I)


def _fold(ch: str) -> str:
    if ch not in _FOLD:
        if ch in "\u200b\u200c\u200d\u2060\ufeff\u00ad":
            _FOLD[ch] = ""
        elif ch in _DASHES:
            _FOLD[ch] = "-"
        elif unicodedata.category(ch) == "Zs":
            _FOLD[ch] = " "
        elif ch in "＠＋－．＿" or 0xFF10 <= ord(ch) <= 0xFF19 or 0xFF21 <= ord(ch) <= 0xFF3A or 0xFF41 <= ord(ch) <= 0xFF5A or 0x1D400 <= ord(ch) <= 0x1D7FF or unicodedata.category(ch) == "Nd":
            x = unicodedata.normalize("NFKC", ch)
            _FOLD[ch] = str(unicodedata.digit(ch)) if unicodedata.category(ch) == "Nd" else x
        else:
            _FOLD[ch] = ch
    return _FOLD[ch]


_FOLDABLE = re.compile(rf"(?![0-9])\d|[ \xa0\u1680\u2000-\u200a\u202f\u205f\u3000\u200b\u200c\u200d\u2060\ufeff\xad{_DASHES}＋．＿＠Ａ-Ｚａ-ｚ\U0001d400-\U0001d7ff]")
_GLYPHS = "".join(HOMOGLYPHS)
_GLYPH = re.compile(rf"[{_GLYPHS}]")
_DIGIT_SET = frozenset(DIGIT_WORDS)


class Tape:
    """A text under transduction with, for each character, its place in the source."""

    __slots__ = ("at", "text")

    def __init__(self, text: str) -> None:
        self.text = text
        self.at: list[int] | None = None  # None: the identity

    def rewrite(self, edits: Iterable[tuple[int, int, str]]) -> None:
        """Replaces spans, in order and disjoint; emitted characters keep the span's first place."""
        out, at, done = [], [], 0
        old = self.at if self.at is not None else list(range(len(self.text) + 1))
        for a, b, new in edits:
            out += [self.text[done:a], new]
            at += old[done:a]
            at += [old[min(a + i, b - 1)] for i in range(len(new))]
            done = b
        if done or out:
            out.append(self.text[done:])
            at += old[done:]
            self.text, self.at = "".join(out), at

    def source(self, a: int, b: int) -> tuple[int, int]:
        if self.at is None:
            return a, b
        return self.at[a], max(self.at[b - 1] + 1, self.at[a] + 1) if b < len(self.text) and self.at[b] == self.at[b - 1] else self.at[b]


def normalise(text: str) -> Tape:
    """The chain of transducers; the identity (and no offsets) for most plain texts."""
    tape = Tape(text)
    if not text.isascii():
        edits = [(m.start(), m.end(), y) for m in _FOLDABLE.finditer(text) if (y := _fold(m[0])) != m[0]]
        if edits:
            tape.rewrite(edits)
        edits = []
        for m in () if not _GLYPH.search(tape.text) else re.finditer(r"[\w.+@-]*[A-Za-z@][\w.+@-]*", tape.text):
            if not m[0].isascii() and any(c in HOMOGLYPHS for c in m[0]):
                edits += [(m.start() + i, m.start() + i + 1, HOMOGLYPHS[c]) for i, c in enumerate(m[0]) if c in HOMOGLYPHS]
        if edits:
            tape.rewrite(edits)
    low = tape.text
    if "&" in low:
        for pattern, new in ((_ENTITY_AT, "@"), (_ENTITY_DOT, ".")):
            if edits := [(m.start(), m.end(), new) for m in pattern.finditer(tape.text)]:
                tape.rewrite(edits)
    if "[" in low or "(" in low or "{" in low or "<" in low:
        for pattern, new in ((_SEPARATED, "@"), (_DOTTED, ".")):
            if edits := [(m.start(), m.end(), new) for m in pattern.finditer(tape.text)]:
                tape.rewrite(edits)
    if " @" in tape.text or "@ " in tape.text:
        if edits := [(m.start(), m.end(), "@") for m in _SPACED_AT.finditer(tape.text)]:
            tape.rewrite(edits)
    if " dot " in tape.text or " DOT " in tape.text or " punto " in tape.text or " point " in tape.text:
        edits = []
        for m in _SPOKEN.finditer(tape.text):
            dots = [(d.start() + m.end(1), d.end() + m.end(1), ".") for d in _SPOKEN_DOT.finditer(tape.text[m.end(1) : m.end()])]
            if dots:
                edits += [(m.start(1), m.end(1), "@"), *dots]
        if edits:
            tape.rewrite(edits)
    if sum(map(_DIGIT_SET.__contains__, tape.text.lower().replace(",", " ").replace("-", " ").split())) > 2 and (edits := [(m.start(), m.end(), re.sub(r"[ ,-]+", "", re.sub(rf"(?i){_WORD}", lambda w: DIGIT_WORDS[w[0].lower()], m[0]))) for m in _SPELLED.finditer(tape.text)]):
        tape.rewrite(edits)
    return tape


# ------------------------------------------------------------------ detectors

_MAIL = re.compile(r"(?<![A-Za-z0-9_.+%-])[A-Za-z0-9_À-ɏ][A-Za-z0-9_À-ɏ.+%-]*@(?:[A-Za-z0-9_-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9_-])")
_NOT_MAIL_BEFORE = re.compile(r"(?:(?:message-id|in-reply-to|references|msgid|mid)\W{0,4}|://[^\s/]*|git clone )$", re.I)
_PHONE = re.compile(
    r"""(?<![A-Za-z0-9_.:/+-])(?:
      \+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d){6,13}
    | 00\d{2}(?:[ -]\d{2,5}){2,4}
    | \(\d{2,5}\)\ ?\d{3}[ -]?\d{3,4}
    | \d{3}[.-]\d{3}[.-]\d{4}
    | 0\d{1,4}\ ?/\ ?\d{3,6}-\d{2,5}
    | 0\d(?:[. ]\d{2}){4}
    | 0\d{1,3}-\d{3,4}-\d{3,4}
    | 0\d{3,4}\ \d{3}\ ?\d{3,4}
    )(?![A-Za-z0-9_-]|[.:/]\d)""",
    re.X,
)
_TEL = re.compile(r"(?<=tel:)\+?\d(?:[ .()-]{0,2}\d){5,14}(?![A-Za-z0-9_])|(?<![A-Za-z0-9_.:/+-])\d{9,12}(?![A-Za-z0-9_])", re.I)
_PHONE_HINT = re.compile(r"(?:phone|tel|call|text|mobile|fax|whatsapp|☎|℡|anruf|erreichbar|appel\w*|телефон|電話|电话)\W{0,6}(?:(?:me|us|at|le|unter|is)\W{0,3}){0,2}$", re.I)
_ID = re.compile(
    r"""(?<![A-Za-z0-9_.:/#-])(?:
      \d{3}-\d{2}-\d{4}
    | \d{3}\ \d{2}\ \d{4}
    | [A-Z]{2}\ ?\d{2}\ ?\d{2}\ ?\d{2}\ ?[A-D]
    | Z[A-Z]\ ?\d{6,7}
    | [XYZ]-?\d{7,8}-?[A-Z]
    | \d{8}-?[A-Z]
    | \d{6}[-+A]\d{3}[0-9A-Z]
    | \d{3}\.\d{3}\.\d{3}-\d{2}
    | \d{3}-\d{3}-\d{3}\ \d{2}
    | [12]\ ?\d{2}\ ?\d{2}\ ?\d{2}\ ?\d{3}\ ?\d{3}(?:\ ?\d{2})
    )(?![A-Za-z0-9_-]|[.:/]\d)""",
    re.X,
)
_ID_WORD = re.compile(r"(?:passport|reisepass|pasaporte|passeport|паспорт|national insurance|social security|ssn|tax (?:id|no|number)|steuer-?id|personalausweis|sécurité|dni|nie)\W{0,4}(?:card\W{0,3})?(?:no|nr|number|num|id|is)?[\W]{0,4}$", re.I)
_ID_LOOSE = re.compile(r"(?<![A-Za-z0-9_.:/#-])(?=[A-Z0-9 -]{0,16}\d{4})[A-Z]{0,2}\ ?\d[\d -]{4,12}\d[A-Z]?(?![A-Za-z0-9_-])")
#: A label of another kind right before a number: no sentence ends between them.
_OTHER_LABEL = re.compile(r"(?<![A-Za-z])(?:order|bug|build|serial|ticket|timestamp|issue|invoice|part|commit|version|port|mac|release|job|run|batch|sku|asn|rfc|isbn|uptime|offset|size|line)\s?(?:id|no\.?|nr\.?|number|code)?\s?[:=#]?\s?$", re.I)
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")
_CARD = re.compile(r"(?<![\d-])\d{4}(?:[ -]?\d{4}){3}(?![\d-])")
_DATED = re.compile(r"(?<![A-Za-z0-9_.:/#-])(?:(\d{6})[-+](\d{4})|(\d{6})(\d{8})(\d{3}[\dXx]))(?![A-Za-z0-9_-]|[.:/]\d)")


def account(text: str) -> bool:
    """Whether a bank account number's check digits hold."""
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def luhn(digits: str) -> bool:
    """Whether the last digit checks the others by doubling every second one."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def dated(m: re.Match) -> bool:
    """Whether a number that holds a day of birth has a possible one and the right check digit."""
    if m[1]:
        return "01" <= m[1][2:4] <= "12" and "01" <= m[1][4:6] <= "31" and luhn(m[1] + m[2])
    weights = [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2]
    whole = m[3] + m[4] + m[5]
    check = "10X98765432"[sum(w * int(c) for w, c in zip(weights, whole[:17])) % 11]
    return m[4][:2] in ("18", "19", "20") and "01" <= m[4][4:6] <= "12" and "01" <= m[4][6:8] <= "31" and whole[-1].upper() == check


_STREET = (
    r"(?:Street|Str|St|Road|Rd|Lane|Ln|Drive|Dr|Way|Avenue|Ave|Crescent|Cres|Row|Close|Court|Ct|Place|Pl|Square|Sq|Terrace|Boulevard|Blvd|Hill|Gardens|Grove|Mews|Parade|Walk|Quay|Rise|View|Circle|Highway|Hwy|Parkway|Pkwy|Alley)"
)
_ADDRESS = [
    re.compile(
        rf"(?<![\w./:#-])(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room|Ste\.?)\s+\d+\w?,\s+)?\d{{1,5}}[A-Za-z]?\s+(?:[NSEW]\.?\s+)?(?:St\.\s+)?(?:[A-Z][\w'’]*\s+){{1,3}}?{_STREET}\b\.?"
        r"(?:,\s*(?:Apt|Flat|Unit|Suite)\.?\s+\w+)?(?:,\s*[A-Z]\w+(?:\s[A-Z][a-z]+)?(?:,?\s+[A-Z]{2}\s*\d{5}|\s+[A-Z]{1,2}\d{1,2}\s\d[A-Z]{2})?)?"
    ),
    re.compile(
        r"(?<![\w./])(?:[A-ZÄÖÜ][\wäöüß]*(?:straße|strasse|str\.|gasse|weg|platz|allee|ufer|damm|ring|markt|graben)|(?:Am|An der|Auf dem|Auf der|Im|In der|Zum|Zur|Unter den|Hinter der)\s+[A-ZÄÖÜ][\wäöüß]+(?:\s+[A-ZÄÖÜ][\wäöüß]+)?)"
        r"\s+\d{1,4}\s?[a-z]?\b(?![.:]\d)(?:,\s*\d{4,5}\s+[A-ZÄÖÜ][\wäöüß]+)?"
    ),
    re.compile(
        r"(?<![\w./:#-])\d{1,4}(?:\s(?:bis|ter|quater))?,?\s+(?:rue|avenue|impasse|chemin|boulevard|quai|allée|allee|square|cours|passage|ruelle|(?:place|route)(?=\s+(?:de|du|des|d'|d’)))\s+(?:(?:de|du|des|la|le|les|l['’]|d['’])\s*){0,3}[\w'’-]+(?:\s+[A-ZÀ-Ý][\w'’-]*){0,2}(?:,\s*\d{5}\s+[A-ZÀ-Ý][\w-]+)?"
    ),
    re.compile(
        r"(?<![\w./])(?:Calle|C/|Avda\.?|Avenida|Av\.|Plaza|Pza\.|Paseo|Camino|Ronda|Carrer|Travesía|Callejón|Vía)\s+(?:(?:de|del|la|las|los|el)\s+){0,2}[A-ZÁÉÍÓÚÑ]\w+(?:\s+[A-ZÁÉÍÓÚÑ]\w+)?,?\s+(?:n\.?º\s*)?\d{1,4}\b(?:,\s*\d\.º\s*\w+)?(?:,\s*\d{5}\s+[A-ZÁÉÍÓÚÑ]\w+)?"
    ),
    re.compile(
        r"(?<!\w)(?:ул\.|улица|пр\.|просп\.|проспект|пр-т|пер\.|переулок|наб\.|набережная|бул\.|бульвар|пл\.|площадь|ш\.|шоссе)\s*[А-ЯЁ][\w-]+(?:\s+[А-ЯЁ][\w-]+)?,?\s*(?:д\.|дом)?\s*\d+\w?(?:,\s*(?:кв\.|квартира|корп\.|стр\.)\s*\d+)*"
    ),
    re.compile(r"(?:[㐀-鿿]{1,5}?[都道府県省州])?[㐀-鿿ぁ-ゟ゠-ヿ]{1,8}?[市区區郡县縣町村](?:[㐀-鿿ぁ-ゟ゠-ヿ]{0,10}?[市区區町村路街道巷丁目])?\s?\d+(?:[-号號番弄丁目之]+\d*)*"),
]
#: For each pattern above what any match contains, so that most texts are spared the search.
_ADDRESS_SIGNS: list[tuple[str, ...] | None] = [
    None,
    ("straße", "strasse", "str.", "gasse", "weg", "platz", "allee", "ufer", "damm", "ring", "markt", "graben", "Am ", "An der", "Auf de", "Im ", "In der", "Zum ", "Zur ", "Unter den", "Hinter der"),
    ("rue", "avenue", "impasse", "chemin", "boulevard", "quai", "allée", "allee", "square", "cours", "passage", "place", "route"),
    ("Calle", "C/", "Avda", "Avenida", "Av.", "Plaza", "Pza.", "Paseo", "Camino", "Ronda", "Carrer", "Travesía", "Callejón", "Vía"),
    ("ул", "пр", "пер", "наб", "бул", "пл", "ш"),
    tuple("市区區郡县縣町村"),
]
_DIGIT = re.compile(r"\d")
_NUMERAL = re.compile(r"\d(?:[ ./()+-]{0,3}\d){5}")
#: What makes an English street form an address or not: it is said to be the name of some thing; it is
#: two words for a device or measure; a place is spoken of before it; a town or postcode stands behind it.
_THING = re.compile(r",? (?:is )?(?:the|a|an|our) (?:\w+ )?(?:test|code|name|profile|image|mode|preset|benchmark|setting|option|variant|config\w*|model|codename)\b", re.I)
_DEVICE = re.compile(r"\d+\w?\s+(?:(?:Solid State|Hard|Flash|Disk|Tape|Optical|Thumb) Drive|(?:Bit|Byte|Gigabit|Megabit|Port|Core|Node|Channel|Lane)\b.*|(?:Disk|Table|Data) Row)")
_PLACE_BEFORE = re.compile(r"(?:\b(?:at|live[sd]?|address(?: is)?|ship(?:ped)? to|sent to|deliver(?:ed)? to|come by|visit|office|home|house|near|by|to|in|moved to)|it's)\W{1,3}$", re.I)
_TOWN_IN = re.compile(r",\s*[A-Z]\w+|\b(?:Apt|Flat|Unit|Suite)\b")
_TOWN_AFTER = re.compile(r"(?:,\s*|\n)[A-Z]\w+")


def _is_street(text: str, a: int, b: int) -> bool:
    """Whether a number with a street's words is an address, by what speaks for and against it."""
    for_ = 2 * bool(_TOWN_IN.search(text[a:b]) or _TOWN_AFTER.match(text, b)) + bool(_PLACE_BEFORE.search(text[max(0, a - 24) : a]))
    against = 2 * (text[b - 1] != "." and _THING.match(text, b) is not None) + 2 * bool(_DEVICE.fullmatch(text[a:b].rstrip(".")))
    return for_ >= against


_CAP = "A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚĜĞĠĢĤĦĨĪĬĮİĴĶĹĻĽĿŁŃŅŇŊŌŎŐŒŔŖŘŚŜŞŠŢŤŦŨŪŬŮŰŲŴŶŸŹŻŽ"
_LAT = r"[A-Za-zÀ-ÖØ-öø-ɏ'’]"
_PART = r"(?:(?:de la|de los|de|del|della|di|da|dos|du|van der|van den|van|von der|von|vom|zu|zur|ter|ten|le|la|el|bin|ben|ibn|al)\s+)"
_FAMILY = rf"[{_CAP}]{_LAT}+(?:-[{_CAP}]{_LAT}+)?"
_WORDS = re.compile(rf"(?<![A-Za-zÀ-ɏ0-9@./_+-])([{_CAP}]{_LAT}*[A-Za-zÀ-ÖØ-öø-ɏ])\s+((?:[{_CAP}]\.\s+)*)({_PART}?)({_FAMILY})(?![A-Za-zÀ-ɏ0-9@_])")
_LOWER = re.compile(rf"(?<![A-Za-zÀ-ɏ0-9@./_+-])([a-zà-öø-ɏ]{_LAT}+)(?=\s+([a-zà-öø-ɏ]{_LAT}+)(?![\w@_.-]))")
_LOWER_FIRST = re.compile(rf"(?<![A-Za-zÀ-ɏ0-9@./_+-])(?=([a-zà-öø-ɏ]{_LAT}+)\s)")
_REVERSED = re.compile(rf"(?<![A-Za-zÀ-ɏ0-9@./_+-])({_FAMILY}),[ \t]+([{_CAP}]{_LAT}+)((?:\s+[{_CAP}]\.)?)(?![A-Za-zÀ-ɏ0-9@_])")
_INITIAL = re.compile(rf"(?<![A-Za-zÀ-ɏ0-9@./_+-])((?:[{_CAP}]\.\s?){{1,3}})\s?({_PART}?)({_FAMILY})(?![A-Za-zÀ-ɏ0-9@_])")
_FRAME = re.compile(
    rf"(?:^|\n)(?:[A-Z][A-Za-z-]+-by:|From:|Author:|On-behalf-of:|> )\s*([{_CAP}]{_LAT}+(?:\s+[{_CAP}]\.)?\s+{_PART}?{_FAMILY})(?=\s*(?:\(?<|\n|$| wrote:))"
)
_CYR_NAME = re.compile(r"(?<!\w)[А-ЯЁ][а-яё]+\s+(?:[А-ЯЁ]\.\s?)?[А-ЯЁ][а-яё]+(?:ов|ова|ёв|ев|ева|ин|ина|ын|ына|ский|ская|цкий|цкая|енко|ук|юк|ян)(?!\w)")
_CYR_INITIAL = re.compile(r"(?<!\w)(?:[А-ЯЁ]\.\s?){1,2}[А-ЯЁ][а-яё]+(?:ов|ова|ёв|ев|ева|ин|ина|ын|ына|ский|ская|цкий|цкая|енко|ук|юк|ян)(?!\w)")
_CYR_REVERSED = re.compile(r"(?<!\w)[А-ЯЁ][а-яё]+(?:ов|ова|ёв|ев|ева|ин|ина|ский|ская|енко),\s+[А-ЯЁ][а-яё]+(?!\w)")
_HAN_NAME = re.compile(r"(?:(?<=^)|(?<=[\s(\[>:,\"'/|*]))[㐀-鿿々]{2,5}(?:[・·][゠-ヿ㐀-鿿]+)?(?=$|[\s<)\],:;.?!'\"/|]|さん|氏|様|先生)")
_HONORIFIC = re.compile(r"さん|氏|様|先生|女士|小姐|同学")
_HAN = re.compile(r"[㐀-鿿]")
_TOKEN_BEFORE = re.compile(r"([^\s]*)[^\S\n]*$")
_TOKEN_AFTER = re.compile(r"[^\S\n]*([^\s]*)")

# Frequent given and family names, and frequent endings of family names.
GIVEN = set(
    "maria ana anna jose juan luis carlos pedro jorge elena laura lucia sofia carmen isabel pablo diego miguel javier fernando james john robert michael william david richard joseph thomas charles"
    " mary patricia jennifer linda elizabeth barbara susan jessica sarah karen emily daniel matthew andrew peter paul george edward brian kevin jason rachel hannah alice emma olivia wei li jing min"
    " yan lei xin hui ming jun feng hao yuki hiroshi takashi kenji akira naoko keiko satoshi priya rahul amit anil sunita deepak raj arjun neha vikram mohammed ahmed ali omar fatima hassan hussein"
    " aisha leila ibrahim yusuf mustafa ivan dmitri sergei olga natalia svetlana irina vladimir pierre jean marie claire luc antoine sophie camille julien hans klaus jurgen stefan katrin ulrich heike"
    " giovanni marco luca giulia francesca paolo chiara lars sven ingrid astrid erik bjorn katarzyna piotr agnieszka tomasz jan marek".split()
)
FAMILY = set(
    "smith johnson williams brown jones garcia miller davis rodriguez martinez hernandez lopez gonzalez wilson anderson thomas taylor moore jackson martin lee perez thompson white harris sanchez clark"
    " ramirez lewis robinson walker young allen king wright scott torres nguyen hill flores green adams nelson baker hall rivera campbell mitchell carter roberts wang zhang liu chen yang huang zhao wu"
    " zhou xu sun ma zhu hu guo he lin luo gao zheng tanaka suzuki sato takahashi watanabe yamamoto nakamura kobayashi kato kim park choi jung kumar sharma singh patel gupta khan ahmed hussain ali"
    " muller schmidt schneider fischer weber meyer wagner becker schulz hoffmann dubois dupont durand leroy moreau rossi russo ferrari esposito bianchi silva santos oliveira pereira costa ivanov petrov".split()
)
_FAMILY_END = re.compile(r"(?:sson|son|sen|berg|stein|mann|ström|strom|gren|qvist|quist|ova|ev|eva|ovic|ović|ić|ski|ska|sky|wicz|czyk|escu|opoulos|idis|akis|yan|dze|shvili|enko|chuk|inen|aitis|oğlu|oglu|zadeh|[rdtnl]ez|ini|elli|etti|ucci|aldi)$|^(?:O['’]|Mc|Mac|Fitz)[A-Z]")
_TITLED = re.compile(rf"(?<![A-Za-z0-9])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Hr|Fr|Mme|Mlle|Monsieur|Madame|Señora?|Sra?|Signora?)\.?\s+((?:[{_CAP}]\.\s*)*{_PART}?{_FAMILY}(?:\s+{_FAMILY})?)(?![A-Za-zÀ-ɏ0-9@_])")
_BESIDE_MAIL = re.compile(rf"(?<![A-Za-zÀ-ɏ0-9@./_+-])([{_CAP}]{_LAT}+(?:\s+[{_CAP}]\.)?\s+{_PART}?{_FAMILY})\s*[<(]\s*(?:mailto:)?[\w.+-]+@")
_SAYING = re.compile(r"\s+(?:wrote|writes|said|says|reported|asked|noticed|suggested|confirmed|reviewed|mentioned|pointed out|found|lives|called|who)\b")
_NAMED_BEFORE = re.compile(r"\b(?:by|thanks to|thank|ask(?:ed)?|ping(?:ed)?|contact|call|told|from|with|to|and|for|dear|hi|hello|hey|name is|named|cc)[:,]?\s+$", re.I)
_NO_GIVEN = set("the this that these those ask see tell call contact dear hi hello thanks thank from with and but for when because after before if so as at by in on to we you they it please also then now yes no not best regards cheers apache linux red open free new old north south east west saint san lake mount port fort great".split())


def _han_is_name(text: str, a: int, b: int) -> bool:
    """Whether a run of Han is a name: before an honorific, or set into a text of another script.

    Between blanks amid other Han words it is an ordinary word.
    """
    if _HONORIFIC.match(text, b):
        return True
    before, after = _TOKEN_BEFORE.search(text[max(0, a - 40) : a])[1], _TOKEN_AFTER.match(text, b, b + 40)[1]
    return not _HAN.search(before) and not _HAN.search(after)


def _key(word: str) -> str:
    """Case and accents folded, for lookups in the lexicon."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower().replace("ł", "l").replace("ø", "o")) if not unicodedata.combining(c))


def _listed(name: str | None) -> Iterator[tuple[str, bool]]:
    """The given name and the parts of the family name in a display name, and whether each is family."""
    if not name or not (words := re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", name)) or len(words) < 2:
        return
    first, last = (words[-1], words[0]) if "," in name else (words[0], words[-1])
    if len(first) > 1:
        yield _key(first), False
    yield from ((_key(x), True) for x in last.split("-") if len(x) > 2)


class Lexicon:
    """Given and family names taken from the display names of known contributors.

    Families compose: a word also counts if it splits into a beginning and an ending that
    each occur in two listed families at least, as people in texts need not be listed.
    ``table`` has all names where they are too many to be held; the sets then hold the most
    frequent ones only, and the operators look up the words of the texts in ``table``.
    """

    def __init__(self, names: Iterable[str | None], table: DataFrame | None = None) -> None:
        self.table = table
        words = {word for name in names for word in _listed(name)}
        self.given = {k for k, family in words if not family}
        self.family = {k for k, family in words if family}
        begin: dict[str, int] = {}
        end: dict[str, int] = {}
        for f in self.family:
            for i in range(3, len(f) - 1):
                begin[f[:i]] = begin.get(f[:i], 0) + 1
                end[f[i:]] = end.get(f[i:], 0) + 1
        self.begin, self.end = {k for k, n in begin.items() if n > 1}, {k for k, n in end.items() if n > 1}
        self._known: dict[str, bool] = {}

    @classmethod
    def looked_up(cls, given: Iterable[str] | None, family: Iterable[str] | None) -> Lexicon:
        """What a whole lexicon says of the words of some texts, composed families being among ``family``."""
        lex = cls(())
        lex.given.update(() if given is None else given)
        lex.family.update(() if family is None else family)
        return lex

    def is_family(self, word: str) -> bool:
        if word not in self._known:
            if len(self._known) > 200_000:
                self._known.clear()
            self._known[word] = all(
                k in self.family or any(k[:i] in self.begin and k[i:] in self.end for i in range(3, len(k) - 1)) for k in map(_key, word.split("-"))
            )
        return self._known[word]


def _names(text: str, lex: Lexicon) -> Iterator[tuple[int, int]]:
    pos = 0
    trim = lambda a, b: (a, b - 2 * text[a:b].endswith(("'s", "’s")))
    while m := _WORDS.search(text, pos):
        given = _key(m[1])
        if given in lex.given and (m[2] or m[3] or _key(m[4]) not in lex.given or lex.is_family(m[4])):
            yield trim(*m.span())
            pos = m.end()
        elif given not in _NO_GIVEN and _unlisted(text, m, given, lex):
            yield trim(*m.span())
            pos = m.end()
        else:
            pos = m.end(1)
    for m in _REVERSED.finditer(text) if ", " in text else ():
        if _key(re.sub(r"['’]s$", "", m[2])) in lex.given and lex.is_family(m[1]):
            yield trim(*m.span())
    for m in _INITIAL.finditer(text):
        if lex.is_family(re.sub(r"['’]s$", "", m[3])):
            yield trim(*m.span())
    if not lex.given.isdisjoint(map(str.lower if text.isascii() else _key, set(_LOWER_FIRST.findall(text)))):
        for m in _LOWER.finditer(text):
            if _key(m[1]) in lex.given and lex.is_family(m[2]):
                yield m.start(1), m.end(2)
    for m in _FRAME.finditer(text):
        yield m.span(1)
    for m in _TITLED.finditer(text):
        yield trim(*m.span(1))
    for m in _BESIDE_MAIL.finditer(text) if "@" in text else ():
        if _key(m[1].split()[0]) not in _NO_GIVEN:
            yield m.span(1)
    if not text.isascii():
        for pattern in (_CYR_NAME, _CYR_INITIAL, _CYR_REVERSED, _HAN_NAME):
            for m in pattern.finditer(text):
                if pattern is not _HAN_NAME or _han_is_name(text, *m.span()):
                    yield m.span()


def _unlisted(text: str, m: re.Match, given: str, lex: Lexicon) -> bool:
    """Whether two large-written words name a person whom the lexicon lacks.

    A frequent given name with a frequent, listed or typical family name does; without one of
    the two, someone must be spoken of: a cue before the name or a verb of saying behind it.
    """
    family = m[4].rsplit("-", 1)[-1]
    known, low = given in GIVEN, _key(re.sub(r"['’]s$", "", family))
    typical = _FAMILY_END.search(family) is not None
    if known and (low in FAMILY or typical or lex.is_family(m[4])):
        return True
    if not (known or low in FAMILY or typical) or not m[1][1:].islower():
        return False
    cued = _SAYING.match(text, m.end()) is not None or _NAMED_BEFORE.search(text[max(0, m.start() - 16) : m.start()]) is not None
    return cued and (known or low in FAMILY)


def _hits(text: str, lex: Lexicon) -> Iterator[tuple[str, int, int]]:
    if "@" in text:
        for m in _MAIL.finditer(text):
            before, after = text[max(0, m.start() - 40) : m.start()], text[m.end() : m.end() + 2]
            if not _NOT_MAIL_BEFORE.search(before) and not (after[:1] == ":" and after[1:].strip() and not after[1:].isdigit() and m[0].startswith("git@")):
                yield "EMAIL", *m.span()
    if not _DIGIT.search(text):
        yield from (("NAME", *span) for span in _names(text, lex))
        return
    if _NUMERAL.search(text):
        guarded = [m.span() for m in _ACCOUNT.finditer(text) if account(m[0])] + [m.span() for m in _CARD.finditer(text) if luhn(re.sub(r"\D", "", m[0]))]
        free = lambda m: not any(a < m.end() and m.start() < b for a, b in guarded)
        for m in _PHONE.finditer(text):
            if free(m) and (m[0][0] == "+" or not _OTHER_LABEL.search(text[max(0, m.start() - 24) : m.start()])):
                yield "PHONE", *m.span()
        for m in _TEL.finditer(text):
            before = text[max(0, m.start() - 24) : m.start()]
            if free(m) and (before.lower().endswith("tel:") or _PHONE_HINT.search(before)):
                yield "PHONE", *m.span()
        for m in _ID.finditer(text):
            if free(m) and not _OTHER_LABEL.search(text[max(0, m.start() - 24) : m.start()]):
                yield "ID_NUMBER", *m.span()
        for m in _DATED.finditer(text):
            if free(m) and dated(m):
                yield "ID_NUMBER", *m.span()
        for m in _ID_LOOSE.finditer(text):
            if free(m) and _ID_WORD.search(text[max(0, m.start() - 40) : m.start()]):
                yield "ID_NUMBER", *m.span()
    for pattern, signs in zip(_ADDRESS, _ADDRESS_SIGNS):
        if signs is None or any(sign in text for sign in signs):
            for m in pattern.finditer(text):
                if pattern is not _ADDRESS[0] or _is_street(text, *m.span()):
                    yield "ADDRESS", *m.span()
    for span in _names(text, lex):
        yield "NAME", *span


def places(text: str | None, lex: Lexicon) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each place in ``text``, zero-based, ordered, without overlaps."""
    if not text:
        return []
    if lex.table is not None:
        raise ValueError("a lexicon that is not held whole: use find_places or mask_column")
    tape = normalise(text)
    starts: list[int] = []
    taken: list[tuple[str, int, int]] = []  # in the order of their starts, disjoint
    for kind, a, b in sorted(_hits(tape.text, lex), key=lambda h: (KINDS.index(h[0]), h[1], -h[2])):
        i = bisect_left(starts, a)
        if (i == 0 or taken[i - 1][2] <= a) and (i == len(taken) or b <= starts[i]):
            starts.insert(i, a)
            taken.insert(i, (kind, a, b))
    return [(kind, *tape.source(a, b)) for kind, a, b in taken]


def masked(text: str, found: list[tuple[str, int, int]]) -> str:
    """``text`` with a typed placeholder for each place; the rest is unchanged."""
    out, done = [], 0
    for kind, a, b in found:
        out += [text[done:a], f"[{kind}]"]
        done = b
    return "".join([*out, text[done:]])


class _Cached:
    """Places by text; short values such as logins repeat often."""

    def __init__(self, lex: Lexicon | None) -> None:
        self.lex, self.known = lex, {}

    def __call__(self, text: str | None, given: Iterable[str] | None = None, family: Iterable[str] | None = None) -> list[tuple[str, int, int]]:
        """Without a lexicon for all texts, by the names that were looked up for this one."""
        if text is None or len(text) > 80:
            return places(text, self.lex or Lexicon.looked_up(given, family))
        if (got := self.known.get(text)) is None:
            if len(self.known) > 50_000:
                self.known.clear()
            got = self.known[text] = places(text, self.lex or Lexicon.looked_up(given, family))
        return got


# ------------------------------------------------- lexicons that are not held

_RUN = re.compile(rf"{_LAT}+(?:-{_LAT}+)*")
_APOSTROPHE = re.compile(r"['’]")


def _cuts(word: str) -> Iterator[str]:
    """A word, and its parts up to and from each apostrophe: a name may begin or end there."""
    yield word
    for m in _APOSTROPHE.finditer(word):
        yield word[: m.start()]
        yield word[m.end() :]


@lru_cache(200_000)
def _run_words(run: str) -> frozenset[str]:
    parts = run.split("-")
    words = [w for part in parts for w in _cuts(part)]
    if len(parts) > 1:
        words += [f"{parts[0]}-{w}" for w in _cuts(parts[1])]
    return frozenset(map(_key, words)) - {""}


def asked(text: str) -> set[str]:
    """All that the detectors of names may ask a lexicon about ``text``: words and, of a run with hyphens, its first pair."""
    return set().union(*map(_run_words, set(_RUN.findall(normalise(text).text))))


def _asked(texts: DataFrame, column: str, by_text: bool) -> DataFrame:
    """The words of ``texts``: (word), distinct, or (text_hash, word), where texts repeat more than once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pairs = set(zip(b["text_hash"], b["text"]))
            rows = [(h, list(asked(t))) for h, t in pairs] if by_text else [(0, list(set().union(*(asked(t) for _, t in pairs))))]
            yield pd.DataFrame(rows, columns=["text_hash", "words"])

    out = texts.where(F.col(column).isNotNull()).select(F.xxhash64(column).alias("text_hash"), F.col(column).alias("text"))
    out = out.mapInPandas(run, "text_hash bigint, words array<string>").select("text_hash", F.explode("words").alias("word"))
    return out if by_text else out.select("word").distinct()


def _answers(words: DataFrame, names: DataFrame) -> DataFrame:
    """Of ``words(word)``, distinct, those that ``names(name)`` make names: (word, is_family), as a Lexicon of all has it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(list({w for name in b["name"] for w in _listed(name)}), columns=["word", "is_family"])

    listed = durable(names.mapInPandas(run, "word string, is_family boolean").distinct())
    given, family = (listed.where(F.col("is_family") == kind).select("word") for kind in (False, True))
    cut = lambda df: df.where("length(word) > 4").withColumn("i", F.explode(F.expr("sequence(3, length(word) - 2)"))).selectExpr("word", "substring(word, 1, i) AS begin", "substring(word, i + 1) AS end")
    begin, end = (cut(family).groupBy(part).count().where("count > 1").select(part) for part in ("begin", "end"))
    composed = cut(words).join(begin, "begin", "left_semi").join(end, "end", "left_semi").select("word")
    families = words.join(family, "word", "left_semi").union(composed).distinct()
    return words.join(given, "word", "left_semi").withColumn("is_family", F.lit(False)).union(families.withColumn("is_family", F.lit(True)))


def _look_up(df: DataFrame, column: str, lex: Lexicon) -> tuple[DataFrame, Lexicon | None, list[str]]:
    """``df`` and a lexicon that is whole for its texts, whatever the size of ``lex.table``.

    The words of the texts are looked up in the table. Those that are names are sent to all
    tasks, if MAX_LEXICON_ROWS at most; else there is no lexicon, but each text's own names
    join it as two more columns, whose names come last. They go by a hash of the text: texts
    that share one share names that are all in the table.
    """
    if lex.table is None:
        return df, lex, []
    found = durable(_answers(durable(_asked(df, column, False)), lex.table))
    rows = found.limit(MAX_LEXICON_ROWS + 1).collect()
    if len(rows) <= MAX_LEXICON_ROWS:
        return df, Lexicon.looked_up((r.word for r in rows if not r.is_family), (r.word for r in rows if r.is_family)), []
    taken = {c.lower() for c in df.columns}
    text_hash, given, family = (next(c for n in range(len(taken) + 1) if (c := f"{base}_{n}") not in taken) for base in ("text_hash", "given", "family"))
    word = lambda kind: F.collect_set(F.when(F.col("is_family") == kind, F.col("word")))
    by_text = _asked(df, column, True).join(found, "word").groupBy(F.col("text_hash").alias(text_hash)).agg(word(False).alias(given), word(True).alias(family))
    return df.withColumn(text_hash, F.xxhash64(column)).join(by_text, text_hash, "left").drop(text_hash), None, [given, family]


# ------------------------------------------------------------------ operators


def lexicon(contributors: DataFrame, column: str = "display_name") -> Lexicon:
    """The name lexicon of a contributors table.

    Up to MAX_LEXICON_ROWS names are held and sent to all tasks. Of a larger table only the
    most frequent ones are; the operators below then look up the words of their texts in the
    whole table, so that no name is left out.
    """
    whole = contributors.select(F.col(column).alias("name")).where("name is not null")
    names = whole.groupBy("name").agg(F.count("*").alias("n"))
    rows = names.orderBy(F.desc("n"), "name").limit(MAX_LEXICON_ROWS + 1).collect()
    return Lexicon(sorted(r[0] for r in rows[:MAX_LEXICON_ROWS]), whole if len(rows) > MAX_LEXICON_ROWS else None)


def find_places(texts: DataFrame, lex: Lexicon) -> DataFrame:
    """Places of personal data in ``texts(field, record_id, text)``.

    Returns (field, record_id, kind, start_pos, end_pos); positions count characters from 1.
    One pass without a shuffle of texts; only the narrow results are made distinct, as a
    record may be delivered twice. A lexicon that is not held takes a pass for its words before,
    and a join with the texts if these hold too many names.
    """
    base, held, own = _look_up(spread(texts.select("field", "record_id", "text").where("record_id is not null and text is not null"), "record_id"), "text", lex)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = _Cached(held)
        for b in batches:
            rows = [(f, i, k, a + 1, e) for f, i, t, *names in zip(*(b[c] for c in ("field", "record_id", "text", *own))) if t for k, a, e in find(t, *names)]
            yield pd.DataFrame(rows, columns=["field", "record_id", "kind", "start_pos", "end_pos"])

    return base.mapInPandas(run, "field string, record_id bigint, kind string, start_pos bigint, end_pos bigint").distinct()


def mask_column(df: DataFrame, column: str, lex: Lexicon, into: str = "masked") -> DataFrame:
    """``df`` with a copy of ``column`` in which placeholders stand for personal data; nulls stay null."""
    base, held, own = _look_up(df, column, lex)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = _Cached(held)
        for b in batches:  # a series, or a tuple of them
            yield pd.Series([None if t is None else masked(t, find(t, *names)) for t, *names in zip(*(b if own else (b,)))], dtype=object)

    return base.withColumn(into, run(F.col(column), *own)).drop(*own)
