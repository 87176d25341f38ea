import random
import re
import pandas as pd
import pytest

from changelode.llm import pii

LEX = pii.Lexicon(["Tamsin Grauholt", "Pellmark, Odile", "Zoë Fennberg", "Bram Grauberg", "Håkon Fennholt", None, "Solo", "ilse pellberg"])


def kinds(text):
    return [(k, text[a:b]) for k, a, b in pii.places(text, LEX)]


@pytest.mark.parametrize(
    "text, start",
    [
        ("mail a.b+c@x-1.example.org now", "a.b"), ("A_B99@MAIL.EXAMPLE.COM", "A_B"), ("to z at corp dot q dot example if", "z at"), ("to z.y [at] q [dot] example", "z.y"), ("{zz(at)q.example}", "zz("),
        ("see p&#64;q.example.", "p&#"), ("ö: q＠lab.example", "q＠"), ("v @ lab-3.example", "v @"), ("<mailto:z9@q.test>", "z9@"), ("аnna@q.example", "аnna"),
    ],
)
def test_mail(text, start):
    (kind, value), = kinds(text)
    assert kind == "EMAIL" and value.startswith(start)


@pytest.mark.parametrize("text", ["git@git.q.example:a/b.git", "Message-Id: <1.2@relay.q.example>", "root@edge-16:~# ls", "user@vty> show", "x@.service unit", "pkg quill@4.1.7 pinned", "@some_login please", ""])
def test_no_mail(text):
    assert kinds(text) == []


@pytest.mark.parametrize(
    "number",
    ["+44 20 7946 0950", "(503) 555-0197", "503.555.0132", "01632 960523", "0044 1632 960 142", "030 / 23125-194", "+7 (000) 913-55-56", "+81-3-0000-0111", "０３－００００－0181", "01.99.00.92.41", "+16465550121", "+49-(0)30-23125784", "+34 900 00 85 74", "(01632) 960 503"],
)
def test_phone(number):
    assert kinds(f"call {number} after noon") == [("PHONE", number)]


def test_spelled_number_keeps_its_place():
    (kind, a, b), = pii.places("call zero three oh five five five one two three now", LEX) or [("", 0, 0)]
    assert (kind, a) == ("", 0) or "call zero"[a : a + 4] == "zero"


@pytest.mark.parametrize("number", ["911-18-3835", "956 34 7304", "QQ 38 38 98 C", "QQ385101C", "ZZ6994023", "ZQ 224511", "Y00510522L", "00068479-F", "230874-961E"])
def test_id_number(number):
    assert kinds(f"the form shows {number} for her") == [("ID_NUMBER", number)]


@pytest.mark.parametrize("text", ["Order id 90027815152 was", "Bug id 046 20 79 46 in", "Build 44020-22-9222 passed", "Serial ZX-7512-1351 is", "MAC 02:00:5e:10:4:01", "community 6552:3494", "at 203.0.113.5 since v8.11.5", "Timestamp 1700026929 is", "uuid 3f2b3377-aaaa-4bbb-8ccc-008446dd1317"])
def test_no_number(text):
    assert kinds(text) == []


@pytest.mark.parametrize(
    "address",
    [
        "Flat 29, 188 Tanner's Row, Pellbridge", "272C Old Mill Rd.", "397 St. Brannoc Street", "2219 N. Tanner's Row, Apt 27B, Pellbridge, ZZ 00745", "Lindenstraße 53", "Am Alten Wehr 102, 00212 Mühlfeld",
        "131 bis, rue des Tilleuls, 00334 Valcendre", "174, avenue du Vieux Puits", "Calle del Olmo 180, 2.º B, 00905 Robledar", "Avda. de la Fuente, 296", "ул. Сосновая, д. 217, кв. 45", "架空県青葉市緑町5-23-8",
    ],
)
def test_address(address):
    assert kinds(f"ship to {address}") == [("ADDRESS", address)]


@pytest.mark.parametrize("text", ["Velk Street is the code name", "Try 10 Base Drive, the test profile.", "Lane 56 of the serdes", "12 Angle Bracket tests fail", "Border Gateway and Route Reflector tests", "7092 routes loaded"])
def test_no_address_or_name(text):
    assert kinds(text) == []


@pytest.mark.parametrize("name", ["Tamsin Grauberg", "Odile H. Fennmark", "Fennholt, Zoë", "B. Pellholt", "Bram de la Grauholt", "Zoë GRAUHOLT", "Håkon Fennberg-Pellmark", "Мирон Остравский", "К. Тарнова", "佐仮野例美", "tamsin grauholt"])
def test_name(name):
    assert kinds(f"ping {name}?") == [("NAME", name)]


def test_name_contexts():
    assert kinds("login-3 (Odile Pellmark)") == [("NAME", "Odile Pellmark")]
    assert kinds("Signed-off-by: Unlisted Person <u@q.example>") == [("NAME", "Unlisted Person"), ("EMAIL", "u@q.example")]
    assert kinds("Bram Grauberg's branch") == [("NAME", "Bram Grauberg")]
    assert kinds("Bram Graubergさんに、Fennholt, Zoëさんに") == [("NAME", "Bram Grauberg"), ("NAME", "Fennholt, Zoë")]
    assert kinds("Best,\nFennholt, Zoë's x") == [("NAME", "Fennholt, Zoë")]
    assert kinds("the passport no. QQ 36 96 39 B before") == [("ID_NUMBER", "QQ 36 96 39 B")]
    assert kinds("电话+44 20 7946 0950或写信a@b.example。") == [("PHONE", "+44 20 7946 0950"), ("EMAIL", "a@b.example")]
    assert kinds("Hi Tamsin, peer-unre0 and 真的吗？！ fine") == []


def test_masked_text():
    text = "Zoë Fennberg wrote to z at q dot example — ok"
    assert pii.masked(text, pii.places(text, LEX)) == "[NAME] wrote to [EMAIL] — ok"


def test_offsets_survive_folding():
    text = "\u200b\u200bＡＢ z＠q.example"
    (kind, a, b), = pii.places(text, LEX)
    assert text[a:b] == "z＠q.example"


def test_operator(spark):
    rows = [("f", 1, "a@b.example"), ("f", 1, "a@b.example"), ("f", 2, None), ("f", 3, ""), (None, 4, "x"), ("f", None, "a@b.example"), ("f", 2**60 + 1, "a@b.example"), ("f", 5, "filler " * 20000 + "a@b.example")]
    df = spark.createDataFrame(rows, "field string, record_id bigint, text string").selectExpr("*", "'clash' AS kind", "1 AS start_pos")
    assert sorted(tuple(r)[:4] for r in pii.find_places(df, LEX).collect()) == [("f", 1, "EMAIL", 1), ("f", 5, "EMAIL", 140001), ("f", 2**60 + 1, "EMAIL", 1)]
    assert pii.find_places(df.limit(0), LEX).count() == 0
    out = pii.mask_column(df, "text", LEX, "kind").where("record_id < 4").orderBy("record_id").collect()
    assert [r.kind for r in out] == ["[EMAIL]", "[EMAIL]", None, ""]
    names = spark.createDataFrame([(None,), ("Tamsin Grauholt",)], "display_name string")
    assert pii.lexicon(names).given == {"tamsin"} and pii.lexicon(names.limit(0)).given == set()


def test_every_mask_is_clean():
    texts = pd.Series(["ping Tamsin Grauberg? +44 20 7946 0950", "a@b.example a@c.example"])
    for t in texts:
        assert kinds(pii.masked(t, pii.places(t, LEX))) == []


def test_gates_skip_nothing_their_patterns_match():
    for spelled in ("four-one-five-two-six-seven-eight", "four, one, five, two, six, seven"):
        assert pii.normalise(f"({spelled})").text == "(" + "".join(pii.DIGIT_WORDS[w] for w in spelled.replace(",", "").replace("-", " ").split()) + ")"
    assert kinds("seen (tamsin grauholt here") == [("NAME", "tamsin grauholt")]
    assert kinds("seen támsin grauholt here") == [("NAME", "támsin grauholt")]
    assert kinds("write а.smith@example.com") == [("EMAIL", "а.smith@example.com")]


# Names, numbers and addresses that are not of the test tables, marked by kind; a text without marks holds none.
HELD_OUT = [
    "Please ask {NAME:Maria Gonzalez} about it.", "{NAME:Wei Zhang} reported the crash.", "Thanks to {NAME:Priya Sharma} for the trace.", "Reviewed-by: {NAME:Tunde Okafor} <{EMAIL:tunde@mailhost.example}>",
    "Mr. {NAME:Abernathy} called again.", "Prof. {NAME:Lindqvist} agrees.", "I met {NAME:Svetlana Petrova} there.", "{NAME:Hiroshi Tanaka} wrote: fine.", "As {NAME:Giulia Rossi} said, it loops.",
    "It was {NAME:Ahmed Hassan}'s patch.", "Frau {NAME:Schneider} hat es gesehen.", "Signed-off-by: {NAME:Kwame Mensah} <{EMAIL:km@post.example}>", "cc {NAME:Olga Ivanova}, please.", "ping {NAME:Carlos Ramirez} on Monday.",
    "{NAME:Lars Andersson} found it.", "Hi {NAME:Fatima Khan}, any news?", "Ask {NAME:Jan Kowalski} for the key.", "{NAME:Camille Dubois} a écrit cela.", "El Sr. {NAME:Fernandez} lo sabe.", "{NAME:Yuki Nakamura} confirmed it.",
    "We live at {ADDRESS:12 Base Street, Leeds}.", "Come to {ADDRESS:10 Downing Street} for the test.", "Ship to {ADDRESS:221B Baker Street, London}.", "The office is at {ADDRESS:1600 Amphitheatre Parkway, Mountain View, CA 94043}.", "Besuch uns: {ADDRESS:Lindenstraße 14, 10969 Berlin}.",
    "Chez moi : {ADDRESS:25 rue de Rivoli, 75004 Paris}.", "Vivo en {ADDRESS:Calle de Alcalá 45, 28014 Madrid}.", "Адрес: {ADDRESS:ул. Ленина, д. 5, кв. 12}.", "Visit {ADDRESS:7 Hard Lane, York} soon.",
    "Call {PHONE:+44 20 7946 0958} now.", "Mobile: {PHONE:415-555-2671}.", "Tel. {PHONE:030 / 1234567-12} geht.", "my number {ID_NUMBER:811228-9874} is there", "身份证 {ID_NUMBER:11010519491231002X} 在此", "SSN {ID_NUMBER:078-05-1120} leaked.",
    "Mail {EMAIL:a.b+c@sub.host.example} or {EMAIL:x.y at host dot example}.", "{NAME:王小明}さんに聞く。", "reviewed by {NAME:李伟} today",
    "请看 文档 说明 谢谢", "IBAN DE89 3704 0044 0532 0130 00 is ours.", "Card 4111 1111 1111 1111 is a test card.", "The Red Hat build fails.", "Apache Maven and Google Chrome start.", "We use Visual Studio here.", "See Open Source Summit.",
    "New York and San Francisco are up.", "Run 10 Gigabit Lane tests.", "Fit a 2 Hard Drive bay.", "Try 14 Copper Drive, the test profile.", "order 415-555-2671 was sent", "version 1.2.3.4 is out", "Linux Kernel Mailing List", "git clone git@host.example:a/b.git",
    "Message-Id: <123.456@relay.example>", "at 2024-01-05 10:11:12 it fell", "0x1234567890ab is the hash", "The Data Plane and Control Plane agree.", "Spanning Tree and Route Map code.", "build 123456-7890 passed", "Hello World prints.",
]


def test_held_out_places():
    lex = pii.Lexicon(["Tamsin Harrow"])
    found = wanted = both = 0
    missed = []
    for marked in HELD_OUT:
        text, want, rest = "", set(), marked
        while m := re.search(r"\{([A-Z_]+):([^}]*)\}", rest):
            text += rest[: m.start()]
            want.add((m[1], len(text)))
            text, rest = text + m[2], rest[m.end() :]
        got = {(k, a) for k, a, _ in pii.places(text + rest, lex)}
        found, wanted, both = found + len(got), wanted + len(want), both + len(got & want)
        if got != want:
            missed.append((text + rest, want - got, got - want))
    assert both >= 0.9 * wanted and both >= 0.9 * found, missed
    print(both, wanted, found, missed)


def test_check_digits():
    assert pii.account("DE89 3704 0044 0532 0130 00") and not pii.account("DE89 3704 0044 0532 0130 01") and not pii.account("GB00")
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    right = lambda text: pii.dated(pii._DATED.search(text))
    assert right("811228-9874") and not right("811228-9875") and not right("811328-9873") and right("11010519491231002X") and not right("110105194912310021")


def test_a_large_lexicon_takes_the_most_frequent(spark, monkeypatch):
    monkeypatch.setattr(pii, "MAX_LEXICON_ROWS", 1)
    names = spark.createDataFrame([("Tamsin Harrow",), ("Tamsin Harrow",), ("Bram Quill",), (None,)], "display_name string")
    assert pii.lexicon(names).given == {"tamsin"}


LISTED = ["Tamsin Grauholt", "Pellmark, Odile", "Zoë Fennberg", "Bram Grauberg", "Håkon Fennholt", "Solo", "ilse pellberg", "Jean-Luc O'Dowd", "Luc Quill", "Jean-Pierre Harrow"]
SPOKEN = [
    "ping Tamsin Grauberg, Fennholt, Zoë's and B. Pellholt", "tamsin grauholt and håkon fennberg's", "Odile Fennberg-Pellmark's", "d'Ilse Pellmark 'Harrow-Quill, Luc' said", "Luc Jean-Pierre", "Bram O'Fennholt", "Tаmsin Harrow", "Ann H. Quill’s x",
    "Bram de la Grauholt", "Håkon\u200b Fennmark", "a'b'c'Bram Harrow", "nobody here", "", None,
]


def test_every_listed_name_counts_in_a_large_lexicon(spark, monkeypatch):
    names, whole = spark.createDataFrame([(n,) for n in [*LISTED, LISTED[0], None]], "display_name string"), pii.Lexicon(LISTED)
    texts = spark.createDataFrame([("f", i, t) for i, t in enumerate([*SPOKEN, SPOKEN[0]])], "field string, record_id bigint, text string")
    want = {("f", i, k, a + 1, e) for i, t in enumerate([*SPOKEN, SPOKEN[0]]) for k, a, e in pii.places(t, whole)}
    clean = {i: None if t is None else pii.masked(t, pii.places(t, whole)) for i, t in enumerate([*SPOKEN, SPOKEN[0]])}
    assert len(want) > 10
    for limit, texts_of in ((100, texts), (len(LISTED) - 1, texts), (1, texts), (1, texts.where("record_id = 0")), (1, texts.where("text = 'nobody here'"))):
        monkeypatch.setattr(pii, "MAX_LEXICON_ROWS", limit)
        lex, ids = pii.lexicon(names), {r.record_id for r in texts_of.collect()}
        assert {tuple(r) for r in pii.find_places(texts_of, lex).collect()} == {p for p in want if p[1] in ids}
        masks = pii.mask_column(texts_of.withColumnRenamed("field", "Given_0"), "text", lex)
        assert masks.columns == ["Given_0", "record_id", "text", "masked"] and {r.record_id: r.masked for r in masks.collect()} == {i: clean[i] for i in ids}


def test_a_lexicon_that_is_not_whole_answers_nothing(spark, monkeypatch):
    monkeypatch.setattr(pii, "MAX_LEXICON_ROWS", 1)
    lex = pii.lexicon(spark.createDataFrame([(n,) for n in LISTED], "display_name string"))
    with pytest.raises(ValueError):
        pii.places(SPOKEN[0], lex)


def test_all_that_detectors_ask_is_looked_up():
    class Asked(pii.Lexicon):
        """Answers at random, as other lexicons would, and keeps what it was asked."""

        def __init__(self, seed):
            super().__init__(())
            self.rng, self.asks, me = random.Random(seed), set(), self

            class Given(set):
                def __contains__(self, k):
                    me.asks.add(k)
                    return me.rng.random() < 0.5

                def isdisjoint(self, words):
                    me.asks.update(words)
                    return False

            self.given = Given()

        def is_family(self, word):
            self.asks.update(map(pii._key, word.split("-")))
            return self.rng.random() < 0.5

    rng, pieces = random.Random(7), ["Ann", "Zoë", "Ann Zoë-Ann", "Zoë-Ann", "bram", "O", "d", "Mc", "ß", "Ł", "İ", "ж", "e\u0301", "\u200b", "а", "'", "’", "'s", "-", "--", ",", ", ", " ", " ", " ", "\n", ".", ". ", "A. ", "de la ", "×", "_", "7", "@", "(", "<"]
    for seed in range(4000):
        text, lex = "".join(rng.choices(pieces, k=rng.randrange(2, 14))), Asked(seed)
        pii.places(text, lex)
        assert lex.asks - {""} <= pii.asked(text), text
