import pytest

from changelode.llm import sentences as s


NEVER = dict.fromkeys("sdcp", False)
#: What a corpus says on the abbreviations of the texts below.
KNOWN = {w: NEVER for w in "rev feb oct env p.ej uu uu. π.χ pp mar ltd d.h г а а.в".split()} | {"г": {"s": False, "c": True, "p": False}, "т.д": {"c": True, "p": True}, "usw": {"c": True, "p": True}, "#lauf": {"o": False}}


def units(text, corpus=None):
    starts = s.unit_starts(text, corpus)
    assert starts == sorted(set(starts))
    text = text or ""
    return [text[a:b].strip() for a, b in zip(starts, [*starts[1:], len(text)])]


@pytest.mark.parametrize(
    "text, n",
    [
        ("It fails. It works.", 2), ("Dr. Holm measured 1.5 % loss (see No. 4). The limit holds.", 2), ("Some, e.g. skeld, ignore it. Fine.", 2), ("lo, eth4, etc. are skipped. These, labels, etc. We go on.", 3),
        ("It waits ... and then sends. It just hangs... The end.", 3), ("It is off… mostly.", 1), ('"It never converges. We gave up," wrote the tester. Next.', 2), ("'Stop. Wait. Retry.' is what it says.", 1),
        ("Who added this? is what it says. Really?! Why?", 3), ("Ping me (or anyone!) before. The fix (see #1. It is tiny.) can go.", 2), ("He wrote: \"Not yet.\" and left.", 1), ("The U.S. lab uses rev. 30 of it.", 1),
        ("It ran at 3 p.m. or 5 p.m. in the log? Yes.", 2), ("Feb. 13 is the freeze, Oct. 12 the release.", 1), ("Use v7.1.7. or later builds.", 1), ("The patch by L. M. Holm went in on Feb. 9. Good.", 2), ("asked yesterday.The error stays.", 2),
        ("Set it to .5 or 0.8, never to 18. lo, eth1, etc. are skipped.", 2), ("It loops. osp_x() returns early. eth1.2 comes up. iBGP-style meshes work.", 4), ("See https://a.example/x?y=1!Z. Done.", 2), ("Mr. Holm of Oster Ltd. asked for it.", 1),
        ("Im 12. Lauf trat z. B. das auf. Am 16. März nicht mehr.", 2), ("Das dauert 0,5 s. Bei uns nicht.", 2), ("Das betrifft Marken usw. Der Nachbar, vgl. doc/x.md ist weg d. h. stumm.", 2), ("»Nicht anfassen!« steht im Kommentar. Gut.", 2),
        ("Le Dr Holm et M. Dahl l'ont vu. Quelle lenteur ! Cela prend env. 5 ms.", 3), ("« Tout est revenu ! » a écrit le testeur.", 1), ("¿Quién revisó #2? preguntó alguien. El Sr. Holm usa EE. UU. y p. ej. más. ¡Por fin!", 3),
        ("В 2024 г. опцию убрали, в 2025 г. вернули. А. В. Holm проверил. Правка и т. д. Просто висит... x_y() даёт ошибку.", 5), ("Ποιος είδε το #6; Η μνήμη π.χ. αυξάνεται.", 2), ("डॉ. Holm ने जाँचा। यह ठीक है॥", 2), ('भेजें! "fast x" के साथ नहीं॥', 2), ("Vol. 2, pp. 4-5 covers it.The rest.", 2), ("Quelle lenteur !Est-ce lié ?Le reste, etc.Rien. Es hängt ...Ab jetzt 0,5 s.Wer? See </s>.A gain of 3 dB.NOTE: x.Dr. Holm was here.", 11), ('It stops (see a/b.c).The "Go!" button does nothing. Set `x`.Then wait.', 4),
        ("يستغرق ذلك نحو 33.51 ثانية. من راجع #1؟ راجع د. Holm الملف.", 3), ("真的吗？！又断开了。“不要动它！”注释里写着。没有……至少这里没有。", 4), ("「また落ちました。」と書いています。（空です。）。ただ止まるだけです……。", 3),
        ("ทำไมเส้นทางยังอยู่ในตาราง ใครตรวจ#18055แล้วบ้างครับ", 2), ("... and then it restarts. Next.", 2), ("", 0), (None, 0), (" \n\t ", 0), ("?! ---", 0),
    ],
)
def test_counts(text, n):
    assert len(units(text, KNOWN)) == n, units(text, KNOWN)


LAYOUT = """\ufeff### Why it matters

It fails
on two lines. Then not.

- wait 1.5 s, then stop. Again
- see a.c, e.g. line 2
1. first
2) second

```c
int x; // One. Two.
```

On 5 Mar. 2025 at 18:22, some-one wrote:
> Quoted text runs
> over lines. Second.
>
>> Deeper.

2025-01-01 [quilld] went down. Reason: none
WARN a/b.c:3 took 1.2s. Retrying in 3s

Last one - twice
- twice.
(cherry picked from commit 0123456789abcdef)

Fixes: abcdef123456
Closes: #12
"""


def test_layout():
    first = [u.split("\n")[0][:12] for u in units(LAYOUT)]
    assert first == ["Why it matte", "It fails", "Then not.", "wait 1.5 s, ", "see a.c, e.g", "1. first", "2) second", "c", "On 5 Mar. 20", "Quoted text ", "Second.", "Deeper.", "2025-01-01 [", "WARN a/b.c:3", "Last one - t", "cherry picke", "Fixes: abcde", "Closes: #12"]


def test_line_ends_do_not_matter():
    for end in ("\r\n", "\r", "\u2028"):
        assert [x.split()[0] for x in units(LAYOUT.replace("\n", end))] == [x.split()[0] for x in units(LAYOUT)]


def test_document_evidence():
    assert len(units("The qrs. value is low. It is the Qrs. Value we want, and value it. So on.")) == 4
    assert len(units("The qrs. value is low. We met Qrs. Holm, and Holm left.")) == 2
    assert len(units("The tag moves. A tag is set. the next tag. Value.", {"set": NEVER, "tag": NEVER})) == 3
    assert len(units("See xyz. Holm there.", {"xyz": NEVER})) == 1 and len(units("See xyz. Holm there.")) == 2


def test_long_quotations_and_brackets_hold_their_stops():
    inner = "One is here. " * 400
    assert len(units(f"He wrote: “{inner}” and left. Next.")) == 2
    assert len(units(f"He wrote: \"{inner.strip()}\" and left. Next.")) == 2
    assert len(units(f"It ({inner.strip()}) goes on. Next.")) == 2
    assert len(units(f"It ({inner.strip()} goes on. Next.")) == 401
    assert len(units("a" * 3000 + "." + " Next.")) == 2 and len(units("x.Y" * 50000 + " z. Next.")) > 0


CORPUS = ["Der Abschn. 4 regelt das. Die Marke bleibt.\n\nDas regelt Abschn. 5 der Marke.", "Nach Hrn. Holm und Hrn. Berg geht es.\n\nSo sagt es Hrn. Dahl.", "Sie, insb. die Marke, bleibt. Die Sache ist so.\n\nDas gilt insb. der Sache wegen.",
          "Am 3. Lauf geht es.\n\nIm 4. Lauf auch. Die Sache blieb.", "Wir warten. Die Sache lief.\n\nAlle warten."] * 8


def evidence(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(CORPUS)], "doc_id bigint, text string")
    return docs, {r.key: {c: r[c] for c in "sdcpo" if r[c] is not None} for r in s.corpus_evidence(s.stop_counts(docs)).collect()}


def test_corpus_evidence(spark, monkeypatch):
    docs, known = evidence(spark)
    assert known["abschn"]["d"] is False and known["hrn"]["p"] is False and known["insb"]["s"] is False and known["#lauf"]["o"] is False
    assert "warten" not in known and "marke" not in known
    probe = ["Es gilt Abschn. 9 hier.", "Da ist Hrn. Stern.", "Man sieht insb. das.", "Der 7. Lauf ist es.", "Sie warten. Holm geht."]
    assert [len(units(t, known)) for t in probe] == [1, 1, 1, 1, 2]
    # The operator's join gives what the evidence gives text by text.
    got = sorted(tuple(r) for r in s.sentence_starts(docs).collect())
    assert got == sorted((i, at + 1) for i, t in enumerate(CORPUS) for at in s.unit_starts(t, known))
    monkeypatch.setattr(s, "SENT", 0)
    assert got == sorted(tuple(r) for r in s.sentence_starts(docs).collect())


def test_evidence_decides_more_than_lists(spark, monkeypatch):
    _, known = evidence(spark)
    texts = CORPUS + ["Dr. Holm sah Nr. 4 an. Die Sache, vgl. die Marke, blieb.", "The tag moves. A tag. See No. 4. It is so, etc. Some go."]
    full = [set(s.unit_starts(t, known)) for t in texts]
    bare = [set(s.unit_starts(t, {})) for t in texts]
    for name in ("LEADING", "TRAILING", "ARTICLES", "MONTHS"):
        monkeypatch.setattr(s, name, set())
    unlisted = [set(s.unit_starts(t, known)) for t in texts]
    changed = lambda a: sum(len(x ^ y) for x, y in zip(full, a))
    assert changed(unlisted) < changed(bare)


def test_operator(spark):
    docs = spark.createDataFrame([(1, "One. Two."), (2, None), (3, ""), (4, "word " * 60000 + "end. Next."), (None, "x")], "doc_id bigint, text string").selectExpr("*", "'c' AS start_pos", "'k' AS key")
    assert sorted(tuple(r) for r in s.sentence_starts(docs).collect()) == [(1, 1), (1, 6), (4, 1), (4, 300006)]
    assert s.sentence_starts(docs.limit(0)).count() == 0
    seen = list(s.contexts("Siehe vgl. mehrere, das vgl. Y und\n> z. B. Das.\n\nAm 3. Mai. Dr. R. Holm, das etc."))
    assert seen == [("vgl", "s", ""), ("#y", "f", ""), ("vgl", "p", "y"), ("z.b", "c", "das"), ("das", "f", ""), ("#mai", "o", ""), ("#dr", "f", ""), ("mai", "p", "dr"), ("dr", "p", "r"), ("r", "p", "holm"), ("etc", "f", "")]
