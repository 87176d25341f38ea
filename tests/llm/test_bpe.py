import random
from pathlib import Path

import pytest

from changelode.llm import bpe

pytestmark = pytest.mark.skipif(not Path(bpe.VOCABULARY).exists(), reason="no vocabulary here")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    public = Tokenizer.from_file(bpe.VOCABULARY)
    public.encode_special_tokens = True
    return bpe.Encoder(Path(bpe.VOCABULARY).read_text(encoding="utf-8")), public


def test_equals_the_public_library(both):
    own, public = both
    rng = random.Random(7)
    pools = ["abcdeéà 漢字テスト0123 \t\n\r\u3000\u200b…—’'st<>&#αβγ😀👍🏽", "ab ", "aeinrst", "ไทยภาษา ", "हिन्दी भाषा ", "<|endoftext|>", "  \n\n\t "]
    texts = ["".join(rng.choice(p) for _ in range(rng.randint(1, 80))) for p in pools for _ in range(300)] + ["<|endoftext|>", " " * 500, "a" * 3000, "字" * 2000, "I'll we've it's'S 'LL"]
    for t in texts:
        assert own.encode(t) == public.encode(t, add_special_tokens=False).ids, t


def test_every_entry_is_made_by_its_own_merges(both):
    own, _ = both
    for text, i in list(own.id.items())[::37]:
        assert own.piece(text.encode("latin-1").decode("utf-8", "surrogateescape")) == (i,) if _utf8(text) else True


def _utf8(text):
    try:
        text.encode("latin-1").decode("utf-8")
        return True
    except UnicodeDecodeError:
        return False


def test_round_trip(both):
    own, _ = both
    back = {i: t for t, i in own.id.items()}
    for text in ("naïve 漢字 😀\r\n\tx  y", "ไทย हिन्दी"):
        assert "".join(back[i] for i in own.encode(text)).encode("latin-1").decode() == text


def test_operator(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "x " * 40000), (1, "hello world")], "doc_id bigint, text string").selectExpr("*", "'c' AS ids", "2 AS n_tokens")
    got = sorted((r.doc_id, len(r.ids)) for r in bpe.encode(df).collect())
    assert [g[0] for g in got] == [1, 1, 2, 3, 4] and got[2][1] == got[3][1] == 0
    assert sorted((r.doc_id, r.n_tokens) for r in bpe.count_tokens(df).collect()) == got
    assert bpe.encode(df.limit(0)).count() == 0
