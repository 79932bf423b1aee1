import random

import public_tokenizers
import pytest
import sentencepiece

from kerege.llm import tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_bytes string, n_tokens long"


@pytest.fixture(scope="module")
def both():
    return sentencepiece.SentencePieceProcessor(model_file=PATH), tokens.PieceCounter(PATH)


ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "▁x", "x▁▁y", "\n\n", "a\n\nb\tc", "<s> x </s>", "<0x0A>", "ﬁ①Ａ", "a　b\xa0c", "é" * 50, "aaaa" * 40, " " * 77, "=" * 99, "\x00", "😀x😀", "<unk>", "The the, THE-the"]


@pytest.mark.parametrize("text", ODD)
def test_odd(both, text):
    assert both[1].count([text]) == [len(both[0].encode(text))]


def test_random(both):
    rng = random.Random(5)
    parts = ["the", "ing", "tion", " ", " ", " ", "\n", "a", "b", "é", "ß", "0", "12", ".", ",", "▁", "мир", "字", "😀", "aa", "--", "\t", "  "]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 60))) for _ in range(3000)]
    texts += ["".join(rng.choices("abcdeftinos", k=n)) for n in (500, 5000, 30000)]
    assert both[1].count(texts) == [len(x) for x in both[0].encode(texts)]


def test_kept_counts_are_dropped(both):
    counter = tokens.PieceCounter(PATH, kept=2)
    assert [counter.count([f"word{k} other{k}"])[0] for k in range(5)] == [len(both[0].encode(f"word{k} other{k}")) for k in range(5)]


def test_rows(spark, both):
    rows = [(1, None, "x", 1), (1, "a b", None, None), (None, "", "x", 1), (2, "é " * 40000, "x", 2)]
    got = [tuple(r) for r in tokens.token_counts(spark.createDataFrame(rows, SCHEMA), PATH).collect()]
    want = [(d, len((t or "").encode()), len(both[0].encode(t or "")), len(both[0].encode(t or "")) > 4096) for d, t, _, _ in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert tokens.token_counts(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_query(spark, sf, both):
    got = {r.doc_id: r.n_tokens for r in tokens.op9_rank_synchronous(spark, sf).collect()}
    assert got == {r.doc_id: len(both[0].encode(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
