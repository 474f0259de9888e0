import random

import pytest

from capquill.llm import token_counts as T
from tests.llm.cases import SF, awkward

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path(T.VOCABULARY)


def library(texts):
    return [len(e) for e in tokenizers.Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def check(df, rows):
    given = [(r.doc_id, r.text or "") for r in df.collect()]
    counts = library([text for _, text in given])
    want = sorted((i, len(text.encode()), n, n > T.LIMIT) for (i, text), n in zip(given, counts))
    assert sorted(tuple(r) for r in rows) == want


def test_sample_table(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"), T.op12_token_counts(spark, SF).collect())


def test_awkward_rows(spark):
    df = awkward(spark).where("doc_id is not null")
    check(df, T.count_tokens(df, PATH).collect())
    out = T.count_tokens(awkward(spark), PATH)
    assert out.count() == awkward(spark).count() and out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert T.count_tokens(df.limit(0), PATH).count() == 0


def test_words_of_every_code_point():
    points = [chr(x) for x in range(0x110000) if not 0xD800 <= x < 0xE000]
    texts = [f"{''.join(points[i : i + 7])} {points[i]}{points[i]}x1{points[i]}  " for i in range(0, len(points), 7)]
    assert T.Counter(T.read_vocabulary(PATH)).counts(texts) == library(texts)


def test_mixtures_specials_and_long_texts(monkeypatch):
    r = random.Random(2)
    bits = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "日本", "'s", "'ll", "1", "<|endoftext|>", "<|endoftext", "#", "\xa0", "\x1c", "aaaa", "ing", "-", "\U0001f600"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(60))) for _ in range(3000)]
    texts += ["x" * 50_001, "ab" * 20_000, "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)), " ".join(texts[:500])]
    merges = T.read_vocabulary(PATH)
    assert T.Counter(merges).counts(texts) == library(texts)
    for name, value in (("SLICE", 1000), ("PIECE", 7), ("REMEMBERED", 100)):  # the same by pieces, and with little kept
        monkeypatch.setattr(T, name, value)
    assert T.Counter(merges).counts(texts) == library(texts)


def test_other_kinds_are_refused():
    with pytest.raises(ValueError, match="plain byte-level BPE"):
        T.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
