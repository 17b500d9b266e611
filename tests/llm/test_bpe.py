import random

import pytest

from quireloom.llm import bpe as B

TEXTS = ["", "Hello world's  end", "'s's'll x'", "a" * 5000, " " * 5000, "\n\n  x \t\r\n", "<|endoftext|> plain", "naïve café 中文🙂", "x\x00\x1c\x85 y", "don't we'LL 've", "²Ⅷ٣ 1 2"]


@pytest.fixture(scope="module")
def library():
    tok = pytest.importorskip("tokenizers")
    t = tok.Tokenizer.from_file(B.vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda xs: [x.ids for x in t.encode_batch(xs, add_special_tokens=False)]


def test_same_as_library(library):
    r = random.Random(4)
    alphabet = " '  \n\t\r sdmtlvre'abcXYZ019²Ⅷ٣é中文🙂!.,-_{}‍́\x00\x1c\x85᠎ <|endoftext|>"
    xs = TEXTS + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(5000)]
    got = B.Encoder(B.vocabulary_path()).encode(xs)
    assert [list(x) for x in got] == library(xs)


def test_round_trip_and_offsets():
    e = B.Encoder(B.vocabulary_path())
    for t in TEXTS:
        assert B.decode([int(i) for i in e.encode([t])[0]]) == t
        o = e.offsets(t)
        data = t.encode()
        assert b"".join(data[a:b] for a, b, _ in o) == data and all(B.decode(list(i)).encode() == data[a:b] for a, b, i in o if data[a:b].isascii())


def test_table(spark, library):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] + [(98, None, None)], "doc_id long, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in B.encode_table(df).collect()}
    assert got == dict(enumerate(library(TEXTS))) | {98: []}
    n = {r.doc_id: r.n_tokens for r in B.encode_table(df, lengths_only=True).collect()}
    assert n == {k: len(v) for k, v in got.items()}
    assert B.encode_table(df.limit(0)).count() == 0
