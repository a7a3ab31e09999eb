"""Problem 7: ids equal to those of the tokenizer on the whole text, whatever the chunks; exact round trip."""

import os
import random

import pytest
from pyspark.sql import functions as F

from treeloom.llm import tokenize as T

PATH = os.path.join(T.TOKENIZERS, T.VOCABULARY)


def texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    return [
        None, "", " ", "\n\n\r\n \t", "x", "a" * 700, " " * 500 + "x" + " " * 300, "\n" * 400, "don't we'll they're" * 40,
        " ".join(word() for _ in range(300)), "".join(rng.choice("0123456789abcdef") for _ in range(900)),
        "日本語のテキスト、" * 60, "é́👩‍👩‍👧 ﷽ ​  x" * 30, "\x00\x1f\x7f" * 50, "a b  c   d    " * 50, "1 22 333 4444 " * 40 + "!" * 300,
        "".join(rng.choice("a b\n\t.,'s1é ") for _ in range(1500)),
    ]


@pytest.mark.parametrize(("long_chars", "chunk", "overlap"), [(10**9, 100, 10), (50, 64, 16), (0, 7, 3), (20, 33, 200)])
def test_ids(spark, long_chars, chunk, overlap):
    data = list(enumerate(texts()))
    df = spark.createDataFrame(data, "key long, body string").withColumn("text", F.lit("x")).withColumn("ids", F.lit(1)).withColumn("i", F.lit(1))
    enc = T.load(PATH)
    want = {k: enc.encode_ordinary(t or "") for k, t in data}
    kw = {"long_chars": long_chars, "chunk": chunk, "overlap": overlap}
    got = T.encode(df, "key", "body", PATH, **kw).collect()
    assert len(got) == len(data) and {r[0]: list(r[1]) for r in got} == want
    sizes = T.encode(df, "key", "body", PATH, count_only=True, **kw).collect()
    assert {r[0]: r[1] for r in sizes} == {k: len(v) for k, v in want.items()}


def test_round_trip():
    enc = T.load(PATH)
    for t in texts():
        if t is not None:
            assert T.decode(enc.encode_ordinary(t), PATH) == t


def test_boundaries_are_those_of_the_whole_text():
    for t in texts():
        if t:
            assert set(T.boundaries(t, 0, 50)) == {m.start() for m in T._pattern().finditer(t) if m.start() <= 50}


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert T.encode(df, "doc_id", "text", PATH).count() == 0


def test_null_and_repeated_keys_of_long_texts(spark):
    long, longer = "one two, three. " * 30, "four " * 200
    for kind, keys in (("long", [None, None, 7, 7, 7]), ("string", [None, None, "k", "k", "k"])):
        df = spark.createDataFrame(list(zip(keys, [long, longer, long, longer, "short"], strict=True)), f"key {kind}, body string")
        enc = T.load(PATH)
        want = sorted(((k, enc.encode_ordinary(t)) for k, t in zip(keys, [long, longer, long, longer, "short"], strict=True)), key=repr)
        got = T.encode(df, "key", "body", PATH, long_chars=100, chunk=64, overlap=16).collect()
        assert sorted(((r[0], list(r[1])) for r in got), key=repr) == want
