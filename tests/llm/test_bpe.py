import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from terrapanel.llm.bpe import Encoder, encode

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "aa", "the", "'s", "'LL", "É", "é", "İ", "Σ", "ς", "ΑΣ ", "ß", "ſ", "K", "9", "½", "Ⅷ", "\x85", "\x1c", "\xa0", "​", "\x00", "中", "😀", "👍🏽",
         "<|endoftext|>", "<|startoftext|>", "<|", "|>", " ", "\n", "!!", "...", "ạ̈", "한", "ﬁ", "ǅ", "क", "x", "in", "tion", "ee", "oo", "՘", "Ɤ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, encoding="utf-8") as f:
        return Encoder(f.read())


def same(own, library, text):
    ids, decoded = own.encode(text)
    want = library.encode(text, add_special_tokens=False).ids
    return np.frombuffer(ids, "<u4").tolist() == want and decoded == library.decode(want, skip_special_tokens=False)


def test_mixed_scripts(own, library):
    draw = random.Random(1)
    for _ in range(4000):
        text = "".join(draw.choice(PARTS) for _ in range(draw.randint(0, 12)))
        assert same(own, library, text), repr(text)


def test_random_words(own, library):
    draw = random.Random(2)
    for _ in range(4000):
        text = "".join(draw.choice("aeinorstthhl") for _ in range(draw.randint(1, 30)))
        assert same(own, library, text), text


def test_long_word(own, library):
    assert same(own, library, "abracadabra" * 3000)


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "text", "1 AS ids", "'x' AS decoded")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = encode(docs, PATH).collect()
    assert len(out) == len(texts)
    for r in out:
        want = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["n_tokens"] == len(want)
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)


def test_nulls_and_empty(spark):
    rows = [(1, None), (2, ""), (None, "a"), (3, "a"), (3, "a")]
    out = encode(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["decoded"]) for r in out) == [(0, 1, "a</w>"), (1, 0, ""), (2, 0, ""), (3, 1, "a</w>"), (3, 1, "a</w>")]
    assert encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
