"""Problem 8 against a public encoder of the same vocabulary; exact round trips."""

import base64
import os
import random

import pytest

from cascadelens.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary here")
tiktoken = pytest.importorskip("tiktoken")

TEXTS = [
    "Hello world, it's 12345 tests!\n\n  two  spaces\t\ttabs",
    "naïve café ﬁ 漢字かな 😀👩‍👩‍👧 ​",
    "a" * 5000,
    "ab" * 3000 + " " * 700 + "xyz123" * 50,
    " leading and trailing  ",
    "<|endoftext|>",
    "\x00\x01\x7f",
    "don't we'll THEY'RE",
]


@pytest.fixture(scope="module")
def encoder():
    with open(bpe.VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids(spark, encoder):
    rng = random.Random(1)
    texts = TEXTS + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 1000), 0x4E00 + rng.randrange(500), 32])) for _ in range(rng.randrange(200))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(-1, None, "x"), (-2, "", "x")], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in bpe.token_ids(df, "doc_id", "text").collect()}
    assert got.pop(-1) == [] and got.pop(-2) == []
    assert got == {i: encoder.encode_ordinary(t) for i, t in enumerate(texts)}
    assert all(encoder.decode(got[i]) == t for i, t in enumerate(texts))
    counts = {r["doc_id"]: r["n_tokens"] for r in bpe.token_counts(df, "text", ["doc_id"]).collect()}
    assert counts == {-1: 0, -2: 0} | {i: len(x) for i, x in got.items()}


def test_the_heap_and_the_matrix_agree():
    vocab = bpe.vocabulary(bpe.VOCABULARY)
    rng = random.Random(2)
    for _ in range(40):
        word = "".join(rng.choice("abcehilnorst ") for _ in range(rng.randint(1, 400)))
        vocab.known.clear()
        vocab.encode_words([word])
        assert vocab.known[word].tolist() == vocab.merge_long(word.encode()).tolist()


def test_empty(spark):
    assert bpe.token_ids(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").count() == 0
