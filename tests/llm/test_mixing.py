"""Problem 9: the water level, the caps, the shares."""

import os
import random

import pytest

from cascadelens.llm import bpe, mixing

TARGETS = "source string, target_share double, max_repeat int"


def test_water_fill():
    for seed in range(50):
        rng = random.Random(seed)
        names = "abcdef"
        sizes = {s: rng.choice([0, 10, 100, 1000, 10000]) for s in names}
        weights = {s: rng.random() for s in names}
        most = {s: rng.randint(0, 5) for s in names}
        epochs = mixing.water_fill(sizes, weights, most)
        usable = [s for s in names if sizes[s] and most[s]]
        assert all(epochs[s] <= most[s] + 1e-9 for s in names)
        goal = sum(sizes[s] for s in usable)
        total = sum(epochs[s] * sizes[s] for s in names)
        assert total == pytest.approx(min(goal, sum(most[s] * sizes[s] for s in usable)))
        level = [epochs[s] * sizes[s] / weights[s] for s in usable if epochs[s] < most[s] - 1e-9]
        assert not level or max(level) == pytest.approx(min(level))
        assert all(most[s] * sizes[s] / weights[s] <= max(level) + 1e-6 for s in usable if level and epochs[s] >= most[s] - 1e-9)


@pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary here")
def test_mixture(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(["word"] * rng.randint(1, 9)), "big", 1) for i in range(600)] + [(1000 + i, "a b c", "small", 1) for i in range(20)]
    docs += [(2000, None, "small", 1), (2001, "", "big", 1), (2002, "x", None, 1), (2003, "x", "untold", 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, uses int")
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.3, 3), ("absent", 0.2, 4), (None, 0.1, 1), ("small", 0.3, 3)], TARGETS)
    uses, shares = mixing.mixture(df, targets)
    rows = uses.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(d[0] for d in docs if d[2] in ("big", "small"))
    by = {r["source"]: r for r in shares.collect()}
    assert all(r["uses"] <= by[r["source"]]["max_repeat"] for r in rows)
    assert all(r["uses"] == 3 for r in rows if r["source"] == "small") and by["small"]["epochs"] == 3
    assert abs(by["big"]["mixed_tokens"] - by["big"]["epochs"] * by["big"]["tokens"]) <= 9
    assert by["absent"]["mixed_tokens"] == 0 and sum(r["actual_share"] for r in by.values()) == pytest.approx(1)
    assert {(r["doc_id"], r["uses"]) for r in mixing.mixture(df.repartition(3), targets)[0].collect()} == {(r["doc_id"], r["uses"]) for r in rows}


@pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary here")
def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    uses, shares = mixing.mixture(docs, spark.createDataFrame([("a", 1.0, 1)], TARGETS))
    assert uses.count() == 0 and [r["actual_share"] for r in shares.collect()] == [0.0]
    assert mixing.mixture(docs, spark.createDataFrame([], TARGETS))[1].count() == 0
