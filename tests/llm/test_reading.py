"""Problem 10: prose, language, the ordinal model, held-out accuracy."""

import random

import numpy as np

from cascadelens.llm import reading as r


def test_own_prose():
    text = "# Heading\n\nOn list, someone wrote:\n> Quoted words here.\n\nReal words\nare here. More of it!\n\n```\nint x;\n```\n    indented();\n- a bullet says so.\nFixes: abc123\nSee https://x.example/y now.\n/*\n * In a comment. It\n * goes on.\n */\n"
    assert r.own_prose(text) == ["Real words are here.", "More of it!", "a bullet says so.", "See  now.", "In a comment.", "It goes on."]
    assert r.own_prose("```\nopen fence") == [] and r.own_prose("") == []


def test_language():
    words = lambda s: r._words(s)
    assert r.is_english(words("The buffer is not freed by the parser when it fails"), 40, 40)
    assert not r.is_english(words("Die Bibliothek prüft den Puffer nicht und der Fehler ist da"), 40, 40)
    assert not r.is_english(words("El fallo no es de la biblioteca"), 30, 30)
    assert not r.is_english([], 0, 0)


def test_ordinal_model_finds_the_order():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 3))
    known = 2 * x[:, 0] - x[:, 1]
    s = known + rng.logistic(size=3000)
    y = (s > -1).astype(int) + (s > 1.5)
    m = r.fit_ordinal(x[:2000], y[:2000])
    p = r.chances(x[2000:], m)
    assert np.allclose(p.sum(1), 1) and (p >= 0).all() and m["cuts"][0] < m["cuts"][1]
    # as good as knowing the score without its noise
    best = (((known > -1).astype(int) + (known > 1.5)) == y)[2000:].mean()
    assert ((p.cumsum(1) < 0.5).sum(1) == y[2000:]).mean() > best - 0.02
    assert abs(m["w"][0] / m["w"][1] + 2) < 0.4 and abs(m["w"][2]) < 0.2


def documents(n):
    rng = random.Random(7)
    easy = ["The key is old.", "You can drop the tag now.", "We fix the name.", "It was not the port."]
    middle = ["After the update the parser rejects the header before it reaches the buffer.", "This change makes the handler check the client so that it can not crash."]
    hard = ["Notwithstanding the reconfiguration of heterogeneous infrastructures, which the characterisation of dependencies presupposes, the implementation remains contingent upon considerations that the literature has systematically neglected."]
    out = []
    for i in range(n):
        k = i % 3
        out.append((i, " ".join(rng.choice((easy, middle, hard)[k]) for _ in range(rng.randint(2, 6))), r.BANDS[k]))
    return out


def test_held_out(spark):
    docs = documents(240)
    extra = [(9000, None), (9001, ""), (9002, "  \n"), (9003, "Der Fehler ist nicht in der Bibliothek und wird nicht geprüft."), (9004, "```\ncode\n```"), (9005, "The word. " * 20_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in docs] + [(*e, "x") for e in extra], "doc_id bigint, text string, band string")
    labels = spark.createDataFrame([(i, f"r{k}", b, "x") for i, _, b in docs[:120] for k in range(2)] + [(5, "r9", "odd", "x"), (None, "r9", "hard", "x"), (777, "r1", "easy", "x")], "doc_id bigint, rater string, band string, text string")
    got = {x["doc_id"]: x for x in r.reading_levels(df, labels).collect()}
    assert len(got) == len(docs) + len(extra)
    assert np.mean([got[i]["band"] == b for i, _, b in docs[120:]]) > 0.95
    assert all(got[i]["band"] is None and got[i]["level"] is None for i in (9000, 9001, 9002, 9003, 9004)) and got[9005]["english"]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, rater string, band string")
    assert r.reading_levels(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "The key is old and it is not in the port.")], "doc_id bigint, text string")
    assert [x["band"] for x in r.reading_levels(one, labels).collect()] == [None]
