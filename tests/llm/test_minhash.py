"""Problem 2 against the exact join of all pairs."""

import random
import re

import numpy as np

from cascadelens.llm import codetokens, minhash

NOISE = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""", re.S)


def run_set(text):
    bare = NOISE.sub(lambda m: " " if m[0][0] == "/" else m[0][0] * 2, text or "")
    t = re.findall(r"\w+|[^\w\s]", bare)
    return set(zip(t, t[1:], t[2:], strict=False))


def functions(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta count size head tail left right")
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(3))
    texts = []
    for _ in range(25):
        lines = [f"{word()} = {word()}({word()}, {rng.randrange(99)});" for _ in range(rng.randint(3, 30))]
        texts.append("int f(void) {\n" + "\n".join(lines) + "\n}")
        for _ in range(rng.randint(0, 4)):
            edited = list(lines)
            for _ in range(rng.randint(0, 6)):
                k = rng.randrange(len(edited))
                edited[k] = rng.choice([f"{word()}++;", "", edited[k] + f" /* {word()} */", f'say("{word()}");'])
            texts.append("int f(void) {\n  " + "\n\t".join(edited) + "\n}")
    return texts + ["", None, "  ", "x y", "a b c", "a b c", 'a "q" \'r\' ü é 漢字 z', 'a "other" \'s\' ü é 漢字 z', "a /* open", "v " * 30_000, "v " * 30_001]


def test_pairs_like_the_exact_join(spark):
    texts = functions(11)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "fs_id bigint, content string, text string")
    members, pairs = minhash.near_duplicates(df, "fs_id", "content")
    pairs = pairs.cache()
    got = {tuple(r) for r in minhash.pairs_of_rows(members, pairs).collect()}
    sets = [run_set(t) for t in texts]
    want = {(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j]) - 1e-9}
    assert got == want and len(want) > 30
    groups = {r["row_id"]: r["group_id"] for r in minhash.groups(members, pairs).collect()}
    assert set(groups) == {i for i, s in enumerate(sets) if s}
    assert all(groups[i] == groups[j] for i, j in want)
    reached = {i: {i} for i in groups}
    for _ in range(len(texts)):
        for i, j in want:
            reached[i] |= reached[j]
            reached[j] |= reached[i]
    assert groups == {i: min(x) for i, x in reached.items()}


def test_recall_of_the_bands():
    n = minhash.bands_for(minhash.SIMILARITY, minhash.ROWS, minhash.RECALL)
    assert 1 - (1 - minhash.SIMILARITY**minhash.ROWS) ** n >= minhash.RECALL


def test_a_group_of_copies_is_one_class(spark):
    df = spark.range(500).selectExpr("id as fs_id", "'int f() { return a + b; }' as content")
    members, pairs = minhash.near_duplicates(df, "fs_id", "content")
    assert pairs.count() == 0 and {r["rep"] for r in members.collect()} == {0}
    assert {r["group_id"] for r in minhash.groups(members, pairs).collect()} == {0}


def test_tokens_are_hashed_alike_in_any_batch():
    texts = ["foo(bar, 1);", "été = 'x';", "foo", ""]
    alone = [codetokens.token_hashes([t])[0].tolist() for t in texts]
    hashes, owners = codetokens.token_hashes(texts)
    assert [hashes[owners == i].tolist() for i in range(4)] == alone
    assert alone[0][0] == alone[2][0] and len(alone[0]) == 7


def test_empty(spark):
    df = spark.createDataFrame([], "fs_id bigint, content string")
    members, pairs = minhash.near_duplicates(df, "fs_id", "content")
    assert minhash.pairs_of_rows(members, pairs).count() == 0 and minhash.groups(members, pairs).count() == 0
    assert np.array_equal(minhash.band_hashes(np.zeros(0, np.uint64), np.zeros(0, int), 2, 3, 2), np.zeros((2, 3)))


def test_meetings_in_cells_are_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CELL", 4)
    monkeypatch.setattr(minhash, "LOOKED", 1)
    rows = [(i, 7) for i in range(37)] + [(i, 8) for i in range(30, 40)] + [(50, 9)]
    got = sorted(tuple(r) for r in minhash._meetings(spark.createDataFrame(rows, "id bigint, band bigint")).collect())
    want = sorted((a, b) for a, k in rows for b, m in rows if k == m and a < b)
    assert got == want
    monkeypatch.setattr(minhash, "CELL", 1000)
    assert sorted(tuple(r) for r in minhash._meetings(spark.createDataFrame(rows, "id bigint, band bigint")).collect()) == want
