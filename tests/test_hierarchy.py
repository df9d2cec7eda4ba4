"""Problem 4 against a plain walk over random forests with loops."""

import random

import pytest

from cascadelens.operators import hierarchy as h


def brute(edges):
    up, nodes = {}, set()
    for p, c in edges:
        nodes |= {x for x in (p, c) if x is not None}
        if p is not None and c is not None:
            up[c] = min(p, up.get(c, p))
    out = {}
    for n in nodes:
        path = [n]
        while path[-1] in up and up[path[-1]] not in path:
            path.append(up[path[-1]])
        out[n] = ("CYCLE", -1, None) if path[-1] in up else (path[-1], len(path) - 1, " > ".join(reversed(path)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(max(1, i - rng.choice([1, 2, 40])), i + 1) - 1}", f"n{i}") for i in range(1, 120)]
    edges += [("n5", "hub")] + [("hub", f"leaf{i}") for i in range(60)]
    edges += [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("c2", "below"), ("below", "far"), ("self", "self"), (None, "alone"), ("other", None), ("n1", "n2"), ("n1", "n2")]
    df = spark.createDataFrame([(*e, "x") for e in edges], "p string, c string, id string")
    places, looped = h.decompose(df, "p", "c")
    places = places.cache()
    want = brute(edges)
    rows = {r["unique_id"]: r for r in places.collect()}
    assert {k: (r["root_id"], r["depth"]) for k, r in rows.items()} == {k: v[:2] for k, v in want.items()}
    assert {r["unique_id"]: r["path"] for r in h.full_paths(places).collect()} == {k: v[2] for k, v in want.items()}
    below = {k: {x for x, v in want.items() if v[2] and x != k and f" > {k} > " in f" > {v[2]} > "} for k, v in want.items() if v[1] >= 0}
    assert {k: r["n_descendants"] for k, r in rows.items() if r["depth"] >= 0} == {k: len(v) for k, v in below.items()}
    for root in {v[0] for v in want.values() if v[1] >= 0}:
        at = sorted(rows[k]["first_pos"] for k, v in want.items() if v[0] == root)
        assert at == list(range(len(at)))
    asked = spark.createDataFrame([("hub",), ("n5",), ("c1",)], "unique_id string")
    got = {}
    for r in h.descendants(places, asked).collect():
        got.setdefault(r["ancestor_id"], set()).add(r["unique_id"])
    assert got == {k: below[k] for k in ("hub", "n5")}
    loops = {r["unique_id"]: (r["loop_id"], r["on_loop"]) for r in h.loops(looped).collect()}
    assert loops == {"c1": ("c1", True), "c2": ("c1", True), "c3": ("c1", True), "below": ("c1", False), "far": ("c1", False), "self": ("self", True)}


def test_a_long_chain_and_nothing(spark):
    df = spark.createDataFrame([(f"k{i:04d}", f"k{i + 1:04d}") for i in range(300)], "p string, c string")
    assert h.decompose(df, "p", "c")[0].agg({"depth": "max"}).first()[0] == 300
    empty = spark.createDataFrame([], "p string, c string")
    places, looped = h.decompose(empty, "p", "c")
    assert places.count() == 0 and h.loops(looped).count() == 0 and h.full_paths(places).count() == 0
