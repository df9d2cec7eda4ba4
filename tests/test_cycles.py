"""Cycle counts against brute force over all paths."""

import random

from cascadelens.operators import graph


def brute(edges):
    """Every simple cycle once, from its least node."""
    below = {}
    for s, x in {e for e in edges if None not in e}:
        below.setdefault(s, set()).add(x)
    counts, todo = {}, [[v] for v in below]
    while todo:
        path = todo.pop()
        for x in below.get(path[-1], ()):
            if x == path[0]:
                for e in zip(path, [*path[1:], x], strict=True):
                    counts[e] = counts.get(e, 0) + 1
            elif x > path[0] and x not in path:
                todo.append([*path, x])
    return counts


def test_counts_without_spark():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 7)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 18))]
        assert graph.count_cycles(sorted({e for e in edges if e[0] != e[1]})) == {e: k for e, k in brute(edges).items() if e[0] != e[1]}
    loop = [(i, (i + 1) % 20_000) for i in range(20_000)]
    assert graph.count_cycles(loop) == dict.fromkeys(loop, 1)


def test_cycles_of_any_length(spark):
    rng = random.Random(2)
    edges = [(f"l{i:02}", f"l{(i + 1) % 12:02}") for i in range(12)] + [("l03", "tail"), ("head", "l05"), ("l04", "l02")]
    edges += [("one", "one"), ("l07", "l07"), (None, "l01"), ("l01", None), *[(f"t{i}", f"t{i + 1}") for i in range(9)]]
    edges += [(f"r{rng.randrange(14)}", f"r{rng.randrange(14)}") for _ in range(24)] + [("l00", "l01")]
    df = spark.createDataFrame(edges, "a string, b string")
    got = {(r["s"], r["x"]): r["n_cycles"] for r in graph.cycle_edges(df, "a", "b").collect()}
    want = brute(edges)
    assert got == want and want["l11", "l00"] == 1 and want["one", "one"] == 1
    assert graph.cycle_edges(df.limit(0), "a", "b").count() == 0
