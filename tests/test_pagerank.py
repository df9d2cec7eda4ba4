"""PageRank against many plain rounds, on a graph that is not settled after 20."""

from pyspark.sql import functions as F

from cascadelens.operators import graph


def plain(edges, rounds):
    ids = sorted({v for e in edges for v in e})
    out = {v: [x for s, x in edges if s == v] for v in ids}
    rank = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(rounds):
        lost = sum(rank[v] for v in ids if not out[v])
        rank = {v: 0.15 / len(ids) + 0.85 * (lost / len(ids) + sum(rank[s] / len(out[s]) for s in ids if v in out[s])) for v in ids}
    return rank


def test_ranks_are_settled(spark):
    edges = [("a", "b"), ("b", "a"), ("a", "a"), ("c", "a")]
    want, early = plain(edges, 500), plain(edges, 20)
    assert max(abs(early[v] - want[v]) for v in want) > 1e-9
    df = spark.createDataFrame(edges, "s string, x string").withColumn("w", F.lit(1.0))
    got = {r["id"]: r["rank"] for r in graph.pagerank(df, "s", "x", "w").collect()}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-9 for v in want)
