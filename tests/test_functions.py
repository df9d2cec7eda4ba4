"""Known values of the scalar functions and the graph and clone operators against brute force."""

import datetime as dt
import hashlib
import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cascadelens.functions import hashing as H
from cascadelens.functions import naming as N
from cascadelens.functions import text as T
from cascadelens.functions import version as V
from cascadelens.operators import clones, graph, knowledge, tpl


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "tag, want",
    [("curl-7_65_3", "7.65.3"), ("v2.6.12-rc2", "2.6.12"), ("OpenSSL_1_0_2k", "1.0.2"), ("R_2_2_6", "2.2.6"), ("flex-2-5-5b", "2.5.5"), ("release-2020.10.1", "2020.10.1"), ("v1.2.2021", "1.2"), ("20200101", "2020"), ("libpng-1.6.0beta01", "1.6.0"), ("VER-2-4-12", "2.4.12"), ("1.2.3.4", "1.2.3"), ("main", None), (None, None)],
)
def test_extract_version(spark, tag, want):
    assert one(spark, V.extract_version, tag) == want


def test_versions(spark):
    assert tuple(one(spark, V.dependency, "^1.2.3-rc")) == (None, "^1.2.3-rc", "^1.2.3-rc")
    assert sorted(["v1.10", "v1.9", "v1.009a", "v2"], key=lambda t: one(spark, V.sort_key, t)) == ["v1.9", "v1.009a", "v1.10", "v2"]
    assert [one(spark, V.is_valid, v) for v in ("1.0.2", "1.0.2k", "-", "*", "1.2.3.4")] == [True, False, False, False, False]
    assert [one(spark, V.major_minor, v) for v in ("2.6.12", "7")] == ["2.6", ""]
    assert [tuple(one(spark, V.dependency, v)) for v in ("^4.2.1", "~4.2", "1.0")] == [("^", "4", "4.2.1"), ("~", "4.2", "4.2"), (None, "1.0", "1.0")]
    assert one(spark, lambda c: V.compare(c, F.lit("1.10.0")), "1.9.0") == -1 and one(spark, lambda c: V.compare(c, F.lit("1.9")), "1.9") == 1


def test_text_and_hashes(spark):
    assert one(spark, T.preprocess, 's = "http://x"; /*c*/') == 's = "http:'
    assert one(spark, H.md5_low64, "keyword_int") == 5502589144717383755
    assert one(spark, lambda c: H.hamming(c, F.lit(255)), -1, "bigint") == 56
    assert [one(spark, T.feature_class, x) for x in ("my_var", "NULL", "x1", "int", "=")] == ["operator", "identifier", None, "keyword", "operator"]
    assert one(spark, T.without_comments, 's = "//no"; // yes\n\n /* gone\n */ t();') == 's = "//no";\nt();'
    long = '"' + "a\\\\n" * 50_000 + '";'
    assert one(spark, T.without_comments, long) == long and one(spark, T.preprocess, "/*" + "x\n" * 90_000 + "*/y" + "'b" * 90_000 + "'") == "y" + "''b" * 45_000 + "'"
    assert one(spark, T.extracted_functions, "int a(int x){ return 1; }\nstatic int b(int y){}\nchar *c(void){}") == ["int a(int x){ return 1; }"]
    assert one(spark, lambda c: F.length(T.without_huge_arrays(c)), "y" + "0x1," * 10_001) == 1


def test_simhash(spark):
    df = spark.createDataFrame([(1, "int = a"), (2, ""), (3, None), (4, "a " * 60_000)], "fs_id bigint, content string")
    got = {r["fs_id"]: r["fingerprint"] for r in H.simhash(df, "fs_id", "content").collect()}
    assert set(got) == {1, 2, 4} and got[2] == 0
    rows = {r["feature"]: r["n"] for r in H.features(df.where("fs_id = 4"), "fs_id", "content").collect()}
    assert rows == {"identifier_a": 60_000, "bigram_a_a": 59_999}


def test_names_and_paths(spark):
    assert tuple(one(spark, N.parsed_cpe, "cpe:2.3:a:haxx:curl:7.65.3:*:*:*:*:*:*:*")) == ("a", "haxx", "curl", "7.65.3")
    assert [one(spark, N.is_test_path, p) for p in ("src/Test/a.c", "src/testing/a.c")] == [True, False]
    assert [one(spark, N.is_library_file, p) for p in ("src/a.c", "tests/a.c", ".git/a.h", "./a.hpp", "a.C", "test.c")] == [True, False, False, True, False, True]
    assert one(spark, N.path_segments, "Src/Zlib/Inflate.tab.c") == ["src", "zlib", "inflate.tab"]
    assert [tuple(one(spark, N.split_repo_key, k)) for k in ("a%b", "ab", "a%b%c")] == [("a", "b"), (None, None), (None, None)]


def test_similar_functions_like_the_nested_loop(spark, monkeypatch):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(20)] + [0]
    rows = []
    for i in range(240):
        f = rng.choice(base)
        for _ in range(rng.randrange(12)):
            f ^= 1 << rng.randrange(64)
        birth = None if rng.random() < 0.1 else dt.datetime(2020, 1, 1 + rng.randrange(20))
        rows.append((i, f"r{rng.randrange(6)}", f - (1 << 64) if f >> 63 else f, birth))
    rows.append((999, "r0", None, None))
    df = spark.createDataFrame(rows, "id bigint, repo string, fingerprint bigint, birth timestamp")
    got = {(r["id"], r["repo_b"]) for r in clones.similar_functions(df, df).collect()}
    old = lambda a, b: a is None or b is None or b < a
    want = {(i, rb) for i, ra, f, x in rows for _, rb, g, y in rows if f is not None and g is not None and ra != rb and bin((f ^ g) & ((1 << 64) - 1)).count("1") <= 8 and old(x, y)}
    assert got == want
    monkeypatch.setattr(clones, "CELL", 3)
    assert {(r["id"], r["repo_b"]) for r in clones.similar_functions(df, df).collect()} == want


def test_fingerprints_in_a_task_like_all_pairs(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, 30, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (600, 7), dtype=np.uint64), axis=1)
    f = np.unique(rng.choice(base, 600) ^ flips)
    g = np.unique(np.r_[f[:100], rng.choice(base, 200), base[:1] ^ np.arange(300, dtype=np.uint64)])
    alike = lambda x, y: {(i, j) for i, a in enumerate(x.tolist()) for j, b in enumerate(y.tolist()) if (a ^ b).bit_count() <= 8}
    want, across = {(i, j) for i, j in alike(f, f) if i < j}, alike(f, g)
    assert want and across
    for most in (clones.PAIRS, 200):  # compared pair by pair, and cut into keys again and again
        monkeypatch.setattr(clones, "PAIRS", most)
        for pairs, x, y in ((want, f, None), (across, f, g), ({(j, i) for i, j in across}, g, f), (set(), f[:1], None), (set(), f[:0], g)):
            i, j = clones._near(x, y, 8)
            assert len(i) == len(pairs) and set(zip(i.tolist(), j.tolist(), strict=True)) == pairs


def test_fingerprints_of_two_sides(spark, monkeypatch):
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(8)]
    some = lambda n: {rng.choice(base) ^ sum({1 << rng.randrange(63) for _ in range(rng.randrange(8))}) for _ in range(n)}
    both = some(20)
    left, right = some(60) | both, some(90) | both
    want = sorted((a, b) for a in left for b in right if (a ^ b).bit_count() <= 8)
    make = lambda fs, name: spark.createDataFrame([(f,) for f in fs], f"{name} bigint")
    for cell in (clones.CELL, 12):
        monkeypatch.setattr(clones, "CELL", cell)
        assert sorted(tuple(r) for r in clones.near_fingerprints(make(left, "fa"), make(right, "fb")).select("fa", "fb").collect()) == want


@pytest.mark.parametrize("n", [20_000, 200_000, 2_000_000, 50_000_000])
def test_a_fingerprint_has_few_keys(n):
    """Each key is a row to shuffle: 200,000 fingerprints once had 495 keys each, more than the disk takes."""
    together = clones.bands_together(n)
    assert math.comb(clones.HAMMING + together, together) <= 45


def test_reuse_rates_shuffle_pairs_once(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id int, repo string")
    matches = spark.createDataFrame([(1, "x", "y"), (2, "x", "y"), (1, "x", "z")], "id int, repo_a string, repo_b string")
    rates = clones.reuse_rates(df, matches)
    assert sorted(map(tuple, rates.collect())) == [("x", "y", 2, 2, 1.0), ("x", "z", 1, 2, 0.5)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = clones.reuse_rates(df, matches)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("reused, total, want", [(0, 10, 0.1), (5, 10, 1.0), (20, 10, 0.5), (5000, 10, 0.01), (0, 0, 0.1)])
def test_adaptive_threshold(spark, reused, total, want):
    df = spark.createDataFrame([(reused, total)], "r int, t int")
    assert df.select(clones.adaptive_threshold(F.col("r"), F.col("t")).alias("x")).first()["x"] == pytest.approx(want)


def test_version_ranges(spark):
    cases = [
        ((None, None, "3", None), "123", "123"), ((None, None, None, "3"), "12", "12"), (("2", None, "3", None), "23", "23"), (("2", None, None, "3"), "23", "2"), ((None, "2", None, "4"), "34", "3"),
        (("2", None, "2", None), "2", "2"), (("2", None, None, "2"), "", ""), (("2", None, None, None), "234", "234"), (("3", None, "1", None), "34", ""), ((None,) * 4, "", ""),
    ]
    chain = knowledge.version_chain(spark.createDataFrame([(i, "a", "r", f"v{i}", str(i), f"2020-01-0{i}", i) for i in range(1, 5)] + [(9, "a", "r", "v2-again", "2", "2021", 9), (10, "a", "r", "draft", "0", "?", None)], "lv_id bigint, author string, repo_name string, tag string, version string, commit_date string, at bigint")).where("tag <> 'draft'")
    ranges = spark.createDataFrame([(str(i), "a", "r", *c) for i, (c, _, _) in enumerate(cases)], "range_id string, author string, repo_name string, si string, se string, ei string, ee string")
    for mode, at in (("literal", 1), ("intended", 2)):
        got = {}
        for r in knowledge.affected_by_range(ranges, chain, mode).collect():
            got.setdefault(int(r["range_id"]), set()).add(r["tag"])
        assert [got.get(i, set()) for i in range(len(cases))] == [{f"v{k}" for k in c[at]} for c in cases]


def test_version_ranges_by_a_map(spark):
    """A mapped tag without a version is missing: as a start, or as a lone end, it gives nothing; as an end it ends nothing."""
    chain = knowledge.version_chain(spark.createDataFrame([(i, "a", "r", f"v{i}", str(i), i) for i in range(1, 5)], "lv_id bigint, author string, repo_name string, tag string, version string, at bigint").withColumn("commit_date", F.lit("")))
    entries = [("a", "r", "1.0", "v1", 0), ("a", "r", "3.0", "v3", 1), ("a", "r", "3.0", "v4", 2), ("a", "r", "9", "gone", 3), ("a", "r", "2", "release-2", 4)]
    vmap = spark.createDataFrame(entries, "author string, repo_name string, cpe_version string, git_tag string, pos int")
    cases = [(("9", None, "3.0", None), ""), ((None, None, "9", None), ""), (("1.0", None, "9", None), "1234"), (("none", None, "3.0", None), "123"), ((None, None, "3.0.7", None), "123"), (("2", None, "3.0", None), "23"), (("none", "1.0", "3.0", None), "123")]
    ranges = spark.createDataFrame([(str(i), "a", "r", *c) for i, (c, _) in enumerate(cases)], "range_id string, author string, repo_name string, si string, se string, ei string, ee string")
    for mode in ("literal", "intended"):
        got = {}
        for r in knowledge.affected_by_range(ranges, chain, mode, vmap).collect():
            got.setdefault(int(r["range_id"]), set()).add(r["tag"])
        assert [got.get(i, set()) for i in range(len(cases))] == [{f"v{k}" for k in w} for _, w in cases]
    named = spark.createDataFrame([(1, "a", "r", "3.0", None), (2, "a", "r", "4", ""), (3, "a", "r", "4", "1")], "raw_id bigint, author string, repo_name string, version string, si string").selectExpr("*", "si as se", "si as ei", "si as ee")
    tags = spark.createDataFrame([(i, "b", "r", f"v{i}") for i in range(1, 5)], "lv_id bigint, author string, repo_name string, tag string")
    assert {tuple(r) for r in knowledge.affected_exactly(named, tags, vmap).collect()} == {(1, "b", "r", "v3", "map"), (1, "b", "r", "v4", "map"), (2, "b", "r", "v4", "extracted")}


def test_chain_by_instants_of_mixed_texts(spark):
    texts = ["2024/01/11", "25/10/2015 10:00:00", "20201014T064101Z", "2020-10-14 08:00:00 +0200", "TBD", None]
    rows = [(i, "a", "r", f"v{i}", str(i), t, "be", dt.datetime(2024, 6, 1), "clash") for i, t in enumerate(texts)]
    tags = spark.createDataFrame(rows, "lv_id bigint, author string, repo_name string, tag string, version string, commit_date string, collector string, loaded_at timestamp, undated string")
    zones = spark.createDataFrame([("be", "Europe/Berlin", "dmy")], "collector string, tz_name string, date_order string")
    chain = knowledge.version_chain(knowledge.dated_tags(tags, zones))
    assert [r["tag"] for r in chain.orderBy("ord").collect()] == ["v1", "v3", "v2", "v0", "v4", "v5"]
    assert knowledge.version_chain(knowledge.dated_tags(tags.limit(0), zones)).count() == 0


def test_along_like_a_window(spark):
    from pyspark.sql import Window

    from cascadelens.operators.ordered import along

    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 8 + ["b", None]), i, rng.choice([None, i])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    w = Window.partitionBy("k").orderBy("o")
    want = df.select("*", F.row_number().over(w).cast("bigint").alias("n"), F.lead("v").over(w).alias("after"), F.lag("v").over(w).alias("before"), F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("held"))
    got = along(df, ["k"], ["o"], ordinal="n", lead={"after": "v"}, lag={"before": "v"}, carried={"held": "v"})
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.select(got.columns).collect()), key=str)
    assert [r["n"] for r in along(df, [], ["o"], ordinal="n").orderBy("o").collect()] == list(range(1, 501))


def test_propagation_with_loops(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "c"), ("d", "a"), ("d", "a"), (None, "a"), ("a", "a")], "s string, x string")
    affected = spark.createDataFrame([("V1", "a"), ("V1", "a"), ("V2", "z"), ("V3", "b"), ("V3", "c"), (None, "a"), ("V4", None)], "cve_id string, id string")
    got = {(r["cve_id"], r["id"]): (r["depth"], r["path"]) for r in graph.propagate(affected, edges, "s", "x").collect()}
    assert got == {
        ("V1", "a"): (0, ["a"]), ("V1", "b"): (1, ["a", "b"]), ("V1", "c"): (2, ["a", "b", "c"]), ("V1", "d"): (1, ["a", "d"]), ("V2", "z"): (0, ["z"]),
        ("V3", "b"): (0, ["b"]), ("V3", "c"): (0, ["c"]), ("V3", "a"): (1, ["c", "a"]), ("V3", "d"): (1, ["c", "d"]),
    }
    line = spark.createDataFrame([(f"n{i + 1:02}", f"n{i:02}") for i in range(14)], "s string, x string")
    reached = graph.reach(line, "s", "x", spark.createDataFrame([("n00",)], "id string"))
    assert {r["id"]: r["depth"] for r in reached.collect()} == {f"n{i:02}": i for i in range(15)}


def test_greedy_cut_leaves_no_cycle(spark):
    rng = random.Random(6)
    edges = sorted({(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(22)})
    rows = graph.without_cycles(spark.createDataFrame(edges, "s string, x string"), "s", "x").collect()
    assert sorted((r["s"], r["x"]) for r in rows) == edges and any(r["removed"] for r in rows)
    assert not graph.count_cycles([(r["s"], r["x"]) for r in rows if not r["removed"]])
    assert graph.greedy_cut([("a", "b"), ("b", "a"), ("b", "c"), ("c", "a")]) == [("a", "b")]


def test_parsed_functions():
    from cascadelens.sources import parser as P

    text = """#include <x.h>
namespace n {
struct S { int f() const { return "}"[0]; } };
}
static int *pick(int a, /* { */ int b)
{
    if (a) { return 0; }
    return &b;
}
int table[] = {1, 2};
extern "C" { void e(void) {} }
A::A(int x) : y{x} { go(); }
int open(int a) { if (a) {"""
    assert [(n, line) for n, line, _ in P.parsed_functions(text)] == [("f", 3), ("pick", 5), ("e", 11), ("A", 12)]
    assert P.parsed_functions(text)[1][2].endswith("return &b;\n}")
    code = '#define NAME "zed" // c\n#define STR(a, b) foo(#b)\n#define CAT(a) x##a\n#ifdef NAME\nputs( NAME ); NAMES; "NAME"; f(NAME)'
    known = P.macros(code)
    assert known == {"NAME": '"zed"', "STR": "1"}
    assert P.with_macros(code, known) == (code.replace("puts( NAME )", 'puts( "zed" )').replace("f(NAME)", 'f("zed")'), ['"zed"'])


def test_digests(spark):
    from cascadelens.functions import digest as D

    rng = random.Random(1)
    base = "".join(rng.choice("abcdefgh (){};\n") for _ in range(600))
    near, other = base[:300] + "XY" + base[302:], "".join(rng.choice("zyxwvuts,.=<>") for _ in range(600))
    df = spark.createDataFrame([(i, t) for i, t in enumerate([base, base, near, other, "short", None])], "i int, content string")
    made = {r["i"]: r["digest"] for r in D.digests(df).collect()}
    assert made[0] == made[1] and made[4] is None and made[5] is None and len(made[0]) == 7

    def plain(a, b):
        code = lambda d, k: ((d[k // 64] >> (63 - k % 64)) & 1) * 2 + ((d[2 + k // 64] >> (63 - k % 64)) & 1)
        apart = [abs(code(a, k) - code(b, k)) for k in range(128)]
        far = sum(6 if x == 3 else x for x in apart)
        for i in (4, 5):
            x = min(abs(a[i] - b[i]), 16 - abs(a[i] - b[i]))
            far += x if x <= 1 else (x - 1) * 12
        return far + (a[6] != b[6])

    pairs = spark.createDataFrame([(made[0], made[k]) for k in (1, 2, 3)], "a array<bigint>, b array<bigint>")
    got = [r["d"] for r in pairs.select(D.distance(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == [plain(made[0], made[k]) for k in (1, 2, 3)] and got[0] == 0 and got[1] < got[2]


def test_one_direction_and_score(spark):
    e = spark.createDataFrame([("s", "x", 3), ("x", "s", 5), ("a", "b", 2), ("b", "a", 2), ("c", "d", 1)], "s string, x string, n int")
    kept = tpl.one_direction(e)
    assert {(r["s"], r["x"]) for r in kept.collect()} == {("x", "s"), ("c", "d")}
    s = tpl.score(kept, e).first()
    assert (s["tp"], s["precision"], s["recall"]) == (2, 1.0, 0.4) and tpl.score(kept.limit(0), e).first()["precision"] is None


def test_graph(spark):
    rng = random.Random(8)
    edges = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(30)] + [("n0", "n0"), (None, "n1"), ("z1", "z2"), ("z2", "z3"), ("z3", "z1"), ("z2", "z1")]
    df = spark.createDataFrame(edges, "s string, x string")
    part = {}
    for a, b in [e for e in edges if None not in e] * 40:
        part[a] = part[b] = min(part.get(a, a), part.get(b, b))
    assert {r["id"]: r["component"] for r in graph.connected_components(df, "s", "x").collect()} == part
    rank = graph.pagerank(df.where("s is not null").withColumn("w", F.lit(1.0)), "s", "x", "w")
    assert rank.agg(F.sum("rank")).first()[0] == pytest.approx(1)
    cycles = {(r["s"], r["x"]): r["n_cycles"] for r in graph.cycle_edges(df.where("s like 'z%'"), "s", "x").collect()}
    assert cycles == {("z1", "z2"): 2, ("z2", "z3"): 1, ("z3", "z1"): 1, ("z2", "z1"): 1}
    empty = df.limit(0)
    assert graph.connected_components(empty, "s", "x").count() == 0 and graph.dependents_by_level(empty, "s", "x").count() == 0
    assert graph.pagerank(empty.withColumn("w", F.lit(1.0)), "s", "x", "w").count() == 0


def test_origins(spark):
    t = lambda d: dt.datetime(2020, 1, d)
    rows = [("A", "f", t(5), "src/core/x.c"), ("B", "f", t(1), "third_party/acore/x.c"), ("C", "f", t(2), "zed/x.c"), ("A", "g", t(5), "src/g.c"), ("C", "g", t(3), "src/g.c"), ("A", "alone", t(1), "a.c"), ("B", "h", t(1), "deps/h.c"), ("C", "h", None, "external/h.c")]
    births = tpl.first_seen(spark.createDataFrame(rows, "tpl string, func string, time timestamp, path string"))
    names = spark.createDataFrame([("A", "acore"), ("B", "bee"), ("C", "cee")], "tpl string, tpl_name string")
    got = {r["func"]: (r["origin"], r["by_path"]) for r in tpl.origins(births, names).collect()}
    assert got == {"f": ("A", True), "g": ("C", False)}


def test_a_rate_equal_to_its_threshold_is_kept(spark):
    ties = [(t, r) for r in range(10, 80) for t in range(1 + r // 10, r) if 1 / (r / t) > t / r]
    assert len(ties) > 10
    rates = spark.createDataFrame([("a", f"b{i}", t, r, t / r) for i, (t, r) in enumerate(ties)], "repo_a string, repo_b string, common bigint, total bigint, reuse_rate double")
    stats = spark.createDataFrame([(f"b{i}", r, t) for i, (t, r) in enumerate(ties)], "repo_b string, reused bigint, functions bigint")
    assert clones.reuse_relations(rates, stats).count() == len(ties)


def test_thresholds_are_the_quotients_to_the_last_bit(spark):
    functions = spark.createDataFrame([(i, "x") for i in range(25)] + [(99, "y")], "id int, repo string")
    rates = spark.createDataFrame([("y", "x", 30), ("z", "x", 4)], "repo_a string, repo_b string, common bigint")
    got = clones.reuse_statistics(functions, rates).withColumn("t", clones.adaptive_threshold(F.col("reused"), F.col("functions")))
    assert {tuple(r) for r in got.select("repo_b", "functions", "reused", "t").collect()} == {("x", 25, 34, 25 / 34), ("y", 1, 0, 0.1)}


def test_reuse_relations_like_the_nested_loop(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(63) for _ in range(60)]
    rows = [(i, f"r{rng.randrange(12)}", rng.choice(base) ^ sum({1 << rng.randrange(63) for _ in range(rng.randrange(9))}), dt.datetime(2020, 1, 1 + rng.randrange(25))) for i in range(1200)]
    df = spark.createDataFrame(rows, "id bigint, repo string, fingerprint bigint, birth timestamp")
    found = clones.similar_functions(df, df)
    hits = {(i, ra, rb) for i, ra, f, x in rows for _, rb, g, y in rows if ra != rb and y < x and (f ^ g).bit_count() <= 8}
    total, common = {}, {}
    for _, ra, _, _ in rows:
        total[ra] = total.get(ra, 0) + 1
    for _, ra, rb in hits:
        common[ra, rb] = common.get((ra, rb), 0) + 1
    want = {(ra, rb, n, total[ra]) for (ra, rb), n in common.items() if n / total[ra] >= 0.1}
    got = clones.reuse_relations(clones.reuse_rates(df, found)).select("repo_a", "repo_b", "common", "total").collect()
    assert len(want) > 50 and len(got) == len(want) and {tuple(r) for r in got} == want


def test_simhash_by_its_definition(spark):
    texts = [
        (1, "int f(int a_1) { return a_1 + 0x1F; }  // away"), (2, None), (3, ""), (4, "{ ; }"), (5, "x"), (6, "42"), (7, "größe = Größe * 2; ELSE ٣ 𝒳y naïve_1"),
        (8, "a b"), (8, "b c"), (9, " ".join(f"w{i % 7} + {i}" for i in range(17_000))), (10, "p -> q" * 30), (None, "lost")
    ]
    bags = {}
    for i, text in texts:
        tokens = re.findall(r"\w+|[+\-*/=<>!&|]", re.sub("//.*", "", text or ""))
        for t in tokens:
            kind = "keyword" if t.lower() in T.KEYWORDS else "identifier" if t.isalpha() else None if t.isalnum() else "operator"
            bags.setdefault(i, []).extend([f"{kind}_{t.lower() if kind == 'keyword' else t}"] if kind else [])
        bags.setdefault(i, []).extend(f"bigram_{x}_{y}" for x, y in zip(tokens, tokens[1:], strict=False))
    want = []
    for i, text in texts:
        hashes = [int.from_bytes(hashlib.md5(f.encode()).digest()[8:]) for f in (bags[i] if i is not None else [])]
        u = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        want += [(i, u - (1 << 64) if u >> 63 else u)] * (text is not None)
    df = spark.createDataFrame(texts, "i bigint, content string")
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for parts in (1, 5):
        assert sorted(map(tuple, H.simhash(df.coalesce(1).repartition(parts), "i", "content").collect()), key=key) == sorted(want, key=key)
    single = spark.createDataFrame([(1, "7"), (2, "8")], "i bigint, content string").coalesce(1)
    assert {r["fingerprint"] for r in H.simhash(single, "i", "content").collect()} == {0}


def test_simhash_finds_tokens_once_and_makes_no_row_of_each(spark):
    df = spark.createDataFrame([(1, "a b")], "i bigint, content string")
    plan = H.simhash(df, "i", "content")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and "Generate" not in plan


def test_counting_takes_little_memory():
    tokens = pa.array([b"w%d" % i for i in range(H.TOKENS)])
    tracemalloc.start()
    counts = H._bit_counts(np.full(H.TOKENS // 128, 128), tokens)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts[0].tolist() == [127] * (H.TOKENS // 128) and peak < 128e6
