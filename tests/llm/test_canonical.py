"""Problem 6: ways of writing a name, near misses, and the join against all pairs."""

import random

from cascadelens.llm import canonical as c

ENTRIES = "ref_id bigint, git_key string, cpe_key string, cpe23uri string, pos int, depname string"
LIST = ["acme@@jolajitol", "zorg@@onyx_socket", "zorg@@onyx_socket2", "one@@nofezenix", "two@@nofezenix", "kilo@@fadekakerk", "tiho@@pahahogel\\+\\+", "tiho@@pahahogel"]


def entries(spark):
    return spark.createDataFrame([(i, k.replace("\\", ""), k.replace("kilo", "the_kilo_group"), f"cpe:2.3:a:{k}", i, "x") for i, k in enumerate(LIST)], ENTRIES)


def test_ways_of_writing(spark):
    want = {
        "jolajitol": 0, " JOLAJITOL\t": 0, "libjolajitol-dev": 0, "jolajitol 1.2.0": 0, "jolajitol (bundled)": 0, "ｊｏｌａｊｉｔｏｌ": 0, "joläjitól": 0, "j0lajit0l": 0, "joajitol": 0, "jolaijtol": 0,
        "libjolajitol.so.1": 0, "pkg:generic/jolajitol@4.9.4": 0, "jolajitolSDK": 0, "https://git.example/ACME/jolajitol.git": 0, "git@git.example:acme/jolajitol.git": 0,
        "Onyx socket": 1, "socket, onyx": 1, "onyx-socket2": 2, "onyx.socket==2.0.1": 1, "@two/nofezenix": 4, "nofezenix (One)": 3, "one::nofezenix": 3, "nofezenix by TWO": 4,
        "the_kilo_group:fadekakrk": 5, "pahahogel++": 6, "pahahogel": 7, "nofezenix": "ambiguous", "three/nofezenix": "ambiguous",
        "jolajitol2": "unmatched", "jolajitol-lite3x": "unmatched", "hisabofost": "unmatched", "unknown": "unmatched", "": "unmatched", "-": "unmatched", "N/A": "unmatched", "x" * 50_000: "unmatched",
    }
    rows = [(i, n, 1) for i, n in enumerate(want)] + [(900, None, 1), (0, next(iter(want)), 1)]
    df = spark.createDataFrame(rows, "sbom_id bigint, depname string, ref_id int")
    got = c.map_rows(df, "sbom_id", entries(spark)).collect()
    assert len(got) == len(rows)
    assert {r["depname"]: r["ref_id"] if r["status"] == "matched" else r["status"] for r in got if r["depname"] is not None} == want
    assert [r["status"] for r in got if r["depname"] is None] == ["unmatched"]


def test_the_join_loses_no_pair(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(1, 9)))
    x, y = {word() for _ in range(150)}, {word() for _ in range(80)}
    make = lambda s: spark.createDataFrame([(k, "", c.pairs_of(k)) for k in s], "key string, ending string, tokens array<string>")
    got = {(r[0], r[1]) for r in c.similar_keys(make(x), make(y)).collect()}
    jaccard = lambda a, b: len(a & b) / len(a | b)
    want = {(a, b) for a in x for b in y if jaccard(set(c.pairs_of(a)), set(c.pairs_of(b))) >= c.SIMILARITY - 1e-9}
    assert got == want


def test_the_join_loses_no_pair_of_other_endings(spark):
    make = lambda x: spark.createDataFrame([(k, e, c.pairs_of(k)) for k, e in x], "key string, ending string, tokens array<string>")
    got = c.similar_keys(make([("onyxsockett", ""), ("onyxsocket2", "2")]), make([("onyxsocket", ""), ("onyxsocket2", "2")]))
    assert {(r["left_key"], r["right_key"]) for r in got.collect()} == {(a, b) for a in ("onyxsockett", "onyxsocket2") for b in ("onyxsocket", "onyxsocket2")}


def test_a_slip_in_an_ending(spark):
    listed = ["zorg@@onyx", "zorg@@onyxlite", "kilo@@abc", "kilo@@abcd", "acme@@jolajitod", "acme@@fadekaker"]
    ref = spark.createDataFrame([(i, k, k, k, i, "x") for i, k in enumerate(listed)], ENTRIES)
    want = {"onyxlit": 1, "onyxltie": 1, "onyxlite": 1, "onyxx": 0, "jolajitot": 4, "jolajito": "unmatched", "fadekakerlite": "unmatched", "fadekakerd": "unmatched"}
    names = spark.createDataFrame([(i, n) for i, n in enumerate(want)], "sbom_id bigint, depname string")
    assert {r["depname"]: r["ref_id"] if r["status"] == "matched" else r["status"] for r in c.map_rows(names, "sbom_id", ref).collect()} == want


def test_endings_are_mined(spark):
    keys = spark.createDataFrame([(k,) for k in ("onyxsocket", "onyxsocket2", "abc", "abclite", "abcd", "ab", "xy2")], "key string")
    marks = c.endings(keys)
    assert {r["tail"] for r in marks.collect()} == {"2", "lite", "d"}
    asked = spark.createDataFrame([("nofe2",), ("bundlelite",), ("ad",), ("plain",)], "key string")
    assert {r["key"]: r["ending"] for r in c.with_ending(asked, marks).collect()} == {"nofe2": "2", "bundlelite": "lite", "ad": "", "plain": ""}


def test_edit_distance():
    assert [c.edit_distance(a, b, 3) for a, b in (("abc", "abc"), ("abc", "acb"), ("abc", "ab"), ("abc", "xbcd"), ("abcdef", "x"))] == [0, 1, 1, 2, 4]


def test_empty(spark):
    names = spark.createDataFrame([], "sbom_id bigint, depname string")
    assert c.map_rows(names, "sbom_id", entries(spark)).count() == 0
    one = spark.createDataFrame([(1, "a")], "sbom_id bigint, depname string")
    assert [r["status"] for r in c.map_rows(one, "sbom_id", spark.createDataFrame([], ENTRIES)).collect()] == ["unmatched"]
