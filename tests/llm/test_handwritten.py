"""Problem 7: signs in the content, declared paths, mined patterns, copies."""

import datetime as dt

from cascadelens.llm import handwritten as h

ROWS = "author string, repo_name string, file_path string, content string, birth_time timestamp, kind string"
HAND = "int f(int a)\n{\n    return a + %d; // the nonce is generated by the peer\n}\n"
PACKED = "int q(int a){" + "a=b+c;" * 80 + "}"
DATA = "static const int t[] = {" + ", ".join(map(str, range(200))) + "};"


def classify(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], ROWS)
    return {(r["author"], r["repo_name"], r["file_path"]): (r["kind"], r["reason"]) for r in h.classify(df).collect()}


def test_signs():
    yes = ["/* Generated by x 3.3 from a.y - changes will be lost. */", "// Code generated by a. DO NOT EDIT.\n", "/*\n * AUTOGENERATED FILE\n */", "// @generated by x\n", "// <auto-generated> x 1\n", "/* machine-made by x, edit a.xml instead */", "/* Dieser Code wurde von x erzeugt */", "/* automatically generated from a.idl: do not edit */", "/* This file was produced automatically by x-tool, do not modify by hand */"]
    no = ["/* written by hand, the generated version was slower */", "// do not edit this limit without asking the page people\n", "/* used by the code generator in x */", "// auto page tuning\n", "// vendor specific: x\n", "/* The nonce is generated by the peer, see x. */"]
    assert [h.row_signs(t + HAND % 1)[1] for t in yes] == [1] * len(yes)
    assert [h.row_signs(t + HAND % 1)[1] for t in no] == [0] * len(no)
    assert h.row_signs(DATA)[3] and h.row_signs(PACKED)[4] and h.row_signs("/* This file is part of zlib 1.2 */ int a;")[5] == "zlib"


def test_kinds(spark):
    t = dt.datetime(2020, 1, 1)
    rows = [("a", "r", "src/x.c", HAND % 1, t), ("a", "r", "src/x.c", HAND % 1, t), ("a", "r", "src/p.c", PACKED, None), ("a", "r", "src/d.h", DATA, t), ("a", "r", "src/n.c", None, None), ("a", "r", None, HAND % 2, t), (None, None, "m.c", HAND % 3, t)]
    rows += [("a", "r", "libs/zlib-1.2.3/inflate.c", HAND % 4, t), ("a", "r", ".\\third_party\\other\\o.c", HAND % 5, t), ("b", "other", "src/o.c", HAND % 5, t), ("b", "other", "include/other/o.h", HAND % 6, t)]
    rows += [("b", "other", "src/generated_key.c", HAND % 7, t), ("b", "other", "ui/moc_window.cpp", HAND % 8, t)]
    # a whole file in two projects without any sign, and one borrowed function
    rows += [(o, n, "core/same.c", HAND % k, b) for o, n, b in (("c", "first", t), ("d", "second", t + dt.timedelta(days=9))) for k in (20, 21)]
    rows += [("d", "second", "core/mine.c", HAND % 20, t + dt.timedelta(days=9)), ("d", "second", "core/mine.c", HAND % 33, t)]
    got = classify(spark, rows)
    assert len(got) == len({r[:3] for r in rows})
    kinds = {k: v[0] for k, v in got.items() if v[0]}
    assert kinds == {
        ("a", "r", "src/p.c"): "minified",
        ("a", "r", "src/d.h"): "data",
        ("a", "r", "libs/zlib-1.2.3/inflate.c"): "vendored",
        ("a", "r", ".\\third_party\\other\\o.c"): "vendored",
        ("b", "other", "ui/moc_window.cpp"): "generated",
        ("d", "second", "core/same.c"): "vendored",
    }


def test_patterns_are_mined(spark):
    made = "// @generated by x\n" + HAND
    rows = [("o", f"r{i}", f"weird{i % 3}/a_zz.c" if i % 3 else f"odd/a{i}_zz.c", made % i, None) for i in range(9)] + [("o", "r9", "other/plain_zz.c", HAND % 9, None), ("o", "r9", "other/plain.c", HAND % 10, None)]
    got = classify(spark, rows)
    assert got[("o", "r9", "other/plain_zz.c")] == ("generated", "pattern s:_zz") and got[("o", "r9", "other/plain.c")][0] is None


def test_attribute_files(spark):
    rules = "# comment\nout/** linguist-generated\n*.tab.c generated=true\nvendor/* linguist-vendored=false\n/only.c linguist-vendored\n"
    rows = [("a", "r", ".gitattributes", rules, None), ("a", "r", "out/.gitattributes", "keep.c -linguist-generated\n", None)]
    rows += [("a", "r", p, HAND % i, None) for i, p in enumerate(["out/a.c", "out/deep/b.c", "out/keep.c", "x/p.tab.c", "vendor/v.c", "vendor/deep/v.c", "only.c", "x/only.c"])]
    got = {k[2]: v[0] for k, v in classify(spark, rows).items()}
    assert {k: v for k, v in got.items() if v} == {"out/.gitattributes": "generated", "out/a.c": "generated", "out/deep/b.c": "generated", "x/p.tab.c": "generated", "vendor/deep/v.c": "vendored", "only.c": "vendored"}


def test_empty(spark):
    assert classify(spark, []) == {}


def test_copies_agree_in_every_function(spark):
    """A whole copy has the same set of functions; one that differs in the middle is none."""
    code = lambda name: f"int {name}(int a) {{ return a + {len(name)}; }}"
    day = lambda d: dt.datetime(2020, 1, d)
    rows = [("o", repo, path, code(f), day(d), 1) for repo, path, names, d in (("first", "x/core.c", "abcde", 1), ("later", "y/core.c", "edcba", 2), ("other", "z/core.c", ["a", "b", "cc", "d", "e"], 3)) for f in names]
    df = spark.createDataFrame(rows, "author string, repo_name string, file_path string, content string, birth_time timestamp, size int")
    got = {r["repo_name"]: r["reason"] for r in h.classify(df).collect()}
    assert got == {"first": None, "later": "whole copy", "other": None}
