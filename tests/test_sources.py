"""Sources, sinks and streams on small files."""

import json

from pyspark.sql import functions as F

from cascadelens.sources import files as S
from cascadelens.sources import sinks as K
from cascadelens.streaming import ingest


def put(root, name, text):
    p = root / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text, newline="")
    return p


def test_source_trees(spark, tmp_path):
    for name in ("a%b/src/x.c", "a%b/tests/y.c", "a%b/.git/z.h", "a%b/notes.txt", "c%d/e.hpp", "plain/f.c"):
        put(tmp_path, name, "int x;")
    lib = {(r["author"], r["repo"], r["path"]) for r in S.source_tree(spark, str(tmp_path)).collect()}
    assert lib == {("a", "b", "src/x.c"), ("c", "d", "e.hpp")}
    assert S.source_tree(spark, str(tmp_path), prune=False).count() == 3  # Spark lists no hidden files
    assert S.tagged_sources(S.source_tree(spark, str(tmp_path))).count() == 1
    assert S.repositories(spark, str(tmp_path)).count() == 2


def test_mapping_files(spark, tmp_path):
    put(tmp_path, "v/x@@y.txt", "v1.0@#@1.0\r\nv1.0a@#@1.0\r\nbroken\r\nv2@#@2")
    got = [(r["cpe_key"], r["git_tag"], r["cpe_version"]) for r in S.version_map(spark, str(tmp_path / "v")).orderBy("pos").collect()]
    assert got == [("x@@y", "v1.0", "1.0"), ("x@@y", "v1.0a", "1.0"), ("x@@y", "v2", "2")]
    put(tmp_path, "m.json", json.dumps({"a@@b": "p@@q", "c@@d": "p@@q", "e@@f": "r@@s"}, indent=1))
    assert {r["cpe_key"]: r["git_key"] for r in S.name_map_file(spark, str(tmp_path / "m.json")).collect()} == {"p@@q": "c@@d", "r@@s": "e@@f"}
    put(tmp_path, "p/one_patch_info.txt", "CVE-1 o%r abc\nCVE-2 o%r abc\nCVE-3 o%r def\n")
    put(tmp_path, "p/one_changed_patch_info.txt", "CVE-9 o%r abc\n")
    assert sorted((r["cve_id"], r["commit_id"]) for r in S.patch_info(spark, str(tmp_path / "p")).collect()) == [("CVE-1", "abc"), ("CVE-3", "def")]
    put(tmp_path, "n.csv", "tpl_uuid,tpl_name\n1,ZLib\n1,Alib\n2,Curl\n")
    assert {r["tpl"]: r["tpl_name"] for r in S.library_names(spark, str(tmp_path / "n.csv")).collect()} == {"1": "alib", "2": "curl"}


def test_json_sources(spark, tmp_path):
    put(tmp_path, "s/t1.json", json.dumps({"h1": ["int a", {"v1": ["2020-01-01 00:00:00", "src/a.c"], "v2": ["bad", "b.c"]}]}))
    rows = {(r["tpl"], r["func"], r["tag"]): (str(r["time"]), r["path"]) for r in S.signatures(spark, str(tmp_path / "s")).collect()}
    assert rows == {("t1", "h1", "v1"): ("2020-01-01 00:00:00", "src/a.c"), ("t1", "h1", "v2"): ("None", "b.c")}
    put(tmp_path, "b.json", json.dumps({"a@@b": {"Makefile": [{"depname": "z", "version": "1", "version_op": ">="}], "x": []}}))
    assert [tuple(r) for r in S.sbom(spark, str(tmp_path / "b.json")).collect()] == [("a@@b", "Makefile", "z", "1", ">=")]
    put(tmp_path, "raw/deep/r.json", "{}")
    put(tmp_path, "raw/no.txt", "{}")
    assert S.raw_records(spark, str(tmp_path / "raw")).count() == 1


def test_logs_and_lists(spark, tmp_path):
    put(tmp_path, "l.txt", "a%b\na%b\nc%d\n")
    assert {r["name"] for r in S.line_set(spark, str(tmp_path / "l.txt")).collect()} == {"a/b", "c/d"}
    log = spark.createDataFrame([("2020-01-01 01:02:03 +0000 (tag: v1, origin)",), ("y (HEAD, tag: v2)",), ("none",)], "value string")
    assert [(r["tag"], r["tag_time"]) for r in S.tag_log(log).collect()] == [("v1", "2020-01-01 01:02:03"), ("v2", "y (HEAD,")]
    t = spark.createDataFrame([("a", "b"), (None, "c")], "creator_date string, last_commit_date string")
    assert [r["commit_date"] for r in S.tag_dates(t).collect()] == ["a", "c"]


def test_sinks(spark, tmp_path):
    e = spark.createDataFrame([("s", "x"), ("s", "x")], "s string, x string")
    K.write_edges(K.merge_edges(e, "s", "x"), str(tmp_path / "e"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "e"), header=True).collect()] == [("s", "x")]
    K.write_json(e, str(tmp_path / "j"))
    K.write_list(e, "s", str(tmp_path / "l"))
    K.write_by_key(e, "s", str(tmp_path / "k"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2 and spark.read.text(str(tmp_path / "l")).count() == 2 and spark.read.parquet(str(tmp_path / "k")).count() == 2
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in K.upsert(old, new, "k").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert [r["k"] for r in K.not_done(new, old, "k").collect()] == [3] and K.chunks(spark.range(450), 200).rdd.getNumPartitions() == 3


def test_streams(spark, tmp_path):
    schema = "k bigint, at timestamp, loaded_at timestamp, v string"
    rows = "timestamp'2024-01-01' as at, timestamp'2024-01-0{}' as loaded_at, '{}' as v"
    spark.range(3).selectExpr("id as k", *rows.format(1, "old").split(", ")).write.parquet(str(tmp_path / "in/1"))
    source = str(tmp_path / "in/*")
    ingest.upsert_stream(ingest.deliveries(spark, source, schema), str(tmp_path / "t"), str(tmp_path / "c"), "k", "loaded_at").awaitTermination()
    spark.range(1, 5).selectExpr("id as k", *rows.format(5, "new").split(", ")).write.parquet(str(tmp_path / "in/2"))
    ingest.upsert_stream(ingest.deliveries(spark, source, schema), str(tmp_path / "t"), str(tmp_path / "c"), "k", "loaded_at").awaitTermination()
    assert {r["k"]: r["v"] for r in spark.read.parquet(str(tmp_path / "t/v1")).collect()} == {0: "old", 1: "new", 2: "new", 3: "new", 4: "new"}
    counts = ingest.late_counts(spark.read.schema(schema).parquet(source), "at", "loaded_at", "v").groupBy("v").agg(F.sum("n_late").alias("n"))
    assert {r["v"]: r["n"] for r in counts.collect()} == {"old": 0, "new": 4}
