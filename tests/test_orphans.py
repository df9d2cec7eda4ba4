"""Problem 5: every kind, every way of writing a key."""

import datetime as dt

from cascadelens.operators import orphans

D = lambda n: dt.datetime(2024, 1, n)
FULL = "ab12" * 10


def tables(spark, patch=(), reuses=(), cve=(), commits=(), software=()):
    make = spark.createDataFrame
    return [
        make(list(patch), "patch_id bigint, cve_id string, commit_id string, repo_name string, repo_owner string, loaded_at timestamp, target string"),
        make(list(reuses), "reuse_id bigint, src_id string, dst_id string, loaded_at timestamp"),
        make(list(cve), "cve_row bigint, cve_id string, op string, loaded_at timestamp, kind string"),
        make(list(commits), "commit_row bigint, repo string, commit_id string, op string, loaded_at timestamp"),
        make(list(software), "software_row bigint, unique_id string, op string, loaded_at timestamp"),
    ]


def test_kinds(spark):
    got = orphans.orphans(
        *tables(
            spark,
            patch=[
                (1, " cve-1\t", FULL.upper(), "r", "o", D(5), "x"),
                (2, "CVE-2", "AB12ab1", "r", "o", D(5), "x"),
                (3, "CVE-3", "ab12ab1", "other", "o", D(5), "x"),
                (4, None, None, "r", "o", D(5), "x"),
                (5, "", "", None, None, D(5), "x"),
                (6, "CVE-4", "a", "r", "o", None, "x"),
                (7, "CVE-4", "ffff", "r", "o", D(5), "x"),
            ],
            reuses=[(1, "a%b", "A%b", D(5)), (2, "late%x", None, D(1)), (2, "late%x", None, D(1))],
            cve=[(1, "CVE-1", "upsert", D(1), "k"), (2, "CVE-2", "upsert", D(1), "k"), (3, "CVE-2", "delete", D(2), "k"), (4, "CVE-4", "upsert", D(9), "k"), (5, "CVE-3", "delete", D(1), "k"), (6, "CVE-3", "upsert", D(2), "k"), (7, None, "upsert", D(1), "k")],
            commits=[(1, "o%r", FULL, "upsert", D(1)), (2, "o%r", "ffff" * 10, "delete", D(1)), (3, "o%r", None, "upsert", D(1))],
            software=[(1, "a%b", "upsert", None), (2, "late%x", "upsert", D(3))],
        )
    )
    rows = sorted((r["ref_tab"], r["ref_field"], r["row_id"], r["kind"]) for r in got.collect())
    assert rows == sorted(
        [
            ("patch", "cve_id", 2, "deleted"),
            ("patch", "cve_id", 5, "missing"),
            ("patch", "cve_id", 7, "late"),
            ("patch", "commit_id", 3, "missing"),
            ("patch", "commit_id", 5, "missing"),
            ("patch", "commit_id", 7, "deleted"),
            ("reuses", "dst_id", 1, "missing"),
            ("reuses", "src_id", 2, "late"),
            ("reuses", "src_id", 2, "late"),
        ]
    )
    months = {(r["ref_field"], r["month"], r["kind"]): r["n"] for r in orphans.per_month(got).collect()}
    assert months[("src_id", "2024-01", "late")] == 2


def test_empty(spark):
    assert orphans.orphans(*tables(spark)).count() == 0
