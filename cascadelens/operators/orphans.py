"""Problem 5: references whose target is missing, deleted or came later.

Parent rows are first folded to one validity record a key (first load, last operation), then
references and keys are shuffled on the key, sorted, and merged in one linear pass, which is what a
sort-merge join is. A key with a third of all references is split by AQE: the other side has one row
a key, so any split of the references meets it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shortened ids of so many characters or more are looked up by their first so many.
SHORT_KEY = 7


def validity(rows: DataFrame, key: str, row_id: str, *extra: str) -> DataFrame:
    """key, first_us, gone of each target; rows without loaded_at count as loaded before all others."""
    at = F.coalesce(F.unix_micros("loaded_at"), F.lit(-(2**62)))
    return (
        rows.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("target"), *extra)
        .agg(F.min(at).alias("first_us"), (F.max_by("op", F.struct(at, F.col(row_id))) == "delete").alias("gone"))
    )


def _kind(missing: str = "first_us") -> Column:
    loaded = F.coalesce(F.unix_micros("ref_loaded"), F.lit(2**62))
    return F.when(F.col(missing).isNull(), "missing").when(F.col("gone"), "deleted").when(F.col("first_us") > loaded, "late")


def judge(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """refs(..., ref_key, ref_loaded) against targets(target, first_us, gone): adds `kind`.

    Null references are no references and are left out. `kind` is null for a sound one. A reference
    without loaded_at is taken to be loaded last, so it's never `late`.
    """
    keyed = refs.where(F.col("ref_key").isNotNull())
    return keyed.join(targets.hint("merge"), keyed["ref_key"] == targets["target"], "left").withColumn("kind", _kind())


def judge_shortened(refs: DataFrame, commits: DataFrame) -> DataFrame:
    """refs(row_id, ref_repo, ref_key, ref_loaded) with ids shortened to their first digits.

    Both sides are cut to the same few digits together with the repository, so the join is on equal
    keys and a repository with very many commits is spread; ids shorter than that are joined by their
    first digit. Where several commits begin with the id, the reference is as good as the best of them.
    """
    heads = []
    for at_least, below, width in ((SHORT_KEY, None, SHORT_KEY), (1, SHORT_KEY, 1)):
        size = F.length("ref_key")
        some = refs.where((size >= at_least) & (size < below) if below else size >= at_least)
        cut = commits.select("repo", "target", "first_us", "gone", F.substring("target", 1, width).alias("head"))
        some = some.withColumn("ref_head", F.substring("ref_key", 1, width))
        match = (some["ref_repo"] == cut["repo"]) & (some["ref_head"] == cut["head"]) & cut["target"].startswith(some["ref_key"])
        heads.append(some.join(cut.hint("merge"), match, "left").drop("ref_head", "head", "repo"))
    blank = refs.where(F.length("ref_key") == 0).withColumns({"target": F.lit(None).cast("string"), "first_us": F.lit(None).cast("bigint"), "gone": F.lit(None).cast("boolean")})
    judged = heads[0].unionByName(heads[1]).unionByName(blank).withColumn("kind", _kind())
    rank = F.when(F.col("kind").isNull(), 0).when(F.col("kind") == "late", 1).when(F.col("kind") == "deleted", 2).otherwise(3)
    return judged.groupBy("row_id").agg(F.min(F.struct(rank.alias("r"), "kind")).alias("best"), F.first("ref_loaded").alias("ref_loaded")).select("row_id", "ref_loaded", F.col("best.kind").alias("kind"))


def orphans(patch: DataFrame, reuses: DataFrame, cve: DataFrame, commit_log: DataFrame, software: DataFrame) -> DataFrame:
    """ref_tab, ref_field, row_id, kind, loaded_at of every reference without a valid target.

    cve_id and commit_id compare without regard to case and outer white space, software ids exactly.
    A commit_id of fewer than 40 digits is looked up among the commits of its own repository. Every
    delivered row is judged by itself; empty references are `missing`, null ones are no references.
    """
    tidy = lambda c: F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    parts = []

    def keep(judged: DataFrame, tab: str, field: str) -> None:
        parts.append(judged.where("kind is not null").select(F.lit(tab).alias("ref_tab"), F.lit(field).alias("ref_field"), "row_id", "kind", F.col("ref_loaded").alias("loaded_at")))

    patch = patch.select(
        F.col("patch_id").alias("row_id"),
        tidy("cve_id").alias("cve_key"),
        tidy("commit_id").alias("commit_key"),
        F.concat_ws("%", "repo_owner", "repo_name").alias("ref_repo"),
        F.col("loaded_at").alias("ref_loaded"),
    )
    cves = validity(cve.withColumn("key", tidy("cve_id")), "key", "cve_row")
    keep(judge(patch.select("row_id", F.col("cve_key").alias("ref_key"), "ref_loaded"), cves), "patch", "cve_id")

    log = commit_log.withColumn("key", tidy("commit_id"))
    refs = patch.select("row_id", "ref_repo", F.col("commit_key").alias("ref_key"), "ref_loaded")
    full = refs.where(F.length("ref_key") >= 40)
    keep(judge(full, validity(log, "key", "commit_row")), "patch", "commit_id")
    keep(judge_shortened(refs.where(F.length("ref_key") < 40), validity(log, "key", "commit_row", "repo")), "patch", "commit_id")

    known = validity(software, "unique_id", "software_row")
    for field in ("src_id", "dst_id"):
        keep(judge(reuses.select(F.col("reuse_id").alias("row_id"), F.col(field).alias("ref_key"), F.col("loaded_at").alias("ref_loaded")), known), "reuses", field)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def per_month(found: DataFrame) -> DataFrame:
    """ref_tab, ref_field, month (yyyy-MM of loading, null if unknown), kind, n."""
    month = F.date_format("loaded_at", "yyyy-MM")
    return found.groupBy("ref_tab", "ref_field", month.alias("month"), "kind").agg(F.count(F.lit(1)).alias("n"))
