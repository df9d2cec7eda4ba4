"""Queries of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cascadelens.llm import bpe, canonical, handwritten, minhash, mixing, reading
from cascadelens.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of rows whose functions are near-duplicates."""
    found = minhash.near_duplicates(table(spark, folder, "function_signature"), "fs_id", "content")
    return minhash.pairs_of_rows(*found).select(F.col("row_a").alias("fs_a"), F.col("row_b").alias("fs_b"))


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The group of near-duplicates of each function."""
    found = minhash.near_duplicates(table(spark, folder, "function_signature"), "fs_id", "content")
    return minhash.groups(*found).select(F.col("row_id").alias("fs_id"), "group_id", "n_links")


def p6_mapped(spark: SparkSession, folder: str) -> DataFrame:
    """The entry that each typed name means, or why none."""
    return canonical.map_rows(table(spark, folder, "sbom_component"), "sbom_id", table(spark, folder, "git2cpe"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose name means an entry of the list."""
    return p6_mapped(spark, folder).where("status = 'matched'").select("sbom_id", "ref_id")


def p7_files(spark: SparkSession, folder: str) -> DataFrame:
    """What kind of file each is, and why."""
    return handwritten.classify(table(spark, folder, "function_signature"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files that were not written by hand."""
    return p7_files(spark, folder).where("kind is not null").select("author", "repo_name", "file_path")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.token_ids(table(spark, folder, "documents"), "doc_id", "text")


def _mixture(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "mix_target"))


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """How often each document is used."""
    return _mixture(spark, folder)[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source."""
    return _mixture(spark, folder)[1]


def p10_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Estimated reading level of every document."""
    return reading.reading_levels(table(spark, folder, "documents"), table(spark, folder, "reading_label"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """English documents whose prose is hard to read."""
    return p10_levels(spark, folder).where("english and band = 'hard'").select("doc_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_groups, p6_found, p6_mapped, p7_found, p7_files, p8_ids, p9_mixture, p9_shares, p10_found, p10_levels)}
ORACLE: dict[str, str] = {}
