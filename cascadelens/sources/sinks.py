"""Sinks: JSON, edge lists, lists, tables by key, and runs that go on where they stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cascadelens.operators.knowledge import last_per_key


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_edges(edges: DataFrame, path: str) -> None:
    """Edges s -> x as CSV with the columns origin_tpl_uuid (the reuser) and reuse_tpl_uuid."""
    edges.select(F.col("s").alias("origin_tpl_uuid"), F.col("x").alias("reuse_tpl_uuid")).write.mode("overwrite").csv(path, header=True)


def write_list(df: DataFrame, column: str, path: str) -> None:
    """One value a line."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_by_key(df: DataFrame, key: str, path: str) -> None:
    """Parquet in a folder a key, rows of a key written by few tasks."""
    df.write.mode("overwrite").partitionBy(key).parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str, *order: str) -> DataFrame:
    """The rows of `old` with those of `new` in their place; of repeated new keys the last in `order` is kept.

    Without `order` it's the one with the greatest values, column by column.
    """
    fresh = last_per_key(new, key, *(order or new.columns))
    return old.join(fresh.select(key), key, "left_anti").select(*old.columns).unionByName(fresh.select(*old.columns))


def merge_edges(edges: DataFrame, *keys: str) -> DataFrame:
    """Each edge once."""
    return edges.dropDuplicates(list(keys))


def not_done(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What isn't in the table of finished work yet."""
    return work.join(done.select(key), key, "left_anti")


def chunks(df: DataFrame, size: int = 200) -> DataFrame:
    """The rows in partitions of about `size`."""
    return df.repartition(max(1, -(-df.count() // size)))
