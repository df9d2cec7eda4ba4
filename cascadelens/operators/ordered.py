"""Running values along an order within keys, where one key may hold most of the rows.

A window over a key runs in one task. Here the rows are cut by ranges of (keys, order) into blocks of
about equal size, windows run inside a key's part of one block, and what a block hands on to the next
(a count, a first or a last row) is a table of one row a key and block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cascadelens.session import via_table


def in_blocks(df: DataFrame, keys: list[str], order: list[str], label: str = "blocks") -> DataFrame:
    """`df` with `block`, written as a table: blocks follow one another in the order of keys and `order`."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return via_table(df.repartitionByRange(n, *keys, *order).withColumn("block", F.spark_partition_id()), label)


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """The keys agree, null with null."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def along(df: DataFrame, keys: list[str], order: list[str], ordinal: str | None = None, lead: dict[str, str] | None = None, lag: dict[str, str] | None = None, carried: dict[str, str] | None = None) -> DataFrame:
    """`df` with values along `order` (ascending, nulls first) within the keys.

    ordinal names a column for the row's number from 1. `lead`, `lag` and `carried` map a new column to
    the one it's taken from: of the next row, of the row before, and the last non-null one up to the
    row itself. `order` must not leave ties, or they are broken at will. Null keys are a key.
    """
    lead, lag, carried = lead or {}, lag or {}, carried or {}
    rows = in_blocks(df, keys, order)
    parts = [*keys, "block"]
    inside = Window.partitionBy(*parts).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    place = F.struct(*order)
    pick = lambda names: F.struct(*[F.col(c).alias(n) for n, c in names.items()]) if names else F.lit(None)
    ends = rows.groupBy(*parts).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by(pick(lead), place).alias("_first"),
        F.max_by(pick(lag), place).alias("_last"),
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(f"_kept_{n}") for n, c in carried.items()],
    )
    across = Window.partitionBy(*keys).orderBy("block")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("block").alias("_block"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.lead("_first").over(across).alias("_next"),
        F.lag("_last").over(across).alias("_prior"),
        *[F.last(f"_kept_{n}", ignorenulls=True).over(before).alias(f"_kept_{n}") for n in carried],
    )
    local = rows.select(
        "*",
        F.row_number().over(inside).alias("_row"),
        F.lead(F.lit(True), 1, False).over(inside).alias("_more"),
        *[F.lead(c).over(inside).alias(f"_lead_{n}") for n, c in lead.items()],
        *[F.lag(c).over(inside).alias(f"_lag_{n}") for n, c in lag.items()],
        *[F.last(c, ignorenulls=True).over(upto).alias(f"_here_{n}") for n, c in carried.items()],
    )
    match = reduce(lambda x, y: x & y, [local[k].eqNullSafe(handed[f"_k{i}"]) for i, k in enumerate(keys)], local["block"] == handed["_block"])
    out = local.join(handed, match)
    return out.select(
        *[local[c] for c in df.columns],
        *([(F.col("_offset") + F.col("_row")).cast("bigint").alias(ordinal)] if ordinal else []),
        *[F.when(F.col("_more"), F.col(f"_lead_{n}")).otherwise(F.col(f"_next.{n}")).alias(n) for n in lead],
        *[F.when(F.col("_row") > 1, F.col(f"_lag_{n}")).otherwise(F.col(f"_prior.{n}")).alias(n) for n in lag],
        *[F.coalesce(f"_here_{n}", f"_kept_{n}").alias(n) for n in carried],
    )
