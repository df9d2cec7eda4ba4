"""Problem 2: functions that are the same but for small edits, by MinHash banding.

Rows whose bare token sequences agree are folded to one representative first, so a group of copies
costs one signature however large it is. Representatives meet where a band of their signature agrees
(a shuffle on the band's hash), every pair that meets is verified on the full sets of token runs, and
pairs and groups of rows are put together again from the membership.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cascadelens.llm import codetokens
from cascadelens.operators.graph import connected_components
from cascadelens.session import cut_lineage, spread, via_table

#: Runs of so many tokens, and the share of them that two functions must have in common.
WIDTH, SIMILARITY = 3, 0.7
#: Wanted chance that a pair just at the threshold meets in a band, and rows of a band.
RECALL, ROWS = 0.995, 5
#: So many of a band meet in one task; a band with more is cut.
CELL = 5_000
#: Such bands are looked for among one of so many ids: what is overlooked is only not cut.
LOOKED = 64
#: Token runs are hashed for so many at a time, so that the work stays in the processor's cache.
_BLOCK = 1 << 15


def bands_for(similarity: float, rows: int, recall: float) -> int:
    """Bands needed so that a pair at the threshold meets in one of them with the wanted chance."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def _coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = codetokens.mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:count] | np.uint64(1), seeds[count:]


def band_hashes(grams: np.ndarray, owners: np.ndarray, n: int, bands: int, rows: int) -> np.ndarray:
    """n x bands matrix of band hashes; texts without runs have zeros."""
    out = np.zeros((n, bands), dtype=np.uint64)
    if not len(grams):
        return out
    first = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
    who = owners[first]
    bounds = np.r_[first, len(grams)]
    scale, shift = _coefficients(bands * rows)
    at = 0
    while at < len(first):
        # whole texts up to the block's size; one text at least
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + _BLOCK, side="right")) - 1)
        part, starts = grams[bounds[at] : bounds[to]], bounds[at:to] - bounds[at]
        for band in range(bands):
            value = np.full(to - at, band + 1, dtype=np.uint64)
            for k in range(band * rows, (band + 1) * rows):
                value = codetokens.mix(value + np.minimum.reduceat(part * scale[k] + shift[k], starts))
            out[who[at:to], band] = value
        at = to
    return out


def _tokens(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    bare = [codetokens.bare(t) if isinstance(t, str) else "" for t in texts]
    return codetokens.runs(*codetokens.token_hashes(bare), WIDTH)


def signatures(df: DataFrame, row_id: str, text: str, bands: int, rows: int) -> DataFrame:
    """row_id, key_a, key_b (the token runs in their order, as 128 bits), bands; only rows with runs."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            grams, owners = _tokens(pdf[text])
            hashes = band_hashes(grams, owners, len(pdf), bands, rows)
            first = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]]) if len(grams) else np.zeros(0, dtype=int)
            who = owners[first]
            place = np.arange(len(grams), dtype=np.uint64) - np.repeat(first, np.diff(np.r_[first, len(grams)])).astype(np.uint64)
            keys = [np.add.reduceat(codetokens.mix(grams + place * np.uint64(m)), first) if len(grams) else grams for m in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
            yield pd.DataFrame(
                {
                    row_id: pdf[row_id].to_numpy()[who],
                    "key_a": keys[0].view(np.int64),
                    "key_b": keys[1].view(np.int64),
                    "bands": list(hashes[who].view(np.int64)),
                }
            )

    return df.select(row_id, text).mapInPandas(sign, f"{row_id} bigint, key_a bigint, key_b bigint, bands array<bigint>")


def run_sets(ids: np.ndarray, texts: pd.Series) -> dict[int, np.ndarray]:
    """The distinct token runs of each text, as 64-bit hashes; equal ids are read once."""
    at = np.unique(ids, return_index=True)[1]
    grams, owners = _tokens(texts.iloc[at])
    order = np.lexsort((grams, owners))
    grams, owners = grams[order], owners[order]
    new = np.r_[True, (owners[1:] != owners[:-1]) | (grams[1:] != grams[:-1])] if len(grams) else np.zeros(0, dtype=bool)
    grams, owners = grams[new], owners[new]
    return dict(zip(ids[at].tolist(), np.split(grams, np.searchsorted(owners, np.arange(1, len(at)))), strict=True))


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        a, b = run_sets(pdf["a"].to_numpy(), pdf["text_a"]), run_sets(pdf["b"].to_numpy(), pdf["text_b"])
        keep = np.zeros(len(pdf), dtype=bool)
        for i, (x, y) in enumerate(zip(pdf["a"], pdf["b"], strict=True)):
            u, v = a[x], b[y]
            both = len(np.intersect1d(u, v, assume_unique=True))
            keep[i] = both >= SIMILARITY * (len(u) + len(v) - both) - 1e-9
        yield pdf.loc[keep, ["a", "b"]]


def _meetings(buckets: DataFrame) -> DataFrame:
    """a < b of all that meet in a band of buckets(id, band); a pair that meets in several bands comes several times.

    A band that very many have is cut into cells by a hash of the id, and every two cells meet in a task
    of their own, so no task has more than the pairs of two cells.
    """
    some = buckets.where(F.pmod(F.xxhash64("id"), F.lit(LOOKED)) == 0).groupBy("band").agg((LOOKED * F.count(F.lit(1))).alias("n"))
    hot = via_table(some.where(F.col("n") > CELL).select("band", F.ceil(F.col("n") / CELL).cast("int").alias("cells")), "hot")
    if hot.isEmpty():
        return buckets.select(F.col("id").alias("a"), "band").join(buckets.select(F.col("id").alias("b"), "band"), "band").where("a < b").select("a", "b")
    parted = buckets.join(hot, "band", "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), F.col("cells")).cast("int")
    other = parted.withColumn("own", own).select("id", "band", "own", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("other"))
    placed = other.select("id", "band", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    left, right = (placed.select(F.col("id").alias(c), "band", "low", "high", F.col("own").alias(f"own_{c}")) for c in "ab")
    met = left.join(right, ["band", "low", "high"]).where("a < b")
    # two of one cell meet where that cell meets itself
    return met.where("own_a <> own_b or low = high").select("a", "b")


def near_duplicates(df: DataFrame, row_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of the rows of `df`.

    members: row_id, rep; rep is the smallest row id with the same bare tokens in the same order.
    pairs: a < b, representatives with a similarity of SIMILARITY or more. Null and empty texts, and
    texts of fewer than WIDTH tokens, have no runs and are in neither. Equal row ids count once.
    """
    base = df.select(F.col(row_id).cast("bigint").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    bands = bands_for(SIMILARITY, ROWS, RECALL)
    signed = via_table(signatures(spread(base), "id", "text", bands, ROWS), "signatures")
    reps = signed.groupBy("key_a", "key_b").agg(F.min("id").alias("rep"))
    members = cut_lineage(signed.select("id", "key_a", "key_b").join(reps, ["key_a", "key_b"]).select("id", "rep").distinct())
    heads = members.where("id = rep").select("id")
    # a band's hash has its number mixed in, so the hash alone is the key
    buckets = signed.join(heads, "id").select("id", F.explode("bands").alias("band"))
    candidates = cut_lineage(_meetings(buckets).distinct())
    # texts are shuffled once for both ends; they are smaller than the hashes of their runs
    both = candidates.join(base.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(base.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return members, both.mapInPandas(_shared, "a bigint, b bigint").distinct()


def pairs_of_rows(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """row_a < row_b of all rows that are near-duplicates, copies of one another included."""
    left, right = members.select(F.col("id").alias("x"), F.col("rep").alias("a")), members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    across = pairs.join(left, "a").join(right, "b").select("x", "y")
    within = left.join(right, left["a"] == right["b"]).where("x < y").select("x", "y")
    every = across.unionByName(within)
    return every.select(F.least("x", "y").alias("row_a"), F.greatest("x", "y").alias("row_b"))


def groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """row_id, group_id (smallest row id of the group), n_links (near-duplicates among the classes)."""
    pairs = cut_lineage(pairs)
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    joined = connected_components(pairs, "a", "b").select(F.col("id").alias("rep"), F.col("component").alias("group_id"))
    return (
        members.join(joined, "rep", "left")
        .join(links, "rep", "left")
        .select(F.col("id").alias("row_id"), F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
