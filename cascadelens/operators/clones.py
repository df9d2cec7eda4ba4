"""Reuse of functions between projects: time-directed Hamming similarity and reuse rates."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cascadelens.session import via_table

#: Bits of 64 in which two fingerprints may differ; least share of reused functions.
HAMMING, BASE_THRESHOLD = 8, 0.1
#: So many fingerprints of a key meet in one task; a key with more is cut.
CELL = 100_000
#: In a task, sets of up to so many pairs are compared pair by pair, so many at a time; larger ones are cut into keys again.
PAIRS, BLOCK = 1 << 26, 1 << 16


def bands_together(n: int, distance: int = HAMMING) -> int:
    """How many bands make a key, so that of n fingerprints about half a cell shares a key by chance."""
    together = 1
    while n / 2 ** (64 * together / (distance + together)) > CELL / 2 and together < 64 - distance:
        together += 1
    return together


def _bands(ones: np.ndarray, count: int) -> list[int]:
    """`count` disjoint sets of bits as masks; `ones` has the share of fingerprints with each bit.

    A bit that nearly all have or lack tells few apart, so every band gets as much entropy as any other.
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        told = -np.nan_to_num(ones * np.log2(ones)) - np.nan_to_num((1 - ones) * np.log2(1 - ones))
    masks, sums = [0] * count, [0.0] * count
    for bit in np.argsort(-told, kind="stable").tolist():
        least = min(range(count), key=lambda i: (sums[i], masks[i].bit_count()))
        masks[least] |= 1 << bit
        sums[least] += told[bit]
    return masks


def _first_bands(apart: np.ndarray, masks: list[int], together: int) -> np.ndarray:
    """The first `together` bands without a difference, a bit each: one key stands for a pair."""
    agree = np.zeros(len(apart), np.uint64)
    for i, mask in enumerate(masks):
        agree |= ((apart & np.uint64(mask)) == 0).astype(np.uint64) << np.uint64(i)
    rest = agree.copy()
    for _ in range(together):
        rest &= rest - np.uint64(1)
    return agree ^ rest


def _near(f: np.ndarray, g: np.ndarray | None, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in f and g of all pairs within the distance, each once; without g of two different places in f.

    Large sets are cut into bands by their own bits: what they share, as the key that led them here, has no entropy.
    """
    other = f if g is None else g
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if len(f) * len(other) <= PAIRS:
        step = max(1, BLOCK // max(len(other), 1))
        for at in range(0, len(f), step):
            first = at + 1 if g is None else 0
            i, j = np.nonzero(np.bitwise_count(f[at : at + step, None] ^ other[None, first:]) <= distance)
            i, j = i + at, j + first
            found.append((i, j) if g is not None else (i[i < j], j[i < j]))
    else:
        bits = np.arange(64, dtype=np.uint64)
        masks = _bands(np.array([((other >> b) & np.uint64(1)).mean() for b in bits]), distance + 1)
        for k, mask in enumerate(masks):
            in_f, in_g = _by_value(f & np.uint64(mask)), None if g is None else _by_value(g & np.uint64(mask))
            for value, x in in_f.items():
                y = x if in_g is None else in_g.get(value)
                if y is None or (g is None and len(x) < 2):
                    continue
                whole = len(x) == len(f) and len(y) == len(other)
                i, j = _halves(f[x], None if g is None else g[y], distance) if whole else _near(f[x], None if g is None else g[y], distance)
                i, j = x[i], y[j]
                first = _first_bands(f[i] ^ other[j], masks[: k + 1], 1) == np.uint64(1 << k)
                found.append((i[first], j[first]))
    return tuple(np.concatenate([p[side] for p in found]) if found else np.zeros(0, np.int64) for side in (0, 1))


def _halves(f: np.ndarray, g: np.ndarray | None, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """As `_near`, by halves of f: for a set that a band leaves whole."""
    half = len(f) // 2
    parts = [(0, 0, _near(f[:half], g, distance)), (half, 0 if g is not None else half, _near(f[half:], g, distance))]
    if g is None:
        parts.append((0, half, _near(f[:half], f[half:], distance)))
    return tuple(np.concatenate([p[2][side] + p[side] for p in parts]) for side in (0, 1))


def _by_value(values: np.ndarray) -> dict[int, np.ndarray]:
    """The places of each value."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(values) else np.zeros(0, np.int64)
    return dict(zip(ordered[starts].tolist(), np.split(order, starts[1:]), strict=True))


def near_fingerprints(left: DataFrame, right: DataFrame, distance: int = HAMMING) -> DataFrame:
    """fa, fb within the distance, each pair once; left(fa), right(fb) are distinct and not null.

    The 64 bits are cut into distance + together bands. Two fingerprints within the distance differ in at
    most `distance` bands and so agree on a key of `together` bands in full; the first such key stands for
    the pair. Few wide sets are shuffled and not many narrow ones: those of a key meet in a task, which cuts
    them further by itself (`_near`). A fingerprint of both sides is one row. A key with very many
    fingerprints is cut into cells, and every two cells meet in a task.
    """
    if left is right:
        sides = left.select(F.col("fa").alias("f"), F.lit(3).alias("side"))
    else:
        sides = left.select(F.col("fa").alias("f"), F.lit(1).alias("side")).unionByName(right.select(F.col("fb").alias("f"), F.lit(2).alias("side"))).groupBy("f").agg(F.sum("side").cast("int").alias("side"))
    sides = via_table(sides, "sides")
    count, *ones = sides.agg(F.count(F.lit(1)), *[F.count_if(F.shiftrightunsigned("f", i).bitwiseAND(F.lit(1)) == 1) for i in range(64)]).first()
    together = bands_together(count, distance)
    bands = _bands(np.array(ones) / max(count, 1), distance + together)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = F.array(*[F.struct(F.lit(signed(sum(bands[i] for i in c))).cast("bigint").alias("bits"), F.lit(sum(1 << i for i in c)).cast("bigint").alias("chosen")) for c in combinations(range(len(bands)), together)])
    keyed = sides.select("f", "side", F.inline(keys)).select("f", "side", "chosen", F.col("f").bitwiseAND(F.col("bits")).alias("key"))
    hot = via_table(keyed.groupBy("chosen", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL).select("chosen", "key", F.ceil(F.col("n") / CELL).cast("int").alias("cells")), "hot")
    own = F.pmod(F.xxhash64("f"), F.coalesce("cells", F.lit(1))).cast("int")
    celled = keyed.join(hot, ["chosen", "key"], "left").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("cells", F.lit(1)) - 1)))
    cells = celled.select("f", "side", "chosen", "key", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        f, side, cell = rows["f"].to_numpy().view(np.uint64), rows["side"].to_numpy(), rows["own"].to_numpy()
        chosen, i, j = key[0].as_py(), key[2].as_py(), key[3].as_py()
        if i == j:
            x, y = _near(f, None, distance)
        else:
            here, there = np.flatnonzero(cell == i), np.flatnonzero(cell == j)
            x, y = _near(f[here], f[there], distance)
            x, y = here[x], there[y]
        first = _first_bands(f[x] ^ f[y], bands, together) == np.uint64(chosen)
        x, y = np.r_[x[first], y[first]], np.r_[y[first], x[first]]
        asked = ((side[x] & 1) != 0) & ((side[y] & 2) != 0)
        return pa.table({"fa": f[x[asked]].view(np.int64), "fb": f[y[asked]].view(np.int64)})

    met = cells.groupBy("chosen", "key", "i", "j").applyInArrow(meet, "fa bigint, fb bigint")
    return met.unionByName(sides.where("side = 3").select(F.col("f").alias("fa"), F.col("f").alias("fb")))


def similar_functions(projects: DataFrame, library: DataFrame, distance: int = HAMMING) -> DataFrame:
    """id, repo_b: functions of `projects` that another repository of `library` has in an older form.

    Both have id, repo, fingerprint, birth; an id has one fingerprint. Fingerprints that agree in full are
    folded first, so copies cost one row.
    """
    fold = lambda d, f: via_table(d.where("fingerprint is not null").select(F.col("fingerprint").alias(f)).distinct(), "fingerprints")
    left = fold(projects, "fa")
    near = near_fingerprints(left, left if library is projects else fold(library, "fb"), distance)
    a = projects.select(F.col("id"), F.col("repo").alias("repo_a"), F.col("fingerprint").alias("fa"), F.col("birth").alias("birth_a"))
    # of equal fingerprints of a repository only the oldest and an undated one can matter, and so of all that are near one
    oldest = [F.min("birth_b").alias("birth_b"), F.max("undated").alias("undated")]
    b = library.where("fingerprint is not null").select(F.col("repo").alias("repo_b"), F.col("fingerprint").alias("fb"), F.col("birth").alias("birth_b"), F.col("birth").isNull().alias("undated")).groupBy("repo_b", "fb").agg(*oldest)
    # pairs are shuffled twice only: by fb to their repositories, by fa to the functions asked for, where all else is done
    forms = near.join(b, "fb").select("fa", "repo_b", "birth_b", "undated").repartition("fa").groupBy("fa", "repo_b").agg(*oldest)
    earlier = F.col("birth_a").isNull() | F.col("undated") | (F.col("birth_b") < F.col("birth_a"))
    return a.join(forms, "fa").where((F.col("repo_a") != F.col("repo_b")) & earlier).select("fa", "id", "repo_a", "repo_b").distinct().drop("fa")


def reuse_rates(projects: DataFrame, matches: DataFrame) -> DataFrame:
    """repo_a, repo_b, common, total, reuse_rate."""
    total = projects.groupBy(F.col("repo").alias("repo_a")).agg(F.count(F.lit(1)).alias("total"))
    # pairs are dealt out by repo_a alone, so that they meet their totals without another shuffle
    common = matches.repartition("repo_a").groupBy("repo_a", "repo_b").agg(F.count(F.lit(1)).alias("common"))
    return common.join(total, "repo_a").select("repo_a", "repo_b", "common", "total", (F.col("common") / F.col("total")).alias("reuse_rate"))


def adaptive_threshold(reused: Column, total: Column, base: float = BASE_THRESHOLD) -> Column:
    """1 / activity, held between 0.01 and 1; the base where nothing was reused yet."""
    # one division, so that a rate of as many of as many is no less than its threshold
    return F.when((total > 0) & (reused > 0), F.greatest(F.lit(0.01), F.least(F.lit(1.0), total / reused))).otherwise(F.lit(base))


def reuse_relations(rates: DataFrame, stats: DataFrame | None = None, base: float = BASE_THRESHOLD) -> DataFrame:
    """Rates of at least the base and the library's adaptive threshold; `stats`: repo_b, reused, functions."""
    # a rate below the base is out whatever its threshold, so it isn't shuffled to it
    rates = rates.where(F.col("reuse_rate") >= base)
    if stats is None:
        judged = rates.withColumn("adaptive_threshold", F.lit(base))
    else:
        judged = rates.join(stats, "repo_b", "left").withColumn("adaptive_threshold", F.coalesce(adaptive_threshold(F.col("reused"), F.col("functions"), base), F.lit(base)))
    return judged.where(F.col("reuse_rate") >= F.col("adaptive_threshold")).select("repo_a", "repo_b", "common", "total", "reuse_rate", "adaptive_threshold")


def reuse_statistics(functions: DataFrame, rates: DataFrame) -> DataFrame:
    """repo_b, functions, reused: how many functions a repository has, and how many functions of others are reuses of it."""
    size = functions.groupBy(F.col("repo").alias("repo_b")).agg(F.count(F.lit(1)).alias("functions"))
    taken = rates.groupBy("repo_b").agg(F.sum("common").alias("reused"))
    return size.join(taken, "repo_b", "left").select("repo_b", "functions", F.coalesce("reused", F.lit(0)).alias("reused"))
