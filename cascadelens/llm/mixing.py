"""Problem 9: mixing sources to target weights, by capped water-filling.

Totals are one row a source. Sources that cannot reach their share even at their maximum number of
repetitions are clamped there, and what they leave is spread over the others in proportion, until
nothing is clamped any more. Whole repetitions go to every document of a source; the fraction that is
left goes to documents in the order of a seeded hash, up to the wanted size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cascadelens.llm.bpe import VOCABULARY, token_counts
from cascadelens.session import via_table

SEED = 20_240_501
#: Hash values are counted in so many slices a source to find the cut of the fraction.
SLICES = 4096
#: The list of targets is gathered to the driver; it must not be longer.
MAX_SOURCES = 100_000


def water_fill(sizes: dict[str, int], weights: dict[str, float], most: dict[str, int], total: float | None = None) -> dict[str, float]:
    """Repetitions of each source.

    Without `total` the mixture is as large as all its sources together. Sources without size, weight
    or allowed use get 0. When everything is clamped, the mixture is smaller than `total`.
    """
    live = {s for s, w in weights.items() if w and w > 0 and sizes.get(s, 0) > 0 and most.get(s, 0) > 0}
    goal = float(sum(sizes[s] for s in live) if total is None else total)
    amount = dict.fromkeys(weights, 0.0)
    free, left = set(live), goal
    while free:
        whole = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / whole > most[s] * sizes[s]}
        if not over:
            for s in free:
                amount[s] = left * weights[s] / whole
            break
        for s in over:
            amount[s] = float(most[s] * sizes[s])
        left -= sum(amount[s] for s in over)
        free -= over
    return {s: (amount[s] / sizes[s] if sizes.get(s) else 0.0) for s in weights}


def mixture(documents: DataFrame, targets: DataFrame, total: float | None = None, path: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(uses, shares).

    uses: doc_id, source, n_tokens, uses, of every document of a target source (uses may be 0).
    shares: source, target_share (of the given weights), max_repeat, n_documents, tokens, epochs
    (planned repetitions), mixed_tokens, actual_share. Documents with a null source, or of a source
    without target, are in neither. Null and empty texts have 0 tokens. A target source without
    documents has a row of zeros. Repeated targets count once, by the largest share.
    """
    spark = documents.sparkSession
    wanted = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeat").alias("max_repeat"))
    rows = wanted.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    names = wanted.select("source")
    known = documents.where("source is not null").select("doc_id", "source", "text").join(names, "source", "left_semi")
    counted = via_table(token_counts(known, "text", ["doc_id", "source"], path), "sizes").withColumn("order_key", F.xxhash64(F.lit(SEED), "source", "doc_id"))
    counted = counted.withColumn("slice", F.pmod(F.shiftrightunsigned("order_key", 40), F.lit(SLICES)).cast("int"))
    per_slice = counted.groupBy("source", "slice").agg(F.sum("n_tokens").alias("size"), F.count(F.lit(1)).alias("n"))
    totals = {r["source"]: int(r["size"] or 0) for r in per_slice.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    weights = {r["source"]: float(r["target_share"] or 0) for r in rows}
    most = {r["source"]: int(r["max_repeat"] or 0) for r in rows}
    epochs = water_fill(totals, weights, most, total)
    plan = spark.createDataFrame(
        [(s, weights[s], most[s], e, int(e), (e - int(e)) * totals.get(s, 0)) for s, e in sorted(epochs.items())],
        "source string, target_share double, max_repeat int, epochs double, whole int, rest double",
    )
    # the slice in which the fraction ends, and what lies before it
    along = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    cut = per_slice.withColumn("before", F.coalesce(F.sum("size").over(along), F.lit(0))).select("source", "slice", "before", "size")
    placed = counted.join(cut, ["source", "slice"]).join(F.broadcast(plan.select("source", "whole", "rest")), "source")
    inner = Window.partitionBy("source", "slice").orderBy("order_key", "doc_id")
    at_cut = placed.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("size") > F.col("rest")))
    upto = F.col("before") + F.sum("n_tokens").over(inner.rowsBetween(Window.unboundedPreceding, 0))
    # the document at the cut is taken when more than half of it is wanted
    partly = at_cut.withColumn("more", (upto - F.col("n_tokens") / 2 <= F.col("rest")).cast("int"))
    others = placed.where(~((F.col("before") < F.col("rest")) & (F.col("before") + F.col("size") > F.col("rest"))))
    others = others.withColumn("more", (F.col("before") + F.col("size") <= F.col("rest")).cast("int") * (F.col("rest") > 0).cast("int"))
    uses = partly.unionByName(others).select("doc_id", "source", "n_tokens", (F.col("whole") + F.col("more")).alias("uses"))
    mixed = uses.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("uses")).alias("mixed_tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    joined = plan.join(mixed, "source", "left").select("source", "target_share", "max_repeat", zero("n_documents").alias("n_documents"), zero("tokens").alias("tokens"), "epochs", zero("mixed_tokens").alias("mixed_tokens"))
    share = F.try_divide(F.col("mixed_tokens"), F.sum("mixed_tokens").over(Window.partitionBy()))
    return uses, joined.withColumn("actual_share", F.coalesce(share, F.lit(0.0)))
