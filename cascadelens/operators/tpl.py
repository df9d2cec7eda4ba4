"""Which library a shared function comes from, and which libraries therefore depend on which."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cascadelens.functions.naming import path_segments

# Folders that say nothing of a function's origin, folders of foreign code, and the limits
# of recall, of the ratio of centralities, and of in-degree.
BLACK_SET = ["src", "external", "third_party", "3rdparty", "extern", "common", "tests", "thirdparty", "modules", "third-part", "deps", "source", "components", "extra"]
EXTERN_FLAG = ["external", "third_party", "3rdparty", "extern", "components", "third-party", "thirdparty", "deps"]
THETA, CENTRALITY_LIMIT, IN_DEGREE_LIMIT = 0.01, 1.5, 5.0


def first_seen(signatures: DataFrame) -> DataFrame:
    """func, tpl, born, path of the earliest copy in each library; undated copies come last, ties by path.

    `signatures`: tpl, func, time, path.
    """
    order = F.struct(F.col("time").isNull().alias("u"), F.col("time"), F.col("path"))
    return signatures.where("func is not null and tpl is not null").groupBy("func", "tpl").agg(F.min(order).alias("o")).select("func", "tpl", F.col("o.time").alias("born"), F.col("o.path").alias("path"))


def _held(births: DataFrame, names: DataFrame) -> DataFrame:
    shared = births.groupBy("func").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")
    segments = F.array_distinct(path_segments(F.col("path")))
    return (
        births.join(shared, "func")
        .join(names, "tpl", "left")
        .withColumn("segments", F.coalesce(segments, F.array().cast("array<string>")))
        .withColumn("external", F.arrays_overlap("segments", F.array(*[F.lit(x) for x in EXTERN_FLAG])))
    )


def path_votes(births: DataFrame, names: DataFrame) -> DataFrame:
    """func, segment, votes: the libraries that keep the function below a folder or file of that name."""
    held = _held(births, names)
    seg = held.select("func", "tpl", "tpl_name", F.explode("segments").alias("segment"))
    told = seg.where(~F.col("segment").isin(BLACK_SET) & ~F.col("segment").eqNullSafe(F.col("tpl_name")))
    return told.groupBy("func", "segment").agg(F.count(F.lit(1)).alias("votes"))


def origins(births: DataFrame, names: DataFrame, special: DataFrame | None = None) -> DataFrame:
    """func, origin, origin_time (null if settled by path), by_path of functions in two libraries or more.

    A segment with enough votes (one if at most three libraries hold the function, else two) that is
    the name of a holder whose own copy isn't foreign makes it a candidate, and the earliest candidate
    is the origin. Otherwise it's the earliest copy that isn't foreign. `special`: name, tpl of names
    that stand for one library whatever the holders; ties go to the least name.
    """
    held = _held(births, names)
    enough = path_votes(births, names).join(held.select("func", "holders").distinct(), "func").where(F.col("votes") >= F.when(F.col("holders") <= 3, 1).otherwise(2))
    own = held.where("not external")
    time_order: Column = F.struct(F.col("born").isNull().alias("u"), F.col("born"), F.col("tpl"))
    voted = own.join(enough.select("func", F.col("segment").alias("tpl_name"), "votes"), ["func", "tpl_name"]).groupBy("func").agg(F.min(time_order).alias("o"))
    by_path = voted.select("func", F.col("o.tpl").alias("origin"))
    if special is not None:
        top = enough.join(special.select(F.col("name").alias("segment"), F.col("tpl").alias("special_tpl")), "segment").groupBy("func").agg(F.min(F.struct((-F.col("votes")).alias("v"), "segment", "special_tpl")).alias("s"))
        by_path = by_path.join(top.select("func", F.col("s.special_tpl").alias("special")), "func", "full").select("func", F.coalesce("special", "origin").alias("origin"))
    by_time = own.groupBy("func").agg(F.min(time_order).alias("o")).select("func", F.col("o.tpl").alias("first_tpl"), F.col("o.born").alias("first_born"))
    return (
        by_time.join(by_path, "func", "full")
        .select("func", F.coalesce("origin", "first_tpl").alias("origin"), F.when(F.col("origin").isNull(), F.col("first_born")).alias("origin_time"), F.col("origin").isNotNull().alias("by_path"))
        .where("origin is not null")
    )


def reused_functions(births: DataFrame, origin: DataFrame) -> DataFrame:
    """s, x, func: functions of library s that come from library x."""
    joined = births.join(origin, "func")
    return joined.where((F.col("tpl") != F.col("origin")) & (F.col("by_path") | (F.col("origin_time") < F.col("born")))).select(F.col("tpl").alias("s"), F.col("origin").alias("x"), "func").distinct()


def recalled_edges(births: DataFrame, reused: DataFrame, theta: float = THETA, mode: str = "literal") -> DataFrame:
    """s, x, n, n_x, r_x: dependencies with enough functions.

    n functions of x are in s; x has n_x, of which r_x come from others. `literal`: n / n_x >= theta
    * n_x / r_x, put without division (false where r_x is 0); `intended`: n / (n_x - r_x) >= theta.
    """
    n_x = births.groupBy(F.col("tpl").alias("x")).agg(F.count(F.lit(1)).alias("n_x"))
    r_x = reused.groupBy(F.col("s").alias("x")).agg(F.count_distinct("func").alias("r_x"))
    edges = reused.groupBy("s", "x").agg(F.count(F.lit(1)).alias("n"))
    joined = edges.join(n_x, "x").join(r_x, "x", "left").withColumn("r_x", F.coalesce("r_x", F.lit(0))).where("n_x - r_x >= 1")
    keep = F.col("n") * F.col("r_x") >= theta * F.col("n_x") * F.col("n_x") if mode == "literal" else F.col("n") / (F.col("n_x") - F.col("r_x")) >= theta
    return joined.where(keep).select("s", "x", "n", "n_x", "r_x")


def one_direction(edges: DataFrame) -> DataFrame:
    """Of two edges against one another only the one with more functions stays; with equally many none."""
    back = edges.select(F.col("s").alias("x"), F.col("x").alias("s"), F.col("n").alias("n_back"))
    return edges.join(back, ["s", "x"], "left").where(F.col("n_back").isNull() | (F.col("n") > F.col("n_back"))).drop("n_back")


def prune_by_centrality(edges: DataFrame, degree: DataFrame, rank: DataFrame, in_degree: float = IN_DEGREE_LIMIT, ratio: float = CENTRALITY_LIMIT) -> DataFrame:
    """Edges s -> x without those whose s is depended on a lot while x ranks far above its in-degree."""
    d_s, d_x = degree.select(F.col("id").alias("s"), F.col("in_degree").alias("ds")), degree.select(F.col("id").alias("x"), F.col("in_degree").alias("dx"))
    joined = edges.join(d_s, "s", "left").join(d_x, "x", "left").join(rank.select(F.col("id").alias("x"), "rank"), "x", "left")
    drop = F.coalesce((F.col("ds") > in_degree) & (F.col("rank") / F.when(F.col("dx") != 0, F.col("dx")) > ratio), F.lit(False))
    return joined.where(~drop).select(*edges.columns)


def score(found: DataFrame, truth: DataFrame) -> DataFrame:
    """tp, found, truth, precision, recall, f1 of two edge sets (s, x); null where a set is empty."""
    f, t = found.select("s", "x").distinct(), truth.select("s", "x").distinct()
    both = f.withColumn("f", F.lit(1)).join(t.withColumn("t", F.lit(1)), ["s", "x"], "full")
    c = both.agg(F.count(F.when(F.col("f").isNotNull() & F.col("t").isNotNull(), 1)).alias("tp"), F.count("f").alias("n_found"), F.count("t").alias("n_truth"))
    p, r = F.try_divide("tp", "n_found"), F.try_divide("tp", "n_truth")
    return c.select("tp", "n_found", "n_truth", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))
