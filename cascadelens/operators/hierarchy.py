"""Problem 4: parent-child rows become full hierarchies, by heavy-path decomposition.

All steps are rounds of pointer doubling, so their number grows with the logarithm of the depth, and
each round is joins and sums over one row a node. First, every node jumps up 1, 2, 4, ... levels;
nodes that never come to a root are on or below a loop. The same jumps add up subtree sizes. Then
the largest child of each node continues its chain; a node's place is its chain's head and its offset
in it. At most log2(n) chains lie between a node and its root, so depth, path and preorder position
are put together over the small tree of chains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cascadelens.session import cut_lineage

CYCLE = "CYCLE"
#: Siblings are numbered in so many blocks a parent, each in a task of its own at most.
SIBLING_BLOCKS = 256


def parent_of(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """One row a node: id, up (its parent or null), n_parents.

    Repeated edges count once. Of several parents the smallest id is the tree's; a null end of an
    edge is no node. An edge from a node to itself is a loop of one.
    """
    pairs = edges.select(F.col(parent).alias("p"), F.col(child).alias("c"))
    both = pairs.select(F.col("c").alias("id"), F.col("p").alias("up")).where("id is not null")
    tops = pairs.select(F.col("p").alias("id"), F.lit(None).cast("string").alias("up")).where("id is not null")
    return both.unionByName(tops).distinct().groupBy("id").agg(F.min("up").alias("up"), F.count("up").alias("n_parents"))


def climb(nodes: DataFrame, sums: list[str] = (), text: str | None = None, sizes: bool = False) -> tuple[DataFrame, int]:
    """Pointer doubling over nodes(id, up, *sums, text).

    Gives (id, top, *sums, text, size) where the sums and texts are added up along the way to the top
    (those of the top itself excluded), size counts the nodes below and the node; and the distance
    jumped last. Nodes without a top keep `jump`, which is on their loop if far enough.
    """
    fold = list(sums)
    state = nodes.select(
        "id",
        F.col("up").alias("jump"),
        F.when(F.col("up").isNull(), F.col("id")).alias("top"),
        *[F.when(F.col("up").isNotNull(), F.col(s)).otherwise(0).cast("bigint").alias(s) for s in fold],
        *([F.when(F.col("up").isNotNull(), F.col(text)).otherwise("").alias(text)] if text else []),
        *([F.lit(1).cast("bigint").alias("size")] if sizes else []),
    )
    state = cut_lineage(state)
    open_before, reach = state.where("jump is not null").count(), 1
    while open_before:
        seen = state.select(
            F.col("id").alias("jump"),
            F.col("jump").alias("_jump"),
            F.col("top").alias("_top"),
            *[F.col(s).alias(f"_{s}") for s in fold],
            *([F.col(text).alias("_text")] if text else []),
        )
        step = state.join(seen, "jump", "left").select(
            "id",
            F.col("_jump").alias("jump"),
            F.coalesce("top", "_top").alias("top"),
            *[(F.col(s) + F.coalesce(f"_{s}", F.lit(0))).alias(s) for s in fold],
            *([F.concat(F.coalesce("_text", F.lit("")), text).alias(text)] if text else []),
            *([F.col("size")] if sizes else []),
        )
        if sizes:
            added = state.where("jump is not null").groupBy(F.col("jump").alias("id")).agg(F.sum("size").alias("_added"))
            step = step.join(added, "id", "left").withColumn("size", F.col("size") + F.coalesce("_added", F.lit(0))).drop("_added")
        state = cut_lineage(step)
        open_now = state.where("jump is not null").count()
        reach *= 2
        # depths are without gaps: a round that settles nobody leaves only loops and what hangs on them
        if open_now == open_before or not open_now:
            break
        open_before = open_now
    return state, reach


def _earlier_siblings(light: DataFrame) -> DataFrame:
    """light(id, up, size) with `before`: the sizes of the siblings that come first.

    Siblings are dealt to blocks by a hash, so that a node with a third of all rows as its children
    is numbered in many tasks; the blocks' totals are few rows a parent.
    """
    blocked = light.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(SIBLING_BLOCKS)).cast("int"))
    inside = Window.partitionBy("up", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("up").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy("up", "block").agg(F.sum("size").alias("total"))
    starts = totals.select("up", "block", F.coalesce(F.sum("total").over(across), F.lit(0)).alias("start"))
    own = blocked.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return own.join(starts, ["up", "block"]).select("id", "up", "size", (F.col("start") + F.col("own")).alias("before"))


def decompose(edges: DataFrame, parent: str, child: str) -> tuple[DataFrame, DataFrame]:
    """(places, loops) of the forest.

    places: unique_id, parent_id, n_parents, root_id, depth, n_descendants, chain (head of its heavy
    path), chain_offset, first_pos, last_pos (preorder positions within the root's tree: descendants are
    exactly the nodes of the root with a position in (first_pos, last_pos]). Nodes on a loop or below
    one have root_id `CYCLE`, depth -1 and null elsewhere. loops: id, jump of those nodes.
    """
    nodes = cut_lineage(parent_of(edges, parent, child))
    settled, _ = climb(nodes, sizes=True)
    sized = nodes.join(settled.where("top is not null").select("id", "size"), "id")
    heavy = (
        sized.where("up is not null")
        .groupBy("up")
        .agg(F.max(F.struct(F.col("size"), F.col("id"))).alias("h"))
        .select("up", F.col("h.id").alias("heavy_id"), F.col("h.size").alias("heavy_size"))
    )
    marked = cut_lineage(sized.join(heavy, "up", "left").withColumn("is_heavy", F.coalesce(F.col("id") == F.col("heavy_id"), F.lit(False))))
    links = marked.select("id", F.when(F.col("is_heavy"), F.col("up")).alias("up"), F.lit(1).alias("chain_offset"))
    chains, _ = climb(links, sums=["chain_offset"])
    placed = chains.select("id", F.col("top").alias("chain"), "chain_offset")
    light = _earlier_siblings(marked.where("up is not null and not is_heavy").select("id", "up", "size"))
    heads = (
        marked.where("not is_heavy")
        .select("id", "up", "heavy_size")
        .join(light.select("id", "before"), "id", "left")
        .join(placed.select(F.col("id").alias("up"), F.col("chain").alias("up_chain"), F.col("chain_offset").alias("up_offset")), "up", "left")
        .select("id", F.col("up_chain").alias("up"), (F.col("up_offset") + 1).alias("depth"), (F.col("up_offset") + 1 + F.coalesce("heavy_size", F.lit(0)) + F.coalesce("before", F.lit(0))).alias("pos"))
    )
    tops, _ = climb(heads, sums=["depth", "pos"])
    located = placed.join(tops.select(F.col("id").alias("chain"), F.col("top").alias("root_id"), "depth", "pos"), "chain")
    places = nodes.join(located, "id", "left").join(settled.select("id", "size", F.col("top").isNotNull().alias("whole")), "id", "left")
    valid = F.coalesce(F.col("whole"), F.lit(False))
    when = lambda c: F.when(valid, c)
    first = F.col("pos") + F.col("chain_offset")
    return (
        places.select(
            F.col("id").alias("unique_id"),
            F.col("up").alias("parent_id"),
            "n_parents",
            F.when(valid, F.col("root_id")).otherwise(CYCLE).alias("root_id"),
            F.when(valid, F.col("depth") + F.col("chain_offset")).otherwise(F.lit(-1)).cast("bigint").alias("depth"),
            when(F.col("size") - 1).alias("n_descendants"),
            when(F.col("chain")).alias("chain"),
            when(F.col("chain_offset")).alias("chain_offset"),
            when(first).alias("first_pos"),
            when(first + F.col("size") - 1).alias("last_pos"),
        ),
        nodes.join(settled.where("top is null").select("id"), "id").select("id", "up"),
    )


def full_paths(places: DataFrame, separator: str = " > ") -> DataFrame:
    """unique_id, path: the ids from the root to the node, joined; null on and below loops.

    Each chain is written out once, in order; a node's path is the part of its chain down to it behind
    the parts of the chains above.
    """
    places = cut_lineage(places)
    own = places.where(F.col("depth") >= 0)
    chain = own.groupBy("chain").agg(F.sort_array(F.collect_list(F.struct("chain_offset", "unique_id"))).alias("m"))
    # `line` is the chain as an array; the text down to an offset is a slice of it
    chain = cut_lineage(chain.select("chain", F.transform("m", lambda x: x["unique_id"]).alias("line")))

    def down_to(line: Column, offset: Column) -> Column:
        return F.array_join(F.slice(line, F.lit(1), (offset + 1).cast("int")), separator)

    heads = own.where("chain_offset = 0").select(F.col("unique_id").alias("id"), "parent_id")
    above = own.select(F.col("unique_id").alias("parent_id"), F.col("chain").alias("up"), "chain_offset")
    segments = heads.join(above, "parent_id", "left").join(chain.withColumnRenamed("chain", "up"), "up", "left")
    segments = segments.select("id", "up", F.concat(down_to(F.col("line"), F.col("chain_offset")), F.lit(separator)).alias("prefix"))
    prefixes, _ = climb(segments, text="prefix")
    whole = own.join(chain, "chain").join(prefixes.select(F.col("id").alias("chain"), "prefix"), "chain")
    paths = whole.select("unique_id", F.concat("prefix", down_to(F.col("line"), F.col("chain_offset"))).alias("path"))
    return places.select("unique_id").join(paths, "unique_id", "left")


def loops(looped: DataFrame) -> DataFrame:
    """loop_id (its smallest id), unique_id, on_loop of every node on a loop or below one."""
    state = cut_lineage(looped.select("id", F.col("up").alias("jump"), F.least("id", "up").alias("least")))
    count, reach = state.count(), 1
    while reach < count:
        seen = state.select(F.col("id").alias("jump"), F.col("jump").alias("_jump"), F.col("least").alias("_least"))
        state = cut_lineage(state.join(seen, "jump").select("id", F.col("_jump").alias("jump"), F.least("least", "_least").alias("least")))
        reach *= 2
    # after as many steps as there are nodes, a jump ends on the loop, and from each loop node the
    # jumps went all around it
    on = state.select(F.col("jump").alias("entry")).distinct()
    ring = state.join(on, state["id"] == on["entry"], "left_semi").select(F.col("id").alias("entry"), F.col("least").alias("loop_id"))
    return (
        state.join(ring, state["jump"] == ring["entry"])
        .select("loop_id", F.col("id").alias("unique_id"))
        .join(on.select(F.col("entry").alias("unique_id"), F.lit(True).alias("on_loop")), "unique_id", "left")
        .select("loop_id", "unique_id", F.coalesce("on_loop", F.lit(False)).alias("on_loop"))
    )


def descendants(places: DataFrame, of: DataFrame) -> DataFrame:
    """ancestor_id, unique_id for the ids in `of`(unique_id): an interval join within each root."""
    asked = places.join(of, "unique_id", "left_semi").select(F.col("unique_id").alias("ancestor_id"), "root_id", F.col("first_pos").alias("lo"), F.col("last_pos").alias("hi"))
    inner = places.where(F.col("depth") >= 0).select("unique_id", "root_id", "first_pos")
    return inner.join(asked, "root_id").where((F.col("first_pos") > F.col("lo")) & (F.col("first_pos") <= F.col("hi"))).select("ancestor_id", "unique_id")
