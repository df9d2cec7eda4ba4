"""Connected components, PageRank and other iterative graph operators over edge tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cascadelens.session import cut_lineage, via_table


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """id, component (its smallest id) of every id in an edge.

    Alternating large-star and small-star rounds: each links the neighbours of a node to their least
    one, so the edges become stars in a number of rounds that grows with the logarithm of the size.
    Edges with a null end are left out; repeated edges and loops don't matter.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    current = cut_lineage(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = current.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    links = current.where("u <> v")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hung.select("u", F.col("m").alias("v")))
        links = cut_lineage(small.where("u <> v").distinct())
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return nodes.join(links.select(F.col("u").alias("id"), "v"), "id", "left").groupBy("id").agg(F.min(F.coalesce("v", "id")).alias("component"))


def in_degree_centrality(edges: DataFrame, source: str, target: str, weight: str) -> DataFrame:
    """id, in_degree: the weights of the edges to a node, over the number of other nodes."""
    ids = edges.select(F.explode(F.array(source, target)).alias("id")).distinct()
    others = ids.agg((F.count(F.lit(1)) - 1).alias("others"))
    into = edges.groupBy(F.col(target).alias("id")).agg(F.sum(weight).alias("w"))
    scaled = F.coalesce("w", F.lit(0.0)) / F.when(F.col("others") > 0, F.col("others"))
    return ids.join(into, "id", "left").crossJoin(F.broadcast(others)).select("id", F.coalesce(scaled, F.lit(0.0)).alias("in_degree"))


def pagerank(edges: DataFrame, source: str, target: str, weight: str, alpha: float = 0.85, tolerance: float = 1e-10) -> DataFrame:
    """id, rank; what dangling nodes hold is spread over all nodes.

    Rounds go on until the summed distance to the settled ranks is at most `tolerance`: it is bounded by
    alpha / (1 - alpha) times the last round's change, which shrinks by alpha or more a round.

    Every round sends rank along the edges before the shuffle's partial sums, so a node with very many
    incoming edges is added up in many tasks.
    """
    total = edges.groupBy(F.col(source).alias("s")).agg(F.sum(weight).alias("total"))
    links = cut_lineage(edges.select(F.col(source).alias("s"), F.col(target).alias("x"), F.col(weight).alias("w")).join(total, "s").select("s", "x", (F.col("w") / F.col("total")).alias("share")))
    ids = cut_lineage(links.select(F.explode(F.array("s", "x")).alias("id")).distinct())
    n = ids.count()
    if not n:
        return ids.select("id", F.lit(None).cast("double").alias("rank"))
    has_out = links.select(F.col("s").alias("id")).distinct().withColumn("out", F.lit(1))
    nodes = cut_lineage(ids.join(has_out, "id", "left").select("id", F.col("out").isNull().alias("dangling")))
    rank = nodes.select("id", "dangling", F.lit(1.0 / n).alias("rank"))
    moved = None
    while moved is None or moved * alpha / (1 - alpha) > tolerance:
        for _ in range(5):
            before = rank.select("id", F.col("rank").alias("before"))
            lost = rank.where("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
            sent = links.join(rank.select(F.col("id").alias("s"), "rank"), "s").groupBy(F.col("x").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
            new = (1 - alpha) / n + alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)
            rank = nodes.join(sent, "id", "left").crossJoin(F.broadcast(lost)).select("id", "dangling", new.alias("rank"))
        rank = via_table(rank.join(before, "id"), "rank")
        moved = rank.agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0]
        rank = rank.drop("before")
    return rank.select("id", "rank")


def paths_from(edges: DataFrame, source: str, target: str, roots: DataFrame) -> DataFrame:
    """root, id, level, path (array) of every path from the roots(id), which doesn't meet itself.

    One row a path: a node reached in two ways comes twice. Paths are of any length; as none meets
    itself, they end.
    """
    links = cut_lineage(edges.select(F.col(source).alias("s"), F.col(target).alias("x")).where("s is not null and x is not null").distinct())
    front = cut_lineage(roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("level"), F.array("id").alias("path")).distinct())
    out, level = front, 0
    while True:
        level += 1
        step = front.select("root", F.col("id").alias("s"), "path").join(links, "s").where(~F.array_contains("path", F.col("x")))
        front = cut_lineage(step.select("root", F.col("x").alias("id"), F.lit(level).alias("level"), F.concat("path", F.array("x")).alias("path")))
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out


def reach(edges: DataFrame, source: str, target: str, roots: DataFrame) -> DataFrame:
    """root, id, depth, path of every id that the roots(id) are reached from, along reversed edges.

    The closure in rounds: only ids found in the last round go on, and those known already are left
    out, so loops end it. depth is the least number of edges, path the least of the shortest ways, from
    the root to the id; a root is reached by itself with depth 0. Null ends are no edges.
    """
    links = via_table(edges.select(F.col(source).alias("up"), F.col(target).alias("id")).where("up is not null and id is not null and up <> id").distinct(), "links")
    front = via_table(roots.where("id is not null").select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"), F.array("id").alias("path")).distinct(), "reached")
    out = [front]
    while True:
        step = front.join(links, "id").select("root", F.col("up").alias("id"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("up")).alias("path"))
        # of an id of this round the least path; those of earlier rounds are nearer
        best = step.groupBy("root", "id").agg(F.min("depth").alias("depth"), F.min("path").alias("path"))
        for known in out:
            best = best.join(known.select("root", "id"), ["root", "id"], "left_anti")
        front = via_table(best, "reached")
        if front.isEmpty():
            break
        out.append(front)
        if len(out) > 8:
            # few tables to compare with, however many rounds there are
            out = [via_table(_union(out), "reached")]
    return _union(out)


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def propagate(affected: DataFrame, edges: DataFrame, source: str, target: str) -> DataFrame:
    """cve_id, id, depth, path: what each vulnerability reaches through reuse.

    `affected`: cve_id, id. An edge source -> target says that source reuses target, so the source is
    affected too. The closure is built once for each distinct affected id, and vulnerabilities are
    joined to it; an id reached from several affected ones has the nearest, then the least path.
    """
    hit = via_table(affected.where("cve_id is not null and id is not null").select("cve_id", "id").distinct(), "affected")
    found = reach(edges, source, target, hit.select("id").distinct())
    every = hit.select("cve_id", F.col("id").alias("root")).join(found, "root")
    return every.groupBy("cve_id", "id").agg(F.min(F.struct("depth", "path")).alias("b")).select("cve_id", "id", "b.depth", "b.path")


def dependents_by_level(edges: DataFrame, source: str, target: str) -> DataFrame:
    """root, paths_1..paths_3 (1 is the root itself), dependents_1..dependents_3 (distinct, by reverse hops)."""
    links = edges.select(F.col(source).alias("s"), F.col(target).alias("x")).where("s is not null and x is not null and s <> x").distinct()
    one = links.select(F.col("x").alias("root"), F.col("s").alias("d1"))
    two = one.join(links.select(F.col("x").alias("d1"), F.col("s").alias("d2")), "d1")
    three = two.join(links.select(F.col("x").alias("d2"), F.col("s").alias("d3")), "d2")
    ids = links.select(F.explode(F.array("s", "x")).alias("root")).distinct()
    count = lambda d, c, p, u: d.groupBy("root").agg(F.count(F.lit(1)).alias(p), F.count_distinct(c).alias(u))
    out = ids.join(count(one, "d1", "paths_2", "dependents_1"), "root", "left").join(count(two, "d2", "paths_3", "dependents_2"), "root", "left").join(count(three, "d3", "paths_4", "dependents_3"), "root", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("root", F.lit(1).cast("bigint").alias("paths_1"), zero("paths_2"), zero("paths_3"), zero("dependents_1"), zero("dependents_2"), zero("dependents_3"))


def top_dependents(levels: DataFrame, k: int = 10) -> DataFrame:
    """The k roots with most dependents at two and three hops; ties by id."""
    return levels.select("root", "dependents_1", "dependents_2", "dependents_3").orderBy((F.col("dependents_2") + F.col("dependents_3")).desc(), "root").limit(k)


def _least_reaching(links: DataFrame, source: str, target: str) -> DataFrame:
    """id, m: the least (hash, id) among the nodes from which each node can be reached, itself included.

    A node also takes the label of its label. Hashes stand in no order along the edges, so on long
    paths the number of rounds is expected to grow with the logarithm of the length. Labels go through
    tables, whose size is known: the size estimated for a checkpoint is multiplied in every join.
    """
    own = F.struct(F.xxhash64("id").alias("h"), "id")
    labels = via_table(links.select(F.explode(F.array(source, target)).alias("id")).distinct().withColumn("m", own), "labels")
    while True:
        sent = links.join(labels.withColumnRenamed("id", source), source).select(F.col(target).alias("id"), "m", F.lit(None).cast(labels.schema["m"].dataType).alias("old"))
        least = sent.unionByName(labels.withColumn("old", F.col("m"))).groupBy("id").agg(F.min("m").alias("m"), F.max("old").alias("old"))
        jump = labels.select(F.col("id").alias("via"), F.col("m").alias("further"))
        new = via_table(least.join(jump, F.col("m.id") == F.col("via")).select("id", F.least("m", "further").alias("m"), "old"), "labels")
        labels = new.select("id", "m")
        if new.where("m <> old").isEmpty():
            return labels


def _group_strong(edges: DataFrame, source: str, target: str) -> DataFrame:
    """s, x, part: the distinct edges that can be on a cycle, no strongly connected part in two groups.

    Nodes of one strongly connected part are reached from the same nodes and reach the same ones, so
    edges between different labels, first forwards and then backwards, are on no cycle.
    """
    links = via_table(edges.select(F.col(source).alias("s"), F.col(target).alias("x")).where("s is not null and x is not null and s <> x").distinct(), "links")
    for ways in (("s", "x"), ("x", "s")):
        labels = _least_reaching(links.select("s", "x"), *ways)
        of = lambda end: labels.select(F.col("id").alias(end), F.col("m.id").alias(f"{end}_part"))  # noqa: B023, E731
        links = via_table(links.select("s", "x").join(of("s"), "s").join(of("x"), "x").where("s_part = x_part").select("s", "x", F.col("s_part").alias("part")), "links")
    return links


def _strong_parts(nodes: set, below: dict) -> list[set]:
    """The strongly connected parts of two or more of `nodes` (Tarjan, without recursion)."""
    order: dict = {}
    low: dict = {}
    open_nodes: list = []
    is_open: set = set()
    parts = []
    for root in nodes:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        open_nodes.append(root)
        is_open.add(root)
        stack = [(root, iter(below[root]))]
        while stack:
            v, rest = stack[-1]
            for w in rest:
                if w not in nodes:
                    continue
                if w not in order:
                    order[w] = low[w] = len(order)
                    open_nodes.append(w)
                    is_open.add(w)
                    stack.append((w, iter(below[w])))
                    break
                if w in is_open:
                    low[v] = min(low[v], order[w])
            else:
                stack.pop()
                if stack:
                    low[stack[-1][0]] = min(low[stack[-1][0]], low[v])
                if low[v] == order[v]:
                    part = set()
                    while v not in part:
                        part.add(open_nodes.pop())
                    is_open -= part
                    if len(part) > 1:
                        parts.append(part)
    return parts


def count_cycles(pairs: list[tuple]) -> dict[tuple, int]:
    """How many simple cycles, of any length, each edge is on (Johnson's search; loops on one node are left out).

    A node that led nowhere is blocked until a node after it gets free, so the time between two
    cycles is bounded by the size of the part.
    """
    below: dict = {}
    for s, x in pairs:
        below.setdefault(s, [])
        below.setdefault(x, [])
        if s != x:
            below[s].append(x)
    counts: dict[tuple, int] = {}
    parts = _strong_parts(set(below), below)
    while parts:
        part = parts.pop()
        inside = {v: [w for w in below[v] if w in part] for v in part}
        start = min(part)
        path, blocked, closed, waiting = [start], {start}, set(), {v: set() for v in part}
        stack = [iter(inside[start])]
        while stack:
            for w in stack[-1]:
                if w == start:
                    for edge in zip(path, [*path[1:], start], strict=True):
                        counts[edge] = counts.get(edge, 0) + 1
                    closed.update(path)
                elif w not in blocked:
                    path.append(w)
                    stack.append(iter(inside[w]))
                    closed.discard(w)
                    blocked.add(w)
                    break
            else:
                stack.pop()
                v = path.pop()
                if v in closed:
                    free = [v]
                    while free:
                        u = free.pop()
                        if u in blocked:
                            blocked.remove(u)
                            free.extend(waiting[u])
                            waiting[u].clear()
                else:
                    for w in inside[v]:
                        waiting[w].add(v)
        parts.extend(_strong_parts(part - {start}, inside))
    return counts


def greedy_cut(pairs: list[tuple]) -> list[tuple]:
    """The edges taken out, in order, until no cycle is left: each time one that is on most simple cycles, ties by least."""
    left, taken = set(pairs), []
    while counts := count_cycles(sorted(left)):
        edge = min(counts, key=lambda e: (-counts[e], e))
        left.remove(edge)
        taken.append(edge)
    return taken


def without_cycles(edges: DataFrame, source: str, target: str) -> DataFrame:
    """s, x, removed, turn of every distinct edge: a greedy cut of all cycles.

    Each time the edge on most simple cycles of its strongly connected part is taken out; `turn` is its
    number within the part from 1, null for edges that stay. Parts don't share cycles, so each is cut by
    itself, in a task that holds its edges; loops on one node are taken out with turn 1.
    """
    links = _group_strong(edges, source, target)
    kinds = [links.schema[c].dataType.simpleString() for c in ("s", "x")]

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        taken = greedy_cut(list(zip(pdf["s"], pdf["x"], strict=True)))
        return pd.DataFrame([(*e, i) for i, e in enumerate(taken, 1)], columns=["s", "x", "turn"])

    every = edges.select(F.col(source).alias("s"), F.col(target).alias("x")).where("s is not null and x is not null").distinct()
    taken = links.groupBy("part").applyInPandas(cut, f"s {kinds[0]}, x {kinds[1]}, turn int").unionByName(every.where("s = x").withColumn("turn", F.lit(1)))
    return every.join(taken, ["s", "x"], "left").select("s", "x", F.col("turn").isNotNull().alias("removed"), "turn")


def cycle_edges(edges: DataFrame, source: str, target: str) -> DataFrame:
    """s, x, n_cycles: how many simple cycles, of any length, each edge is on; a loop on one node is a cycle of one edge.

    Strongly connected parts are searched in tasks, each part in one, which holds its edges but no
    cycles; the time grows with the number of cycles, and no bound ends it.
    """
    links = _group_strong(edges, source, target)
    kinds = [links.schema[c].dataType.simpleString() for c in ("s", "x")]

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = count_cycles(list(zip(pdf["s"], pdf["x"], strict=True)))
        return pd.DataFrame([(*e, n) for e, n in counts.items()], columns=["s", "x", "n_cycles"])

    found = links.groupBy("part").applyInPandas(search, f"s {kinds[0]}, x {kinds[1]}, n_cycles bigint")
    loops = edges.select(F.col(source).alias("s"), F.col(target).alias("x")).where("s = x").distinct()
    return found.unionByName(loops.withColumn("n_cycles", F.lit(1).cast("bigint")))
