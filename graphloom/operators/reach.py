"""Traversals: one frontier engine for reach, neighbours, subgraphs, closures, paths and distances.

Each level is one join of the frontier with the adjacency and one anti join with what was seen;
levels are written tables, so neither lineage nor recomputation grows with depth.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import checked_broadcast, cut, dealt


def adjacency(edges: DataFrame, direction: str = "outgoing") -> DataFrame:
    """Distinct (a, b) steps in a direction: outgoing, incoming or both."""
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return {"outgoing": out, "incoming": back, "both": out.union(back)}[direction].distinct()


def reach(edges: DataFrame, seeds: DataFrame, direction: str = "outgoing", max_depth: int | None = None) -> DataFrame:
    """(id, depth): every node within max_depth steps of a seed with its least depth; seeds have 0.

    ``seeds`` has a column id. Without max_depth the closure is followed to its end.
    """
    steps = cut(adjacency(edges, direction), "steps")
    seen = frontier = cut(seeds.select("id", F.lit(0).alias("depth")).distinct(), "level")
    level = 0
    while (max_depth is None or level < max_depth) and not frontier.isEmpty():
        level += 1
        ahead = steps.join(checked_broadcast(frontier.select(F.col("id").alias("a"))), "a").select(F.col("b").alias("id")).distinct()
        frontier = cut(ahead.join(seen.select("id"), "id", "left_anti").select("id", F.lit(level).alias("depth")), "level")
        seen = seen.union(frontier)
    return seen


def neighbours(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "outgoing") -> DataFrame:
    """Reach without the seeds."""
    return reach(edges, seeds, direction, depth).where("depth > 0")


def subgraph(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "outgoing") -> tuple[DataFrame, DataFrame]:
    """(nodes, induced edges) within depth of the seeds."""
    found = cut(reach(edges, seeds, direction, depth), "subgraph")
    inside = edges.join(found.select(F.col("id").alias("src")), "src", "left_semi").join(found.select(F.col("id").alias("dst")), "dst", "left_semi")
    return found, inside


def pair_reach(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(a, b, depth) for every ordered pair of nodes with a path of one step or more: the transitive closure."""
    steps = cut(adjacency(edges), "steps")
    seen = frontier = cut(steps.select("a", "b", F.lit(1).alias("depth")), "pairs")
    level = 1
    while (max_depth is None or level < max_depth) and not frontier.isEmpty():
        level += 1
        onward = frontier.select("a", F.col("b").alias("m")).join(steps.select(F.col("a").alias("m"), "b"), "m").select("a", "b").distinct()
        frontier = cut(onward.join(seen.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", F.lit(level).alias("depth")), "pairs")
        seen = seen.union(frontier)
    return seen


def simple_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_hops: int, min_hops: int = 1) -> DataFrame:
    """(src, dst, hops, path) of all paths without repeated nodes between sources and targets, ends distinct."""
    steps = cut(adjacency(edges), "steps")
    found = None
    paths = sources.select(F.col("id").alias("src"), F.col("id").alias("a"), F.array("id").alias("path")).distinct()
    for hops in range(1, max_hops + 1):
        ahead = paths.join(steps, "a").where(~F.array_contains("path", F.col("b")))
        paths = cut(ahead.select("src", F.col("b").alias("a"), F.array_append("path", F.col("b")).alias("path")), "paths")
        if hops >= min_hops:
            hit = paths.join(targets.select(F.col("id").alias("a")).distinct(), "a", "left_semi").select("src", F.col("a").alias("dst"), F.lit(hops).alias("hops"), "path")
            found = hit if found is None else found.union(hit)
        if paths.isEmpty():
            break
    return found


def shortest_paths(edges: DataFrame, sources: DataFrame, max_hops: int | None = None, mark: str | None = None) -> DataFrame:
    """(src, dst, hops, path): one shortest path per pair, the least by node ids among equally short ones; of any length without max_hops.

    With a ``mark`` that stands in no id, the least is that of the texts which the ids joined by it make.
    """
    least_path = F.min_by("path", F.array_join("path", mark)) if mark else F.min("path")
    steps = cut(adjacency(edges), "steps")
    seen = frontier = cut(sources.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.array("id").alias("path"), F.lit(0).alias("hops")).distinct(), "bfs")
    for hops in count(1):
        if max_hops is not None and hops > max_hops:
            break
        ahead = frontier.join(steps, F.col("dst") == F.col("a")).select("src", F.col("b").alias("dst"), F.array_append("path", F.col("b")).alias("path"))
        least = ahead.groupBy("src", "dst").agg(least_path.alias("path"))
        frontier = cut(least.join(seen.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("hops", F.lit(hops)), "bfs")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def distances(edges: DataFrame, sources: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(src, dst, hops) of every node within max_hops steps of a source, each source on its own, with itself at 0; no paths are carried along."""
    steps = cut(adjacency(edges), "steps")
    seen = frontier = cut(sources.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).alias("hops")).distinct(), "distances")
    hops = 0
    while (max_hops is None or hops < max_hops) and not frontier.isEmpty():
        hops += 1
        ahead = frontier.join(steps, F.col("dst") == F.col("a")).select("src", F.col("b").alias("dst")).distinct()
        frontier = cut(ahead.join(seen.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", F.lit(hops).alias("hops")), "distances")
        seen = seen.union(frontier)
    return seen


def cheapest_paths(edges: DataFrame, sources: DataFrame, rounds: int | None = None) -> DataFrame:
    """(src, dst, cost, path) minimising the sum of 1 - confidence: relaxation until nothing improves, or for so many rounds."""
    cost = edges.groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.min(1 - F.col("confidence")).alias("w"))
    cost = cut(cost, "costs")
    best = cut(sources.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("cost"), F.array("id").alias("path")).distinct(), "relax")
    changed = best
    for done in count():
        if rounds is not None and done >= rounds:
            break
        tried = changed.join(cost, F.col("dst") == F.col("a")).where(~F.array_contains("path", F.col("b"))).select("src", F.col("b").alias("dst"), (F.col("cost") + F.col("w")).alias("cost"), F.array_append("path", F.col("b")).alias("path"))
        tried = tried.groupBy("src", "dst").agg(F.min(F.struct("cost", "path")).alias("x")).select("src", "dst", "x.*")
        old = best.select("src", "dst", F.col("cost").alias("old"))
        changed = cut(tried.join(old, ["src", "dst"], "left").where(F.col("old").isNull() | (F.col("cost") < F.col("old") - 1e-12)).drop("old"), "relax")
        if changed.isEmpty():
            break
        best = cut(best.join(changed.select("src", "dst"), ["src", "dst"], "left_anti").unionByName(changed), "relax")
    return best


def least_costs(edges: DataFrame, sources: DataFrame, rounds: int | None = None) -> DataFrame:
    """(src, dst, cost): the costs of ``cheapest_paths`` without the paths, which are not carried along.

    Needs confidences of 1 at most: a cycle whose costs add up to less than nothing would be walked for ever.
    """
    cost = cut(edges.groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.min(1 - F.col("confidence")).alias("w")), "costs")
    best = changed = cut(sources.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("cost")).distinct(), "relax")
    for done in count():
        if rounds is not None and done >= rounds:
            break
        ahead = changed.join(cost, F.col("dst") == F.col("a")).select("src", F.col("b").alias("dst"), (F.col("cost") + F.col("w")).alias("cost"))
        tried = dealt(ahead, "src", "dst").groupBy("src", "dst").agg(F.min("cost").alias("cost"))
        old = best.select("src", "dst", F.col("cost").alias("old"))
        changed = cut(tried.join(old, ["src", "dst"], "left").where(F.col("old").isNull() | (F.col("cost") < F.col("old") - 1e-12)).drop("old"), "relax")
        if changed.isEmpty():
            break
        best = cut(best.join(changed.select("src", "dst"), ["src", "dst"], "left_anti").unionByName(changed), "relax")
    return best


def explained(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Hops of each path: src, dst, hop, from, to, verb and confidence of the best edge."""
    steps = paths.select("src", "dst", F.posexplode("path").alias("hop", "from"), "path").where(F.col("hop") < F.size("path") - 1).select("src", "dst", "hop", "from", F.get("path", F.col("hop") + 1).alias("to"))
    best = edges.groupBy(F.col("src").alias("from"), F.col("dst").alias("to")).agg(F.max(F.struct("confidence", "dep_type")).alias("x"))
    return steps.join(best, ["from", "to"]).select("src", "dst", "hop", "from", "to", F.col("x.dep_type").alias("verb"), F.col("x.confidence").alias("confidence"))


def topological_order(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``topological_layers`` of an acyclic graph; a graph with a cycle raises ValueError that names a node on or behind it."""
    layers = cut(topological_layers(edges, nodes), "order")
    stuck = nodes.select("id").distinct().join(layers.select("id"), "id", "left_anti").agg(F.min("id")).first()[0]
    if stuck is not None:
        raise ValueError(f"no order: {stuck} is on or behind a cycle")
    return layers


def traversed_edges(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "outgoing") -> DataFrame:
    """The edges that a walk of ``depth`` steps from the seeds goes along, whether or not they lead somewhere new."""
    inner = reach(edges, seeds, direction, depth - 1).select("id") if depth > 0 else seeds.select("id").limit(0)
    ends = {"outgoing": ["src"], "incoming": ["dst"], "both": ["src", "dst"]}[direction]
    found = [edges.join(checked_broadcast(inner.withColumnRenamed("id", end)), end, "left_semi").select(edges.columns) for end in ends]
    return found[0] if len(found) == 1 else found[0].union(found[1]).distinct()


def topological_layers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, layer) by peeling nodes without incoming edges; nodes on or behind a cycle get no row."""
    left = cut(edges.select("src", "dst").distinct(), "peel")
    alive = cut(nodes.select("id").distinct(), "peel")
    out, layer = None, 0
    while True:
        free = cut(alive.join(left.select(F.col("dst").alias("id")), "id", "left_anti").select("id", F.lit(layer).alias("layer")), "layer")
        if free.isEmpty():
            return out if out is not None else free
        out = free if out is None else out.union(free)
        alive = cut(alive.join(free.select("id"), "id", "left_anti"), "peel")
        left = cut(left.join(free.select(F.col("id").alias("src")), "src", "left_anti"), "peel")
        layer += 1
