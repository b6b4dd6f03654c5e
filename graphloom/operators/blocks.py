"""Blocks of an undirected graph: bridges, cut vertices and biconnected components with state linear in its edges.

A BFS forest is built level by level. An edge outside it joins nodes of one level or of two next to each other; the
two ends climb the forest together, a level at a time, until they meet, and pairs that come to the same place go on as one.
The tree edges that they pass lie on a cycle, those of one climb in one block; a tree edge that none passes is a bridge.
No edge is removed to see what falls apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.components import connected_components
from graphloom.operators.ordered import running_sum
from graphloom.session import cut


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct (a, b) with a < b; loops and rows with a null end drop out."""
    return edges.where("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def _levels(pairs: DataFrame) -> list[DataFrame]:
    """(id, parent, depth) of each level of ``forest``."""
    both = cut(pairs.select("a", "b").union(pairs.select("b", "a")), "both")
    roots = connected_components(pairs).select(F.col("component").alias("id")).distinct()
    none = F.lit(None).cast(pairs.schema["a"].dataType)
    levels = [cut(roots.select("id", none.alias("parent"), F.lit(0).alias("depth")), "level")]
    while True:
        # a neighbour of a level is in that level, the one before or the next
        near = _union(levels[-2:]).select("id")
        ahead = both.join(levels[-1].select(F.col("id").alias("a")), "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("parent"))
        frontier = cut(ahead.join(near, "id", "left_anti").select("id", "parent", F.lit(len(levels)).alias("depth")), "level")
        if frontier.isEmpty():
            return levels
        levels.append(frontier)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def forest(pairs: DataFrame) -> DataFrame:
    """(id, parent, depth): a BFS tree of each component of (a, b), from its least id; a root's parent is null."""
    return cut(_union(_levels(pairs)), "forest")


def numbered(tree: DataFrame) -> DataFrame:
    """(id, parent, depth, size, pre): nodes of each subtree, and preorder numbers over the whole forest."""
    deepest = tree.agg(F.max("depth")).first()[0]
    if deepest is None:
        return tree.select("id", "parent", "depth", F.lit(1).cast("long").alias("size"), F.lit(0).cast("long").alias("pre"))
    sized = cut(tree.where(F.col("depth") == deepest).select("id", "parent", "depth", F.lit(1).cast("long").alias("size")), "sized")
    all_sized = [sized]
    for d in range(deepest - 1, -1, -1):
        below = sized.groupBy(F.col("parent").alias("id")).agg(F.sum("size").alias("below"))
        sized = cut(tree.where(F.col("depth") == d).join(below, "id", "left").select("id", "parent", "depth", (1 + F.coalesce("below", F.lit(0))).cast("long").alias("size")), "sized")
        all_sized.append(sized)
    # of siblings, those of lesser id come first; roots are siblings
    every = all_sized[0]
    for level in all_sized[1:]:
        every = every.union(level)
    offset = cut(running_sum(every, ["parent"], [F.col("id").asc()], F.col("size"), "offset"), "offset")
    level = cut(offset.where("depth = 0").select("id", "parent", "depth", "size", F.col("offset").alias("pre")), "pre")
    levels = [level]
    for d in range(1, deepest + 1):
        above = level.select(F.col("id").alias("parent"), F.col("pre").alias("above"))
        level = cut(offset.where(F.col("depth") == d).join(above, "parent").select("id", "parent", "depth", "size", (F.col("above") + 1 + F.col("offset")).alias("pre")), "pre")
        levels.append(level)
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return cut(out, "numbered")


def _climbed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ends, steps): the edges beside a forest of numbered nodes, and the climbs of those outside it.

    ends: a, b, the edge's lower end, the parent ``above`` of that, its depth, the other end, whether the edge is the forest's, and
    whether both ends are at one depth. steps: x and y, two nodes of one depth, with their parents up_x and up_y.
    """
    pairs = cut(undirected(edges), "pairs")
    # numbers are aggregated in hash tables, names would have to be sorted
    codes = cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().withColumn("n", F.monotonically_increasing_id()), "codes")
    named = pairs.join(codes.select(F.col("id").alias("a"), F.col("n").alias("p")), "a").join(codes.select(F.col("id").alias("b"), F.col("n").alias("q")), "b")
    named = cut(named, "named")
    levels = _levels(named.select(F.col("p").alias("a"), F.col("q").alias("b")))
    tree = _union(levels)
    at = lambda c: tree.select(F.col("id").alias(c), F.col("parent").alias(f"up_{c}"), F.col("depth").alias(f"depth_{c}"))
    placed = named.join(at("p"), "p").join(at("q"), "q")
    second = F.col("depth_q") > F.col("depth_p")
    lower = lambda x, y: F.when(second, F.col(y)).otherwise(F.col(x))
    ends = placed.select("a", "b", lower("p", "q").alias("lower"), lower("up_p", "up_q").alias("above"), lower("depth_p", "depth_q").alias("depth"), lower("q", "p").alias("other"), (F.col("depth_p") == F.col("depth_q")).alias("level"))
    ends = cut(ends.withColumn("in_tree", ~F.col("level") & (F.col("above") == F.col("other"))), "ends")

    foot = F.when(F.col("level"), F.col("lower")).otherwise(F.col("above"))
    start = ends.where("NOT in_tree").select((F.col("depth") - F.when(F.col("level"), 0).otherwise(1)).alias("depth"), F.least(foot, "other").alias("x"), F.greatest(foot, "other").alias("y"))
    start = cut(start.distinct(), "start")
    steps = [start.where("false").select("x", "y", F.col("x").alias("up_x"), F.col("y").alias("up_y"))]
    for d in range(len(levels) - 1, 0, -1):
        onward = steps[-1].where("up_x != up_y").select(F.least("up_x", "up_y").alias("x"), F.greatest("up_x", "up_y").alias("y"))
        met = start.where(F.col("depth") == d).select("x", "y").union(onward).distinct()
        up = lambda c: levels[d].select(F.col("id").alias(c), F.col("parent").alias(f"up_{c}"))  # noqa: E731, B023
        steps.append(cut(met.join(up("x"), "x").join(up("y"), "y").select("x", "y", "up_x", "up_y"), "step"))
    return ends, _union(steps)


def blocks(edges: DataFrame) -> DataFrame:
    """(a, b, block) of every undirected edge; a block is named by the number of a node, the lower end of one of its tree edges.

    Loops are left out, parallel edges count once.
    """
    ends, steps = _climbed(edges)
    # a tree edge is named by its lower end
    further = steps.where("up_x != up_y")
    links = ends.where("NOT in_tree AND NOT level").select(F.col("lower").alias("a"), F.col("above").alias("b"))
    links = links.union(further.select("x", "up_x")).union(further.select("y", "up_y")).union(steps.where("up_x = up_y").select("x", "y"))
    found = connected_components(links).withColumnRenamed("id", "lower")
    return ends.join(found, "lower", "left").select("a", "b", F.coalesce("component", "lower").alias("block"))


def bridges(edges: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(a, b) of undirected edges whose removal splits their component: the tree edges that no edge outside the forest climbs over.

    ``found`` takes the result of ``blocks`` where it is there already; then they are the edges that are a block of their own.
    """
    if found is None:
        ends, steps = _climbed(edges)
        over = ends.where("NOT in_tree AND NOT level").select("lower").union(steps.select("x")).union(steps.select("y"))
        return ends.where("in_tree").join(over, "lower", "left_anti").select("a", "b")
    alone = found.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.first("a").alias("a"), F.first("b").alias("b"))
    return alone.where("n = 1").select("a", "b")


def articulation_points(nodes: DataFrame, edges: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(id, components): cut vertices, which lie in several blocks, with the number of components of the whole graph once each is removed.

    A node without edges is a component of its own and never a cut vertex. ``found`` takes the blocks of the edges
    between the nodes where they are there already.
    """
    ids = nodes.select("id").distinct()
    if found is None:
        between = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        found = cut(blocks(between), "blocks")
    at = found.select(F.col("a").alias("id"), "block").union(found.select("b", "block")).distinct()
    # a component's nodes less one are those of its blocks, each less one
    parts = at.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("block").alias("blocks")).first()
    base = ids.count() - parts["n"] + parts["blocks"]
    return at.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", (F.col("n") - 1 + base).alias("components"))
