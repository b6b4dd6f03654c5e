"""Graph algorithms as Spark jobs: ranks, communities, components, cores, cohesion measures.

Loops run on the driver, their state is written every round, and every step is joins and sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.model import module_of
from graphloom.operators.components import connected_components
from graphloom.operators.ordered import order_statistics
from graphloom.session import cut


def pagerank(nodes: DataFrame, edges: DataFrame, *, alpha: float = 0.85, iterations: int = 20, tolerance: float | None = None, personal: DataFrame | None = None) -> DataFrame:
    """(id, rank). Dangling mass is spread by the teleport vector; parallel edges count.

    ``personal`` (id, weight) personalises the teleport vector after normalising; without it, or
    if its weights add up to 0, the vector is uniform. With ``tolerance`` the loop ends when no
    rank moves further than that. Per round: one join of the edges with the ranks and one sum by
    target, on the same keys every time.
    """
    ids = nodes.select("id").distinct()
    n = ids.count()
    if not n:
        return ids.select("id", F.lit(0.0).alias("rank"))
    start = ids.withColumn("t", F.lit(1.0 / n))
    if personal is not None and (total := personal.join(ids, "id", "left_semi").agg(F.sum("weight")).first()[0]):
        weight = personal.groupBy("id").agg(F.sum("weight").alias("weight"))
        start = ids.join(weight, "id", "left").select("id", (F.coalesce("weight", F.lit(0.0)) / total).alias("t"))
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    steps = cut(edges.select("src", "dst").join(out, "src"), "steps")
    fixed = cut(start.join(out.select(F.col("src").alias("id"), "out"), "id", "left"), "fixed")
    ranks = fixed.select("id", "t", "out", F.lit(1.0 / n).alias("rank"))
    for _ in range(iterations):
        ranks = cut(ranks, "ranks")
        dangling = ranks.where("out IS NULL").agg(F.sum("rank")).first()[0] or 0.0
        given = steps.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        new = ranks.join(given, "id", "left").select(
            "id", "t", "out", ((1 - alpha) * F.col("t") + alpha * (F.coalesce("got", F.lit(0.0)) + dangling * F.col("t"))).alias("rank"), F.col("rank").alias("old")
        )
        if tolerance is not None:
            new = cut(new, "ranks")
            if new.agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0] < tolerance:
                ranks = new.drop("old")
                break
        ranks = new.drop("old")
    return ranks.select("id", "rank")


def label_propagation(nodes: DataFrame, edges: DataFrame, iterations: int = 10) -> DataFrame:
    """(id, label): synchronous, undirected with multiplicity; ties go to the least label; isolated nodes keep their own."""
    both = cut(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")), "both")
    labels = nodes.select("id", F.col("id").alias("label")).distinct()
    for _ in range(iterations):
        labels = cut(labels, "labels")
        votes = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a", "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("a").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("x")).select(F.col("a").alias("id"), F.col("x.label").alias("new"))
        new = labels.join(best, "id", "left").select("id", F.coalesce("new", "label").alias("label"), "label")
        new = cut(new.toDF("id", "label", "old"), "labels")
        moved = not new.where("label != old").isEmpty()
        labels = new.drop("old")
        if not moved:
            break
    return labels


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): least id of the undirected component."""
    found = connected_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): least id of the strongly connected component.

    Nodes without an incoming or outgoing edge are peeled off as components of their own; of the
    rest, colours (least id that reaches a node) are propagated to their end, and the nodes that
    reach their colour back inside it make its component. Repeats until no node is left.
    """
    ids = nodes.select("id").distinct()
    left = cut(edges.where("src != dst").select("src", "dst").distinct(), "scc")
    done = None
    while not left.isEmpty():
        live = cut(left.select(F.col("src").alias("id")).intersect(left.select(F.col("dst").alias("id"))), "live")
        size = left.count()
        left = cut(left.join(live.select(F.col("id").alias("src")), "src", "left_semi").join(live.select(F.col("id").alias("dst")), "dst", "left_semi"), "scc")
        if left.isEmpty():
            break
        if left.count() < size:
            continue
        colour = cut(live.select("id", F.col("id").alias("c")), "colour")
        while True:
            sent = left.join(colour.select(F.col("id").alias("src"), "c"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("got"))
            new = cut(colour.join(sent, "id", "left").select("id", F.least("c", F.coalesce("got", "c")).alias("c"), F.col("c").alias("old")), "colour")
            moved = not new.where("c != old").isEmpty()
            colour = new.select("id", "c")
            if not moved:
                break
        inside = left.join(colour.select(F.col("id").alias("src"), "c"), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("d")), "dst").where("c = d").select("src", "dst", "c")
        inside = cut(inside, "inside")
        found = frontier = cut(colour.where("id = c").select("id", "c"), "back")
        while not frontier.isEmpty():
            back = inside.join(frontier.select(F.col("id").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("id"), "c").distinct()
            frontier = cut(back.join(found, ["id", "c"], "left_anti"), "back")
            found = found.union(frontier)
        found = cut(found, "found")
        done = found if done is None else done.union(found)
        gone = found.select("id")
        left = cut(left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"), "scc")
    if done is None:
        return ids.select("id", F.col("id").alias("component"))
    return ids.join(done, "id", "left").select("id", F.coalesce("c", "id").alias("component"))


def in_cycles(components: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct ids of nodes on a cycle: in a strong component of several nodes, or with an edge to themselves."""
    several = components.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    own = edges.where(F.col("src") == F.col("dst")).select(F.col("src").alias("id"))
    return components.join(several, "component", "left_semi").select("id").union(own).distinct()


def cycles(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, size) of the components that hold a cycle: more than one node, or a self loop."""
    loops = edges.where("src = dst").select(F.col("src").alias("id")).distinct().withColumn("loop", F.lit(1))
    sizes = components.join(loops, "id", "left").groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.max("loop").alias("loop"))
    return sizes.where("size > 1 OR loop = 1").select("component", "size")


def k_core(edges: DataFrame, k: int) -> DataFrame:
    """Ids of the k-core of the undirected simple graph: nodes of lesser degree are dropped until none is left."""
    pairs = edges.where("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    both = cut(pairs.union(pairs.select("b", "a")), "core")
    while True:
        low = cut(both.groupBy("a").count().where(F.col("count") < k).select("a"), "low")
        if low.isEmpty():
            return both.select(F.col("a").alias("id")).distinct()
        both = cut(both.join(low, "a", "left_anti").join(low.withColumnRenamed("a", "b"), "b", "left_anti").select("a", "b"), "core")


def core_numbers(edges: DataFrame) -> DataFrame:
    """(id, core): the greatest k whose k-core holds the node, for every node with an edge, in one run.

    Estimates begin with the degree; each round a node takes the greatest h of which at least h neighbours have
    an estimate of h or more, until nothing moves. Estimates of neighbours are counted per value, so
    that a node of any degree stays a set of (value, times) rows.
    """
    pairs = edges.where("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    both = cut(pairs.union(pairs.select("b", "a")), "core")
    core = cut(both.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("core")), "core")
    down = Window.partitionBy("a").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, 0)
    while True:
        # estimates above a node's own count as its own: its estimate never grows
        seen = both.join(core.select(F.col("id").alias("b"), F.col("core").alias("v")), "b").join(core.select(F.col("id").alias("a"), "core"), "a")
        counts = seen.groupBy("a", F.least("v", "core").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        h = counts.withColumn("up", F.sum("n").over(down)).groupBy(F.col("a").alias("id")).agg(F.max(F.least("v", "up")).alias("new"))
        new = cut(core.join(h, "id").select("id", F.col("new").alias("core"), F.col("core").alias("old")), "core")
        core = new.select("id", "core")
        if new.where("core != old").isEmpty():
            return core


def god_nodes(scores: DataFrame, percentile: float, by: str | None = None) -> DataFrame:
    """Nodes whose score reaches the one at index floor(n * percentile), over all or inside each group."""
    group = [by] if by else []
    limit = order_statistics(scores, group, "score", {"limit": (percentile, 0)}).drop("n")
    both = scores.join(limit, by) if by else scores.join(F.broadcast(limit))  # one row
    return both.where("score >= limit").drop("limit")


def surprising_connections(edges: DataFrame, communities: DataFrame, scores: DataFrame, limit: int) -> DataFrame:
    """Edges between communities by the product of their ends' scores, the highest first."""
    both = communities.join(scores, "id")
    a, b = both.toDF("src", "ca", "sa"), both.toDF("dst", "cb", "sb")
    crossing = edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").where("ca != cb")
    return crossing.select("src", "dst", (F.col("sa") * F.col("sb")).alias("score")).orderBy(F.desc("score"), "src", "dst").limit(limit)


def community_edges(edges: DataFrame, communities: DataFrame) -> DataFrame:
    a, b = communities.toDF("src", "ca"), communities.toDF("dst", "cb")
    return edges.select("src", "dst").join(a, "src").join(b, "dst")


def cohesion(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(community, cohesion): share of a community's outgoing edges that stay inside; 0 without edges."""
    inside = community_edges(edges, communities).groupBy(F.col("ca").alias("community")).agg(F.avg((F.col("ca") == F.col("cb")).cast("double")).alias("cohesion"))
    every = communities.select(F.col(communities.columns[1]).alias("community")).distinct()
    return every.join(inside, "community", "left").select("community", F.coalesce("cohesion", F.lit(0.0)).alias("cohesion"))


def community_labels(nodes: DataFrame, communities: DataFrame) -> DataFrame:
    """(community, label): the commonest folder of the files of a community's nodes, of several the greatest; null without files.

    ``nodes`` are (id, file), ``communities`` (id, community). Folders are counted per community before they are compared.
    """
    name = communities.columns[1]
    counted = communities.join(nodes.select("id", module_of(F.col("file")).alias("folder")), "id", "left").groupBy(F.col(name).alias("community"), "folder").agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.when(F.col("folder").isNotNull(), F.struct("n", "folder")))
    return counted.groupBy("community").agg(best.alias("x")).select("community", F.col("x.folder").alias("label"))


def conductance(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(community, conductance): edges leaving over the lesser of the volumes inside and outside, by out-degree."""
    both = cut(community_edges(edges, communities), "conductance")
    total = both.count()
    per = both.groupBy(F.col("ca").alias("community")).agg(F.count(F.lit(1)).alias("volume"), F.count_if(F.col("ca") != F.col("cb")).alias("cut"))
    least = F.least(F.col("volume"), F.lit(total) - F.col("volume"))
    return per.select("community", F.when(least > 0, F.col("cut") / least).otherwise(F.lit(0.0)).alias("conductance"))


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row (modularity, communities): directed textbook Q, sum over communities of inside/m - out * in / m^2."""
    both = cut(community_edges(edges, communities), "modularity")
    m = both.count()
    if not m:
        return communities.select(F.lit(0.0).alias("modularity"), F.lit(0).cast("long").alias("communities")).limit(1)
    out = both.groupBy(F.col("ca").alias("c")).agg(F.count(F.lit(1)).alias("o"), F.count_if(F.col("ca") == F.col("cb")).alias("i"))
    into = both.groupBy(F.col("cb").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    q = F.coalesce("i", F.lit(0)) / m - F.coalesce("o", F.lit(0)) * F.coalesce("n", F.lit(0)) / (m * m)
    return out.join(into, "c", "full").agg(F.sum(q).alias("modularity"), F.count(F.lit(1)).alias("communities"))


def dominators(edges: DataFrame, root: str) -> DataFrame:
    """(id, dominator, depth) of every node reachable from the root: immediate dominators.

    Pointers begin as a BFS tree and are refined until none moves: a node's new pointer is the lowest common ancestor, over
    the pointers, of its predecessors. Ancestors are met by climbing: of a node's candidates those of the greatest BFS level
    take their own pointer's end, until one is left. The state is a pointer per node and at most a candidate per edge.
    After the first round only nodes with a predecessor on or below a moved pointer are met again.
    """
    steps = cut(edges.where((F.col("src") != F.col("dst")) & (F.col("dst") != root)).select("src", "dst").distinct(), "steps")
    frontier = cut(edges.sparkSession.createDataFrame([(root, None, 0)], "id string, x string, level int"), "tree")
    tree, level = frontier, 0
    while True:
        level += 1
        ahead = steps.join(frontier.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("x"))
        frontier = cut(ahead.join(tree.select("id"), "id", "left_anti").select("id", "x", F.lit(level).alias("level")), "tree")
        if frontier.isEmpty():
            break
        tree = tree.union(frontier)
    pointers = tree = cut(tree, "tree")
    before = cut(steps.join(tree.select(F.col("id").alias("src"), F.col("level").alias("lx")), "src").select(F.col("dst").alias("id"), F.col("src").alias("x"), "lx"), "before")
    active = before
    while True:
        up = pointers.select(F.col("id").alias("x"), F.col("x").alias("above")).join(tree.select(F.col("id").alias("above"), F.col("level").alias("la")), "above")
        up, settled, open_ = cut(up, "up"), None, active
        while True:
            sized = open_.groupBy("id").agg(F.max("lx").alias("most"), F.count(F.lit(1)).alias("n"), F.min("x").alias("only"))
            sized = cut(sized, "sized")
            one = sized.where("n = 1").select("id", F.col("only").alias("new"))
            settled = one if settled is None else settled.union(one)
            many = sized.where("n > 1").select("id", "most")
            if many.isEmpty():
                break
            going = open_.join(many, "id").join(up, "x", "left")
            climbs = F.col("lx") == F.col("most")
            open_ = cut(going.select("id", F.when(climbs, F.col("above")).otherwise(F.col("x")).alias("x"), F.when(climbs, F.col("la")).otherwise(F.col("lx")).alias("lx")).distinct(), "climb")
        new = cut(pointers.join(settled, "id", "left").select("id", F.coalesce("new", "x").alias("x"), F.col("x").alias("old"), "level"), "pointers")
        pointers = new.select("id", "x", "level")
        below = moved = cut(new.where("x != old").select("id"), "moved")
        while not moved.isEmpty():
            under = pointers.join(moved.select(F.col("id").alias("x")), "x", "left_semi").select("id")
            moved = cut(under.join(below, "id", "left_anti"), "moved")
            below = below.union(moved)
        touched = before.join(below.select(F.col("id").alias("x")), "x", "left_semi").select("id").distinct()
        active = cut(before.join(touched, "id", "left_semi"), "before")
        if active.isEmpty():
            break
    at = cut(pointers.where("x IS NULL").select("id", F.col("x").alias("dominator"), F.lit(0).cast("long").alias("depth")), "depth")
    out, depth = at, 0
    while True:
        depth += 1
        at = cut(pointers.join(at.select(F.col("id").alias("x")), "x").select("id", F.col("x").alias("dominator"), F.lit(depth).cast("long").alias("depth")), "depth")
        if at.isEmpty():
            return out
        out = out.union(at)
