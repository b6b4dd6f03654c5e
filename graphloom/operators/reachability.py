"""Whether one node reaches another, and transitive reduction, without a table of all pairs.

Every strong component gets labels: its layers from both ends, and the least of RANDOM hashes over
all that it reaches and over all that reaches it. A node that reaches another has the greater set, so none of its
minima is greater: most pairs that do not reach each other are told by labels alone. What labels leave open
is searched exactly, by a frontier that keeps to nodes whose labels lie between both ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.analytics import strong_components
from graphloom.session import checked_broadcast, cut

RANDOM = 6
#: Ancestors that ``transitive_reduction`` lists of a node at most; nodes with more are searched.
LISTED = 32


def _swept(steps: DataFrame, nodes: DataFrame, what: str) -> DataFrame:
    """(id, layer, minima): over all that ``steps`` (a, b) of an acyclic graph lead to from each node; nodes without steps have layer 0.

    A round hands on what moved in the one before, one step back; there are as many as the longest path has steps.
    """
    own = F.transform(F.sequence(F.lit(1), F.lit(RANDOM)), lambda i: F.xxhash64(i, F.col("id")))
    state = cut(nodes.select("id", F.lit(0).alias("layer"), own.alias("minima"), F.lit(True).alias("moved")), what)
    while True:
        sent = steps.join(state.where("moved").select(F.col("id").alias("b"), F.col("layer").alias("l"), F.col("minima").alias("m")), "b").groupBy(F.col("a").alias("id"))
        sent = sent.agg((F.max("l") + 1).alias("l"), F.array(*[F.min(F.get("m", F.lit(i))) for i in range(RANDOM)]).alias("m"))
        less = F.exists(F.zip_with("minima", "m", lambda x, y: y < x), lambda ok: ok)
        moved = F.coalesce((F.col("l") > F.col("layer")) | less, F.lit(False))
        minima = F.when(F.col("m").isNull(), F.col("minima")).otherwise(F.zip_with("minima", "m", lambda x, y: F.least(x, y)))
        state = cut(state.drop("moved").join(sent, "id", "left").select("id", F.greatest("layer", "l").alias("layer"), minima.alias("minima"), moved.alias("moved")), what)
        if state.where("moved").isEmpty():
            return state.drop("moved")


class Reach:
    """Labels of a graph's strong components: ``components`` (id, c, cycle), ``steps`` (a, b) between them, ``labels`` (c, ...).

    The components' graph is acyclic; labelling takes a round for each of its layers, with rows linear in edges. Where
    ``acyclic`` says that the edges have no cycle, each node is taken for its own component.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, acyclic: bool = False) -> None:
        ids = nodes.select("id").distinct()
        found = ids.select("id", F.col("id").alias("c")) if acyclic else strong_components(ids, edges).select("id", F.col("component").alias("c"))
        found = cut(found, "components")
        loops = edges.where("src = dst").select(F.col("src").alias("id")).distinct().withColumn("loop", F.lit(True))
        sizes = found.groupBy("c").agg((F.count(F.lit(1)) > 1).alias("several"))
        self.components = cut(found.join(loops, "id", "left").join(sizes, "c").select("id", "c", (F.col("several") | F.coalesce("loop", F.lit(False))).alias("cycle")), "components")
        a, b = (found.toDF(end, name) for end, name in (("src", "a"), ("dst", "b")))
        self.steps = cut(edges.select("src", "dst").join(a, "src").join(b, "dst").where("a != b").select("a", "b").distinct(), "steps")
        every = found.select(F.col("c").alias("id")).distinct()
        down = _swept(self.steps, every, "down").toDF("c", "height", "below")
        up = _swept(self.steps.select(F.col("b").alias("a"), F.col("a").alias("b")), every, "up").toDF("c", "depth", "above")
        out = self.steps.groupBy(F.col("a").alias("c")).agg(F.count(F.lit(1)).alias("out"))
        into = self.steps.groupBy(F.col("b").alias("c")).agg(F.count(F.lit(1)).alias("into"))
        self.labels = cut(down.join(up, "c").join(out, "c", "left").join(into, "c", "left").fillna(0, ["out", "into"]), "labels")

    @staticmethod
    def may(a: str, b: str) -> Column:
        """Whether the labels allow the component labelled ``a.*`` to reach the other one labelled ``b.*``."""
        within = lambda low, high: F.forall(F.zip_with(low, high, lambda x, y: x <= y), lambda ok: ok)
        layers = (F.col(f"{a}.height") > F.col(f"{b}.height")) & (F.col(f"{a}.depth") < F.col(f"{b}.depth"))
        return layers & within(f"{a}.below", f"{b}.below") & within(f"{b}.above", f"{a}.above")

    def _labelled(self, pairs: DataFrame, *ends: str) -> DataFrame:
        for end in ends:
            pairs = pairs.join(self.labels.select(F.col("c").alias(end), F.struct("height", "depth", "below", "above", "out", "into").alias(f"l{end}")), end)
        return pairs

    def _open(self, states: DataFrame) -> DataFrame:
        """The states (x, y, p, q) that labels leave open, and whether p has no more steps ahead than q has behind it."""
        return self._labelled(states, "p", "q").where(self.may("lp", "lq")).select("x", "y", "p", "q", (F.col("lp.out") <= F.col("lq.into")).alias("forward"))

    def _searched(self, pairs: DataFrame) -> DataFrame:
        """Of distinct component pairs (x, y), those where x reaches y in one step or more.

        A state (x, y, p, q) asks whether p, which x reaches, reaches q, which reaches y. It goes on at the end with fewer steps,
        so a node of very many steps on one side is not followed into each of them for a pair whose other end has few.
        """
        frontier = seen = cut(self._open(pairs.select("x", "y", F.col("x").alias("p"), F.col("y").alias("q"))), "frontier")
        found = None
        while not frontier.isEmpty():
            on = frontier.where("forward").join(self.steps.toDF("p", "n"), "p").select("x", "y", F.col("n").alias("p"), "q")
            back = frontier.where("NOT forward").join(self.steps.toDF("n", "q"), "q").select("x", "y", "p", F.col("n").alias("q"))
            ahead = cut(on.union(back).distinct(), "ahead")
            hit = cut(ahead.where("p = q").select("x", "y").distinct(), "hit")
            found = hit if found is None else found.union(hit)
            going = ahead.join(hit, ["x", "y"], "left_anti").join(seen, ["x", "y", "p", "q"], "left_anti")
            frontier = cut(self._open(going), "frontier")
            seen = seen.union(frontier)
        return found.distinct() if found is not None else pairs.limit(0)

    def reaches(self, pairs: DataFrame) -> DataFrame:
        """(a, b, reaches) of distinct pairs of ids: whether one step or more lead from a to b. Unknown ids reach nothing."""
        asked = cut(pairs.select("a", "b").distinct(), "asked")
        end = lambda name, c: self.components.select(F.col("id").alias(name), F.col("c").alias(c), F.col("cycle").alias(f"cycle_{name}"))
        placed = cut(asked.join(end("a", "x"), "a", "left").join(end("b", "y"), "b", "left"), "placed")
        found = self._searched(placed.where("x != y").select("x", "y").distinct()).withColumn("found", F.lit(True))
        same = (F.col("x") == F.col("y")) & F.col("cycle_a")
        return placed.join(found, ["x", "y"], "left").select("a", "b", (F.coalesce(same, F.lit(False)) | F.coalesce("found", F.lit(False))).alias("reaches"))

    def redundant(self, among: DataFrame) -> DataFrame:
        """Of the steps (a, b) given, those that a longer path between components replaces.

        Only a step over two layers or more, from both ends, can be one. For each of those the lesser of two sets is looked at,
        what follows a or what precedes b, as far as it lies in layers between both: at most of the order of m * sqrt(m)
        candidates for m steps. Pairs of components that several candidates ask for are searched once.
        """
        end = lambda name: self.labels.select(F.col("c").alias(name), F.col("height").alias(f"h{name}"), F.col("depth").alias(f"d{name}"))
        layered = cut(self.steps.join(end("a"), "a").join(end("b"), "b"), "layered")
        degree = lambda name, what: self.labels.select(F.col("c").alias(name), what)
        steep = layered.where("ha - hb > 1 AND db - da > 1").join(among, ["a", "b"], "left_semi")
        asked = cut(steep.join(degree("a", "out"), "a").join(degree("b", "into"), "b"), "asked")
        after = layered.select("a", F.col("b").alias("x"), F.col("hb").alias("h"), F.col("db").alias("d"))
        before = layered.select("b", F.col("a").alias("y"), F.col("ha").alias("h"), F.col("da").alias("d"))
        ahead = asked.where("out <= into").join(after, "a").where("h > hb AND d < db").select("a", "b", "x", F.col("b").alias("y"))
        behind = asked.where("out > into").join(before, "b").where("h < ha AND d > da").select("a", "b", F.col("a").alias("x"), "y")
        tried = cut(ahead.union(behind), "tried")
        pairs = cut(tried.select("x", "y").distinct(), "pairs")
        direct = cut(pairs.join(self.steps.toDF("x", "y"), ["x", "y"], "left_semi"), "direct")
        known = cut(tried.join(direct, ["x", "y"], "left_semi").select("a", "b").distinct(), "known")  # two steps do it
        rest = cut(tried.join(known, ["a", "b"], "left_anti"), "rest")
        longer = rest.join(self._searched(rest.select("x", "y").distinct()), ["x", "y"], "left_semi").select("a", "b")
        return known.union(longer).distinct()


def _ancestors(steps: DataFrame) -> DataFrame | None:
    """(id, above) of an acyclic graph: a row for each ancestor of a node, or one null if they are more than LISTED; None if there is a cycle.

    Nodes that no step leads to any more hand on what is above them, a layer in each round; a step is used once, for LISTED + 1
    rows at most.
    """
    left, given, before = steps, None, None
    while not left.isEmpty():
        free = cut(left.select(F.col("src").alias("id")).distinct().join(left.select(F.col("dst").alias("id")), "id", "left_anti"), "frontier")
        if free.isEmpty():
            return None
        going = left.join(free, F.col("src") == F.col("id"), "left_semi")
        new = going.select(F.col("dst").alias("id"), F.col("src").alias("above"))
        if given is not None:
            far = _limited(given.join(free, "id", "left_semi"))
            new = new.union(going.join(far, F.col("src") == F.col("id")).select(F.col("dst").alias("id"), "above"))
        new = cut(new.distinct(), "above")
        given = new if given is None else given.union(new)
        left = cut(left.join(free, F.col("src") == F.col("id"), "left_anti"), "left")
    return None if given is None else cut(_limited(given), "ancestors")


def _limited(given: DataFrame) -> DataFrame:
    """The distinct rows (id, above), or one with a null for an id that has a null or more than LISTED of them."""
    rows = given.distinct()
    many = rows.groupBy("id").agg((F.count(F.lit(1)) > LISTED).alias("many"), F.bool_or(F.col("above").isNull()).alias("open")).where("many OR open").select("id")
    return rows.join(many, "id", "left_anti").union(many.select("id", F.lit(None).cast(rows.schema["above"].dataType).alias("above")))


def transitive_reduction(edges: DataFrame) -> DataFrame:
    """Edges of a DAG that no longer path implies; a graph with a cycle comes back as it is, without repeated edges.

    All nodes of a path but its last have steps ahead, so cycles and ancestors are those of the ``inner`` edges, between nodes with
    steps ahead; only an edge from a node with an inner one can be implied. An edge (a, b) is, if a is an ancestor of a node
    y with a step to b: for nodes y of at most LISTED ancestors that is a row for each of them. What nodes of more leave open is searched.
    """
    plain = cut(edges.select("src", "dst").distinct(), "plain")
    starts = cut(plain.select(F.col("src").alias("dst")).distinct(), "starts")
    inner = cut(plain.where("src IS NOT NULL").join(checked_broadcast(starts), "dst", "left_semi").select("src", "dst"), "inner")
    if inner.isEmpty():
        return plain
    above = _ancestors(inner)
    if above is None:
        return plain
    high = checked_broadcast(cut(inner.select("src").distinct(), "high"))
    asked = plain.join(high, "src", "left_semi").select("src", "dst")
    listed = above.where("above IS NOT NULL").groupBy("id").agg(F.collect_set("above").alias("above"))
    ways = plain.join(checked_broadcast(cut(listed, "listed")), F.col("src") == F.col("id")).select(F.explode("above").alias("src"), "dst")
    gone = cut(asked.join(ways, ["src", "dst"], "left_semi"), "gone")
    unlisted = cut(above.where("above IS NULL").select(F.col("id").alias("src")), "unlisted")
    if not unlisted.isEmpty():
        ends = plain.join(checked_broadcast(unlisted), "src", "left_semi").select("dst").distinct()
        rest = cut(asked.join(gone, ["src", "dst"], "left_anti").join(ends, "dst", "left_semi").select(F.col("src").alias("a"), F.col("dst").alias("b")), "rest")
        if not rest.isEmpty():
            # a path of several steps is inner edges and one more into its end
            last = plain.join(rest.select(F.col("b").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
            paths = cut(inner.union(last).distinct(), "paths")
            nodes = paths.select(F.col("src").alias("id")).union(paths.select("dst"))
            gone = gone.union(Reach(nodes, paths, acyclic=True).redundant(rest).toDF("src", "dst"))
    kept = asked.join(gone, ["src", "dst"], "left_anti")
    return plain.join(high, "src", "left_anti").select("src", "dst").union(kept)
