"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import BROADCAST_ROWS, cut


def connected_components(edges: DataFrame, max_rounds: int = 60, stop_after: int | None = None) -> DataFrame:
    """(id, component): the smallest id reachable from each id that has an edge.

    ``edges`` has columns a and b of one orderable type. Alternates large-star and small-star
    rounds (Kiveris et al., 2014): every round rewires each node to the smallest neighbour
    seen, so that paths shrink exponentially and no round holds more rows than edges. Rows with
    a null end and self loops of isolated nodes add nothing. Each round is one shuffle per star,
    with map-side minima; lineage ends in a written table every round.

    With ``stop_after``, that many rounds are made without looking whether anything changed: ids with
    one component are connected, but not all connected ids may have one yet.
    """
    pairs = (
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
    pairs, before = cut(pairs, "cc"), None
    small = (lambda df: F.broadcast(df)) if pairs.count() <= BROADCAST_ROWS // 2 else (lambda df: df)
    for done in range(1, max_rounds + 1):
        # large star: strictly larger neighbours of u go to the least of u and its neighbours
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(pairs.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(small(least), "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        # small star: u and its smaller neighbours all go to the smallest of them
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        rest = large.join(small(root), "hi").where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        pairs = cut(rest.union(root.select("hi", F.col("m").alias("lo"))).distinct(), "cc")
        if done == stop_after:
            pairs = pairs.groupBy("hi").agg(F.min("lo").alias("lo"))
            break
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return pairs.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(pairs.select("lo", "lo").distinct())
