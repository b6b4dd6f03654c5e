"""Questions to a graph: filtered walks from keywords, answers cut at a budget, and pages behind a cursor."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.ordered import within_budget
from graphloom.operators.reach import adjacency
from graphloom.session import checked_broadcast, cut


def filtered_graph(
    nodes: DataFrame,
    edges: DataFrame,
    *,
    kinds: list[str] | None = None,
    exclude: list[str] | None = None,
    provenance: list[str] | None = None,
    communities: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The nodes of the wanted kinds and communities (a table with id), and the edges of the wanted provenance between them.

    No filter (None) lets all through, an empty list nothing; a null kind or provenance passes only without a filter on it.
    """
    kept = nodes
    if kinds is not None:
        kept = kept.where(F.col("kind").isin(kinds))
    if exclude:
        kept = kept.where(F.coalesce(~F.col("kind").isin(exclude), F.lit(False)))
    if communities is not None:
        kept = kept.join(communities.select("id").distinct(), "id", "left_semi")
    between = edges if provenance is None else edges.where(F.col("provenance").isin(provenance))
    ids = cut(kept.select("id").distinct(), "kept")
    for end in ("src", "dst"):
        between = between.join(checked_broadcast(ids.withColumnRenamed("id", end)), end, "left_semi")
    return kept, between


def keyword_walk(nodes: DataFrame, edges: DataFrame, words: list[str], depth: int, direction: str = "outgoing") -> DataFrame:
    """(id, depth, via, words): nodes around those whose name holds a keyword, with the least node each was met from.

    words are the keywords found in a start's name, comma-joined in the question's order; '' further on. Without
    keywords there is no row. Each level is one join of the frontier with the steps.
    """
    name = F.lower("name")
    hits = F.filter(F.array(*[F.when(F.contains(name, F.lit(w.lower())), w) for w in words]), lambda w: w.isNotNull()) if words else F.array().cast("array<string>")
    none = F.lit(None).cast("string")
    starts = nodes.select("id", F.lit(0).alias("depth"), none.alias("via"), F.array_join(hits, ",").alias("words")).where("words != ''").dropDuplicates(["id"])
    steps = cut(adjacency(edges, direction), "steps")
    seen = frontier = cut(starts, "walk")
    for level in range(1, depth + 1):
        ahead = steps.join(checked_broadcast(frontier.select(F.col("id").alias("a"))), "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("via"))
        frontier = cut(ahead.join(seen.select("id"), "id", "left_anti").select("id", F.lit(level).alias("depth"), "via", F.lit("").alias("words")), "walk")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def answer(nodes: DataFrame, walk: DataFrame, budget: int, cost: Column | None = None) -> DataFrame:
    """(id, depth, via, words, cost, spent): the walk's nodes by depth and id, as far as their costs add up to ``budget``.

    ``cost`` is an expression over the columns of nodes, 1 by default (so many nodes); the first node that doesn't fit ends the answer.
    """
    price = (F.lit(1) if cost is None else cost).cast("long").alias("cost")
    return within_budget(walk.join(nodes.select("id", price), "id"), [F.asc("depth"), F.asc("id")], F.col("cost"), budget)


def answer_edges(edges: DataFrame, found: DataFrame) -> DataFrame:
    """The edges on which an answer's nodes were met first: src, dst, dep_type, provenance, confidence."""
    steps = found.where("via IS NOT NULL").select(F.col("via").alias("src"), F.col("id").alias("dst"))
    steps = steps.join(found.select(F.col("id").alias("src")), "src", "left_semi")
    return edges.join(checked_broadcast(steps), ["src", "dst"], "left_semi").select("src", "dst", "dep_type", "provenance", "confidence")


def page_after(rows: DataFrame, order: list[tuple[str, bool]], after: list[object] | None, size: int) -> DataFrame:
    """The next ``size`` rows behind a cursor, by ``order``: pairs (column, whether descending), which together tell rows apart.

    ``after`` holds the order columns of the last row seen, None for the first page. Rows before it are filtered out, not counted.
    Nulls come last in either direction, and a cursor may hold them.
    """
    by = [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in order]
    if after is not None:
        beyond, same = [], F.lit(True)
        for (c, down), v in zip(order, after, strict=True):
            x = F.col(c)
            further = F.lit(False) if v is None else x.isNull() | F.coalesce((x < F.lit(v)) if down else (x > F.lit(v)), F.lit(False))
            beyond.append(same & further)
            same = same & x.eqNullSafe(F.lit(v))
        rows = rows.where(reduce(lambda a, b: a | b, beyond))
    return rows.orderBy(*by).limit(size)
