"""Adjacency: callers, callees, degrees, roots, leaves, kinds of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import module_of
from graphloom.session import cut, dealt


def callers(edges: DataFrame, node: str) -> DataFrame:
    """Distinct predecessors of a node."""
    return edges.where(F.col("dst") == node).select(F.col("src").alias("id")).distinct()


def callees(edges: DataFrame, node: str) -> DataFrame:
    """Distinct (target, dependency type) of a node with provenance and confidence."""
    return edges.where(F.col("src") == node).select(F.col("dst").alias("id"), "dep_type", "provenance", "confidence")


def fan_in(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("fan_in"))


def fan_out(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst", "dep_type").alias("fan_out"))


def with_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with fan_in (distinct callers) and fan_out (distinct target and type), 0 where there are none."""
    both = nodes.join(fan_in(edges), "id", "left").join(fan_out(edges), "id", "left")
    return both.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("fan_in", "fan_out")})


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that nothing points to: entry points."""
    return nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("src").alias("id")), "id", "left_anti")


def find_by_name(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(F.lower("name") == name.lower())


def by_kind(edges: DataFrame, kinds: list[str]) -> DataFrame:
    return edges.where(F.col("dep_type").isin(kinds))


def related_names(nodes: DataFrame, name: str, most: int) -> DataFrame:
    """Names within an edit distance of the given one."""
    away = F.levenshtein(F.lower("name"), F.lit(name.lower()))
    return nodes.select("id", "name", away.alias("distance")).where(F.col("distance") <= most)


def local_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends lie in one module, with it."""
    at = nodes.select("id", module_of(F.col("file")).alias("module"))
    a, b = at.withColumnsRenamed({"id": "src", "module": "from"}), at.withColumnsRenamed({"id": "dst", "module": "to"})
    return edges.join(a, "src").join(b, "dst").where(F.col("from") == F.col("to")).select("src", "dst", "dep_type", F.col("from").alias("module"))


def merged(*graphs: DataFrame) -> DataFrame:
    """Union of edge tables; of equal keys the most confident edge stays, then the smallest provenance.

    The tables are made once, as a file, and its rows dealt out by key, so that a task sorts no more of them however many there are.
    """
    every = graphs[0]
    for g in graphs[1:]:
        every = every.unionByName(g)
    keys = ["src", "dst", "dep_type"]
    best = F.max_by(F.struct("provenance", "confidence"), F.struct("confidence", F.col("provenance")))
    return dealt(cut(every, "graphs"), *keys).groupBy(*keys).agg(best.alias("x")).select(*keys, "x.*")
