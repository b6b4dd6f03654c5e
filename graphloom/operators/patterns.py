"""Path patterns: node conditions, edge kinds with an arrow, bounded repetition; rows are paths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.reach import adjacency
from graphloom.session import cut

ARROWS = {"->": "outgoing", "<-": "incoming", "<->": "both"}
#: Repetition marks and their hops: fixed values.
MARKS = {"": (1, 1), "?": (0, 1), "+": (1, 8)}


@dataclass
class Step:
    """An edge of a pattern: arrow, edge kinds (none: any), hops, and the nodes (id) it may end at (none: any)."""

    arrow: str = "->"
    kinds: tuple[str, ...] = ()
    hops: tuple[int, int] = (1, 1)
    ends: DataFrame | None = None


def hops(mark: str) -> tuple[int, int]:
    """Least and most hops of a repetition: nothing, ?, +, *n or *m..n; without an upper end it is refused."""
    if mark in MARKS:
        return MARKS[mark]
    least, dots, most = mark.removeprefix("*").partition("..")
    if not mark.startswith("*") or not least.isdigit() or (dots and not most.isdigit()):
        raise ValueError(f"repetition without bounds: {mark}")
    low, high = int(least), int(most or least)
    if low > high:
        raise ValueError(f"empty repetition: {mark}")
    return low, high


def match(edges: DataFrame, starts: DataFrame, steps: list[Step]) -> DataFrame:
    """path: the node ids of every path that fits the pattern, no node twice."""
    rows = starts.select(F.array("id").alias("path")).distinct()
    for step in steps:
        own = edges.where(F.col("dep_type").isin(list(step.kinds))) if step.kinds else edges
        move = cut(adjacency(own, ARROWS[step.arrow]), "moves")
        low, high = step.hops
        now, found = rows, rows if low == 0 else None
        for k in range(1, high + 1):
            ahead = now.join(move, F.element_at("path", -1) == F.col("a")).where(~F.array_contains("path", F.col("b")))
            now = cut(ahead.select(F.array_append("path", F.col("b")).alias("path")), "paths")
            if k >= low:
                found = now if found is None else found.union(now)
        rows = found.distinct()
        if step.ends is not None:
            rows = rows.withColumn("id", F.element_at("path", -1)).join(step.ends.select("id").distinct(), "id", "left_semi").select("path")
    return rows


def as_nodes(paths: DataFrame) -> DataFrame:
    """Distinct ids on the paths."""
    return paths.select(F.explode("path").alias("id")).distinct()


def as_edges(paths: DataFrame) -> DataFrame:
    """Distinct (from, to) of consecutive nodes on the paths."""
    pairs = F.arrays_zip(F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0))).alias("from"), F.slice("path", F.lit(2), F.greatest(F.size("path") - 1, F.lit(0))).alias("to"))
    return paths.select(F.explode(pairs).alias("p")).select("p.from", "p.to").distinct()


def as_counts(paths: DataFrame, nodes: DataFrame, by: str, limit: int) -> DataFrame:
    """(by, n) of the paths' ends by a column of nodes: the most frequent first."""
    ends = paths.select(F.element_at("path", -1).alias("id")).join(nodes.select("id", by), "id")
    return ends.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by).limit(limit)
