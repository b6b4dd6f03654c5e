"""Several spaces' graphs side by side: ids, search over all, candidates for merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.questions import page_after
from graphloom.session import checked_broadcast


def normal_label(label: Column) -> Column:
    """Lower-case, trimmed, white space as single blanks, no punctuation at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(label)), r"\s+", " "), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def merge_candidates(nodes: DataFrame) -> DataFrame:
    """(a, b, score) of nodes (space, id, label, kind) of different spaces with equal labels: 0.5 + 0.3, and 0.2 for the kind.

    A score of 0.8 needs the label, so an equi-join on it finds every candidate.
    """
    n = nodes.select("space", F.concat_ws("::", "space", "id").alias("fid"), normal_label(F.col("label")).alias("l"), "kind").where("l != ''")
    a, b = n.toDF("sa", "a", "l", "ka"), n.toDF("sb", "b", "l", "kb")
    return a.join(b, "l").where("sa < sb").select("a", "b", F.when(F.col("ka") == F.col("kb"), 1.0).otherwise(0.8).alias("score"))


def label_classes(nodes: DataFrame) -> DataFrame:
    """(label, spaces, kinds, n): the normal labels that nodes of several spaces have, one row each.

    Every two members of different spaces are merge candidates, 1.0 of one kind and 0.8 of two; a
    row per pair would grow with the square of a label's nodes.
    """
    n = nodes.withColumn("label", normal_label(F.col("label"))).where("label != ''")
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",").alias(f"{c}s")
    classes = n.groupBy("label").agg(listed("space"), listed("kind"), F.count(F.lit(1)).alias("n"), F.countDistinct("space").alias("k_"))
    return classes.where("k_ > 1").drop("k_")


def label_members(nodes: DataFrame) -> DataFrame:
    """(fid, label, kind): the nodes of every class of label_classes."""
    n = nodes.select(F.concat_ws("::", "space", "id").alias("fid"), normal_label(F.col("label")).alias("label"), "kind")
    return n.join(checked_broadcast(label_classes(nodes).select("label")), "label", "left_semi").select("fid", "label", "kind")


def federated_search(nodes: DataFrame, spaces: DataFrame, query: str, limit: int) -> DataFrame:
    """First matches in the order of the spaces (space, position), then of name and id."""
    hits = nodes.where(F.contains(F.lower("label"), F.lit(query.lower()))).join(F.broadcast(spaces), "space")
    return hits.orderBy("position", "label", "id").limit(limit).select(F.concat_ws("::", "space", "id").alias("fid"), "label")


def federated_page(nodes: DataFrame, spaces: DataFrame, query: str, after: list[object] | None, size: int) -> DataFrame:
    """(fid, label, position, id): the next matches behind a cursor (position, label, id of the last one seen; None for the first page)."""
    hits = nodes.where(F.contains(F.lower("label"), F.lit(query.lower()))).join(checked_broadcast(spaces), "space")
    hits = hits.select(F.concat_ws("::", "space", "id").alias("fid"), "label", "position", "id")
    return page_after(hits, [("position", False), ("label", False), ("id", False)], after, size)
