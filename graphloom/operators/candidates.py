"""Candidates for relations and merges, without a row for each pair of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.federation import normal_label

#: Confidence of each rule, and the least length of a shared token: fixed values.
SAME_FILE, SAME_COMMUNITY, SHARED_TOKEN, TOKEN = 0.7, 0.5, 0.3, 3
#: Score of a pair of different spaces, and what equal labels, equal kinds and a shared property key add: fixed values.
BASE, LABEL, KIND, PROPERTY, THRESHOLD = 0.5, 0.3, 0.2, 0.1, 0.8


def name_tokens(name: Column) -> Column:
    """Distinct parts of a name, split at other characters than letters and digits and at changes of case; case stays."""
    split = F.regexp_replace(F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2")
    return F.array_distinct(F.filter(F.split(split, "[^A-Za-z0-9]+"), lambda p: F.length(p) >= TOKEN))


def _first(members: DataFrame, n: int) -> DataFrame:
    """(g, candidate): the first n ids of each group. Tasks keep n of each group before anything is shuffled."""
    order = Window.partitionBy("g").orderBy("candidate")
    return members.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).select("g", "candidate")


def top_candidates(nodes: DataFrame, targets: DataFrame, communities: DataFrame, k: int) -> DataFrame:
    """(id, rank, candidate, score, reason): each target's k best candidates by score, then by id.

    A candidate is another node of the target's file (0.7), of its community (0.5; communities are (id, community)), or with a
    name token in common (0.3); the best rule counts. A better rule takes at most k, and a target is itself in its groups, so
    2k + 1 first members of a group are all that any target can need of it: a group of any size sends no more than that. Null
    files and communities are no group.
    """
    rules = [
        (SAME_FILE, "same_file", nodes.select("id", F.col("file").alias("g"))),
        (SAME_COMMUNITY, "same_community", communities.toDF("id", "g")),
        (SHARED_TOKEN, "name_match", nodes.select("id", F.explode(name_tokens(F.col("name"))).alias("g"))),
    ]
    ids, found = targets.select("id").distinct(), None
    for score, reason, members in rules:
        members = members.where("g IS NOT NULL").distinct()
        near = members.join(ids, "id", "left_semi").join(_first(members.withColumnRenamed("id", "candidate"), 2 * k + 1), "g")
        near = near.where("id != candidate").select("id", "candidate", F.lit(score).alias("score"), F.lit(reason).alias("reason"))
        found = near if found is None else found.union(near)
    best = found.groupBy("id", "candidate").agg(F.max("score").alias("score"), F.max_by("reason", "score").alias("reason"))
    order = Window.partitionBy("id").orderBy(F.desc("score"), "candidate")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("id", "rank", "candidate", "score", "reason")


def merge_scores(nodes: DataFrame) -> DataFrame:
    """(label, score, pairs): how many pairs of nodes of different spaces have each score of THRESHOLD or more, by their normal label.

    ``nodes`` has space, label, kind and properties (an array of keys). Only equal labels reach the threshold. Members of a label are
    counted by space, kind and set of keys; only these counts meet, so that the rows depend on how many sorts of nodes a
    label has, not on how many nodes. A null kind equals a null kind; null properties are none.
    """
    keys = F.array_sort(F.array_distinct(F.coalesce("properties", F.array().cast("array<string>"))))
    sorts = nodes.select("space", normal_label(F.col("label")).alias("label"), "kind", keys.alias("keys")).where("label != ''")
    sorts = sorts.groupBy("space", "label", "kind", "keys").agg(F.count(F.lit(1)).alias("n"))
    a, b = (sorts.select("label", *[F.col(c).alias(f"{c}_{side}") for c in ("space", "kind", "keys", "n")]) for side in "ab")
    met = a.join(b, "label").where("space_a < space_b")
    score = BASE + LABEL + F.when(F.col("kind_a").eqNullSafe(F.col("kind_b")), KIND).otherwise(0.0) + F.when(F.arrays_overlap("keys_a", "keys_b"), PROPERTY).otherwise(0.0)
    scored = met.select("label", F.round(F.least(F.lit(1.0), score), 6).alias("score"), (F.col("n_a") * F.col("n_b")).alias("pairs"))
    return scored.where(F.col("score") >= THRESHOLD).groupBy("label", "score").agg(F.sum("pairs").alias("pairs"))
