"""Versioned graph tables: revisions as partitions, a head pointer, idempotent commits, lineage of runs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADS = "workspace_id string, revision_id long, commit_key string, at timestamp"


def heads(spark: SparkSession, root: str) -> DataFrame:
    """(workspace_id, revision_id): the latest committed revision of each workspace."""
    try:
        log = spark.read.schema(HEADS).parquet(f"{root}/heads")
        return log.groupBy("workspace_id").agg(F.max("revision_id").alias("revision_id"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "workspace_id string, revision_id long")


def _folder(root: str, workspace: str, revision: int) -> str:
    """The partition of a revision, named as Spark's own writer of partitions would name it."""
    name = re.sub(r"[\x01-\x1f\"#%'*/:=?\\\x7f{\[\]^]", lambda m: f"%{ord(m[0]):02X}", workspace) or "__HIVE_DEFAULT_PARTITION__"
    return f"{root}/edges/workspace_id={name}/revision_id={revision}"


def commit(root: str, workspace: str, edges: DataFrame, key: str) -> int:
    """Write a revision and then its head entry; a key that was committed before gives its revision again.

    The head entry is written last, so a reader sees the old or the new revision, never half of one. A revision whose head
    entry was lost is written over by the next commit, so a retry doubles nothing. The revision goes straight into its one
    partition: written by columns, its rows would first be sorted by values that are all the same.
    """
    spark = edges.sparkSession
    own = heads(spark, root).where(F.col("workspace_id") == workspace).first()
    if own:
        same = spark.read.schema(HEADS).parquet(f"{root}/heads").where((F.col("workspace_id") == workspace) & (F.col("commit_key") == key)).first()
        if same:
            return same["revision_id"]
    revision = (own["revision_id"] if own else 0) + 1
    edges.drop("workspace_id", "revision_id").write.mode("overwrite").parquet(_folder(root, workspace, revision))
    row = spark.createDataFrame([(workspace, revision, key)], "workspace_id string, revision_id long, commit_key string").withColumn("at", F.current_timestamp())
    row.write.mode("append").parquet(f"{root}/heads")
    return revision


def snapshot(spark: SparkSession, root: str, workspace: str, revision: int | None = None) -> DataFrame:
    """A workspace's edges at a revision, its head by default; partitions of others aren't read."""
    if revision is None:
        revision = heads(spark, root).where(F.col("workspace_id") == workspace).first()["revision_id"]
    return spark.read.parquet(f"{root}/edges").where((F.col("workspace_id") == workspace) & (F.col("revision_id") == revision)).drop("workspace_id", "revision_id")


def valid_at(rows: DataFrame, revision: int) -> DataFrame:
    """Rows of a bitemporal table that hold at a revision (valid_to -1: still)."""
    return rows.where((F.col("valid_from") <= revision) & ((F.col("valid_to") == -1) | (F.col("valid_to") > revision)))
