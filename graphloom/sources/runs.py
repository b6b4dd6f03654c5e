"""Graphs and runs kept as files: JSON graphs, reports, run histories as JSON lines, checkpoints, registered spaces, migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.aggregate import keep_last
from graphloom.session import dealt
from graphloom.sources import store

JSON_GRAPH = "nodes array<struct<id:string,kind:string,name:string>>, edges array<struct<source:string,target:string,relation:string,confidence:double>>"


def json_graph(texts: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of graphs written as JSON: {"nodes": [{id, kind, name}], "edges": [{source, target, relation, confidence}]}.

    A node that only an edge names is one without kind and name. Of nodes with one id, and of edges with one key, the one with
    the greatest values stays. Text that is no such JSON adds nothing, and neither do nodes and edges without ids.
    """
    read = texts.select(F.from_json(text, JSON_GRAPH).alias("g"))
    edges = read.select(F.explode("g.edges").alias("x")).select(F.col("x.source").alias("src"), F.col("x.target").alias("dst"), F.coalesce("x.relation", F.lit("")).alias("dep_type"), "x.confidence")
    edges = edges.where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst", "dep_type").agg(F.max("confidence").alias("confidence"))
    own = read.select(F.explode("g.nodes").alias("x")).select("x.*").where("id IS NOT NULL")
    none = F.lit(None).cast("string")
    named = edges.select(F.col("src").alias("id")).union(edges.select("dst")).select("id", none.alias("kind"), none.alias("name"))
    nodes = own.union(named).groupBy("id").agg(F.max(F.struct("kind", "name")).alias("x")).select("id", "x.*")
    return nodes, edges


def generic(nodes: DataFrame, edges: DataFrame, order: Column) -> tuple[DataFrame, DataFrame]:
    """(nodes, relations) of a call graph in generic form: (id, label, properties) and (src, dst, type, properties), the first by ``order`` of each key.

    Labels are the kinds with a capital, types the dependency kinds in capitals; all other columns are kept as JSON. Migrating what
    was migrated together with the same rows again changes nothing.
    """
    rest = lambda df, keys: F.to_json(F.struct(*[c for c in df.columns if c not in keys])) if set(df.columns) - set(keys) else F.lit("{}")
    n = nodes.groupBy("id").agg(F.min_by(F.struct(F.initcap("kind").alias("label"), rest(nodes, ["id", "kind"]).alias("properties")), F.col("id")).alias("x")).select("id", "x.*")
    keyed = edges.withColumn("type", F.upper("dep_type"))
    r = keyed.groupBy("src", "dst", "type").agg(F.min_by(rest(edges, ["src", "dst", "dep_type"]), order).alias("properties"))
    return n, r


def append_runs(runs: DataFrame, folder: str) -> None:
    """Add run entries to a history of JSON lines."""
    runs.write.mode("append").json(folder)


def read_runs(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The entries of a history; a line that is no JSON of the schema is left out, a folder that is not there has none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder)


def latest_reports(reports: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The newest report of each key, of several at one time the one with the greatest values."""
    rest = [c for c in reports.columns if c not in [*keys, at]]
    return keep_last(reports, keys, [at, *rest])


def checkpoints(spark: SparkSession, root: str, workspace: str) -> DataFrame:
    """(revision_id, symbols, edges) of every revision of a workspace in a store."""
    rows = spark.read.parquet(f"{root}/edges").where(F.col("workspace_id") == workspace)
    edges = rows.groupBy("revision_id").agg(F.count(F.lit(1)).alias("edges"))
    # dealt out first: the ends that a task makes distinct are then those of so many rows, not those of a large piece of a file
    pairs = dealt(rows.select("revision_id", "src", "dst"), "src", "dst")
    ends = pairs.select("revision_id", F.explode(F.array("src", "dst")).alias("id")).distinct().groupBy("revision_id").agg(F.count(F.lit(1)).alias("symbols"))
    return edges.join(ends, "revision_id").select("revision_id", "symbols", "edges")


def restore(spark: SparkSession, root: str, workspace: str, revision: int, key: str) -> int:
    """Commit an earlier revision's edges again, as the newest; the key makes a retry harmless."""
    return store.commit(root, workspace, store.snapshot(spark, root, workspace, revision), key)


def spaces(log: DataFrame) -> DataFrame:
    """(space, name) of the registered spaces: the last entry (space, name, op, seq) of each decides, unless its op is unregister."""
    return keep_last(log, ["space"], ["seq", "op"]).where("op != 'unregister'").select("space", "name")
