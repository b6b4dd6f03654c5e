"""Incremental reindexing: a stream of change events keeps a graph current, and only touched keys are written.

The state is one row per edge key or removed symbol, in Spark's own state store: the latest event of each. A micro-batch hands
on the keys whose events it held, which go to a change log under the batch's number, so a batch that is repeated after a
failure writes the same files again. The current graph is read from the latest compaction and the batches after it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

EVENTS = "op string, src string, dst string, dep_type string, seq long"
LOG = "src string, dst string, dep_type string, op string, seq long"
REMOVED = "symbol_removed"


def watched(spark: SparkSession, folder: str, schema: str | StructType = EVENTS, *, file_format: str = "json", files: int | None = None) -> DataFrame:
    """New files of a folder as a stream of events, ``files`` of them a batch at most; what was read is kept in the checkpoint."""
    reader = spark.readStream.schema(schema).format(file_format)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).load(folder)


def latest(events: DataFrame) -> DataFrame:
    """(src, dst, dep_type, op, seq): the latest event of each edge key, and for removed symbols (dst and dep_type '') the latest removal.

    Of events with one seq the greater op decides. Events without src or seq are left out; other nulls are ''.
    """
    gone = F.col("op") == REMOVED
    end = lambda c: F.when(gone, "").otherwise(F.coalesce(c, F.lit(""))).alias(c)
    known = events.where("src IS NOT NULL AND seq IS NOT NULL AND op IS NOT NULL").select("src", end("dst"), end("dep_type"), gone.alias("gone"), F.struct("seq", "op").alias("x"))
    return known.groupBy("src", "dst", "dep_type", "gone").agg(F.max("x").alias("x")).select("src", "dst", "dep_type", "x.op", "x.seq")


def reindex(events: DataFrame, folder: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Start keeping the change log under ``folder`` current from a stream of events; ``once`` stops at what is there now."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number:012d}")

    stream = latest(events).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()


def _parts(spark: SparkSession, folder: str) -> tuple[list[str], int]:
    """The folders that make up the log: the latest compaction and the batches after it, and the last batch's number."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    done = [n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    number = lambda n: int(re.sub(r"\D", "", n))
    bases = sorted(n for n in done if n.startswith("base="))
    start = number(bases[-1]) if bases else -1
    batches = sorted(n for n in done if n.startswith("batch=") and number(n) > start)
    return [f"{folder}/{n}" for n in bases[-1:] + batches], number((bases[-1:] + batches)[-1]) if bases or batches else -1


def log(spark: SparkSession, folder: str) -> DataFrame:
    """The latest event of every key in the change log; empty before the first batch."""
    paths, _ = _parts(spark, folder)
    if not paths:
        return spark.createDataFrame([], LOG)
    return latest(spark.read.schema(LOG).parquet(*paths))


def current(spark: SparkSession, folder: str) -> DataFrame:
    """(src, dst, dep_type) of the edges that stand: last added, and at no end removed since."""
    last = log(spark, folder)
    gone = last.where(F.col("op") == REMOVED).select(F.col("src").alias("id"), F.col("seq").alias("gone"))
    edges = last.where("op = 'dependency_added'")
    for end in ("src", "dst"):
        edges = edges.join(gone.withColumnRenamed("id", end), end, "left").where("gone IS NULL OR gone < seq").drop("gone")
    return edges.select("src", "dst", "dep_type")


def compact(spark: SparkSession, folder: str) -> int:
    """Write the log so far as one table, which readers take from then on; older folders may go. Returns the last batch in it, -1 for none."""
    paths, number = _parts(spark, folder)
    if len(paths) > 1:
        log(spark, folder).write.mode("overwrite").parquet(f"{folder}/base={number:012d}")
    return number
