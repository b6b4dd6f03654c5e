"""Change events as streams: debouncing, folding into the graph's state, windows of activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.aggregate import keep_last


def folded(state: DataFrame, events: DataFrame) -> DataFrame:
    """Edges (src, dst, dep_type) after events (op, src, dst, dep_type, seq): the last event of a key decides.

    op is dependency_added or dependency_removed, or symbol_removed with src alone, which also
    removes every edge of the symbol that was added before it.
    """
    key = ["src", "dst", "dep_type"]
    gone = events.where("op = 'symbol_removed'").groupBy(F.col("src").alias("id")).agg(F.max("seq").alias("gone"))
    old = state.select(*key, F.lit("dependency_added").alias("op"), F.lit(-1).cast("long").alias("seq"))
    last = keep_last(old.unionByName(events.where("op != 'symbol_removed'").select(*key, "op", "seq")), key, ["seq", "op"]).where("op = 'dependency_added'")
    for end in ("src", "dst"):
        last = last.join(gone.withColumnRenamed("id", end), end, "left").where("gone IS NULL OR gone < seq").drop("gone")
    return last.select(key)


def debounced(events: DataFrame, window: str, late: str) -> DataFrame:
    """Distinct files touched per event-time window, in one batch once the window is closed."""
    seen = events.withWatermark("ts", late).groupBy(F.window("ts", window), "file").agg(F.count(F.lit(1)).alias("touches"))
    return seen.select(F.col("window.start").alias("start"), "file", "touches")


def debounce_stream(events: DataFrame, folder: str, checkpoint: str, window: str, late: str) -> StreamingQuery:
    """Keep the debounced batches of a stream of (ts, file) under ``folder``: each micro-batch writes the windows it touched, under its number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number:012d}")

    return debounced(events, window, late).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def debounce_state(updates: DataFrame) -> DataFrame:
    """(start, file, touches) as of the latest update of each window and file; touches only grow."""
    return updates.groupBy("start", "file").agg(F.max("touches").alias("touches"))


def activity(events: DataFrame, window: str, late: str) -> DataFrame:
    """Events and value per type and tumbling window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def fold_stream(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep the graph under ``folder`` current: each micro-batch writes version <batch id> from the one before it.

    A repeated batch writes the same version again, so a restart loses and doubles nothing.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = spark.createDataFrame([], "src string, dst string, dep_type string") if number == 0 else spark.read.parquet(f"{folder}/v={number - 1}")
        folded(state, batch).write.mode("overwrite").parquet(f"{folder}/v={number}")

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
