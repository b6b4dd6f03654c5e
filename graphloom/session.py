"""Session helpers: table loading, lineage cuts in shared storage, checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when a count has shown that it has at most so many rows.
BROADCAST_ROWS = 200_000
#: Rows that ``dealt`` gives a task on average.
TASK_ROWS = 500_000

_fallback: list[str] = []
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables; any path that Spark itself can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset a temporary folder takes its place, in local mode only: on a cluster no folder
    of one machine will do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _fallback:
        own = tempfile.TemporaryDirectory(prefix="graphloom-")
        atexit.register(own.cleanup)
        _fallback.append(f"file://{own.name}")
    return _fallback[0]


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    The lineage ends there: a lost executor costs a re-read, never a recomputation of what
    came before, and later steps read only the columns they use.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> int:
    """Remove the tables that ``cut`` has written in this process, and give their number; DataFrames that read them are of no more use.

    For sessions that run many queries: call it once their results are stored.
    """
    n = 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by keys to as many tasks that each has TASK_ROWS rows on average, one a core at least.

    For sums whose groups are nearly as many as the rows: the memory of a task then stays the same however many rows there are.
    Shuffled by size instead, small rows that compress well make tasks of millions of groups.
    """
    n = -(-df.count() // TASK_ROWS)
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *keys)


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else as it is."""
    few = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if few else df
