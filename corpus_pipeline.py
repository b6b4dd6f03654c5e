"""From raw documents to packed training sequences: five stages, each one of the corpus operators.

STAGES lists (name, function); a function takes (spark, docs, sf_dir), where docs has the columns
of documents, and returns the documents it keeps (the last one: their placement in sequences).
run() writes every stage's result as Parquet in the shared folder and reads it back for the next.

Every stage accepts null ids, null, empty and long texts, repeated rows, empty tables and extra
columns: rows without an id are judged by their text; what a text decides, it decides for all rows
that have it; extra columns pass through untouched up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate as benchmarks
from graphloom.llm import secrets_scan, toxicity
from graphloom.llm.jaccard_join import jaccard_components
from graphloom.llm.packing import pack_documents
from graphloom.llm.workers import batches_of
from graphloom.session import checked_broadcast, cut, table


#: Rows of an Arrow batch in all stages: batches of whole texts would else hold a good part of an executor's memory.
BATCH_ROWS = 1000


def _small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``stage`` with batches of BATCH_ROWS in all that it runs, whoever calls it; what it returns unread is read with the session's own."""

    @wraps(stage)
    def inner(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with batches_of(spark, BATCH_ROWS):
            return stage(spark, docs, sf_dir)

    return inner


@_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated score stays below the threshold; null and empty texts are scored like others."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(model, F.col("text")) < toxicity.THRESHOLD)


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have yet."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


@_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, of several texts under that id the one of least hash.

    Documents without words are no copies of anything. Of repeated rows (id and text the same) one
    stays, whichever its other columns; rows without an id stay.
    """
    groups = cut(jaccard_components(docs, with_hash=True).where("doc_id IS NOT NULL"), "groups")
    rows = groups.groupBy("doc_id", "text_hash").agg(F.first("n_shingles").alias("n"), F.first("component_id").alias("c"), F.count(F.lit(1)).alias("times"))
    winners = rows.where("n > 0").groupBy("c").agg(F.min(F.struct("doc_id", "text_hash")).alias("w"))
    losers = rows.where("n > 0").join(winners, "c").where(F.struct("doc_id", "text_hash") != F.col("w"))
    drop, repeated = cut(losers.select("doc_id", "text_hash"), "drop"), cut(rows.where("times > 1").select("doc_id", "text_hash"), "repeated")
    own = _free(docs, "text_hash")
    keyed = docs.withColumn(own, F.xxhash64("text"))
    kept = keyed.join(checked_broadcast(drop.withColumnRenamed("text_hash", own)), ["doc_id", own], "left_anti")
    if repeated.isEmpty():
        return kept.select(docs.columns)
    few = checked_broadcast(repeated.withColumnRenamed("text_hash", own))
    once = kept.join(few, ["doc_id", own], "left_semi").dropDuplicates(["doc_id", own])
    return kept.join(few, ["doc_id", own], "left_anti").select(docs.columns).unionByName(once.select(docs.columns))


@_small_batches
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in benchmark windows. Null and empty texts stay."""
    key = F.concat_ws(":", F.xxhash64("text"), F.xxhash64(F.lit(1), F.col("text")))  # the text decides, so the text is the key
    found = benchmarks.decontaminate(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    own = _free(docs, "text_key")
    bad = cut(found.where("contaminated").select(F.col("doc_id").alias(own)).distinct(), "contaminated")
    return docs.withColumn(own, key).join(checked_broadcast(bad), own, "left_anti").select(docs.columns)


@_small_batches
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked in their texts, n_chars counted again. Null texts stay null.

    The masked rows are written before they are returned: whole texts go to and from Python here, in small batches only.
    """
    grammars = secrets_scan.learn(docs)
    masked = docs.withColumn("text", secrets_scan.redacted(grammars, F.col("text")))
    return cut(masked.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns), "masked")


@_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Placement of every piece of every document in sequences of 4096 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", mask_secrets),
    ("best_fit_packing", pack),
]

#: SQL cannot fit the stages' models; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with batches_of(spark, BATCH_ROWS):
        for name, stage in STAGES:
            docs = cut(stage(spark, docs, sf_dir), name)
    return docs
