"""Benchmark decontamination: a positional inverted index answers phrase and proximity queries.

Training tokens become postings (term, document, position) for the two rarest terms of every test
window. A posting's position less the term's offset in its item is a diagonal; where the lists of
a window's two terms meet on one diagonal, the window may stand there, and the document's words
decide. Where they meet nearby on any diagonals, that is a proximity match. Everything is
DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.session import checked_broadcast, cut

WINDOW = 13
#: Test terms are broadcast up to so many (some 50 bytes each), and joined by shuffling beyond it.
TERMS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z only) words: runs of letters, digits and any non-ASCII characters; null has none.

    Capitals that only begin words are lowered word by word; texts with others are translated whole.
    """
    inner = text.rlike(r"[A-Z](?<=[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]{2})")
    found = F.split(F.when(inner, F.translate(text, UPPER, LOWER)).otherwise(text), r"[\P{Alnum}&&\p{ASCII}]+")
    low = F.transform(found, lambda w: F.when((w < "a") & (w >= "A"), F.translate(w, UPPER, LOWER)).otherwise(w))
    return F.coalesce(F.filter(low, lambda w: w != ""), F.array().cast("array<string>"))


def _windows(items: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    """(item (id), begin, window): every ``width`` consecutive words of an item, from word begin on (0 first); a shorter item is one window."""
    w = items.select(F.struct(F.col(item_id).alias("id")).alias("item"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))
    return w.select("item", F.posexplode(F.transform(starts, lambda i: F.slice("w", i + 1, width))).alias("begin", "window"))


def _probes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Windows that can occur, with their rarest term, the next rarest (null if there is none) and their offsets (first of each).

    A term that occurs in no document ends its window.
    """
    each = windows.select("item", "begin", "window", F.posexplode("window").alias("at", "t"))
    each = each.groupBy("item", "begin", "window", "t").agg(F.min("at").alias("at"))
    ranked = each.join(checked_broadcast(counts, TERMS), "t", "left").groupBy("item", "begin", "window").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "t", "at"))).alias("r")
    )
    second = F.try_element_at("r", F.lit(2))
    return ranked.where(F.col("r")[0]["n"] > 0).select("item", "begin", "window", F.col("r")[0]["t"].alias("t1"), F.col("r")[0]["at"].alias("o1"), second["t"].alias("t2"), second["at"].alias("o2"))


def _near(postings: DataFrame, probes: DataFrame, width: int) -> DataFrame:
    """(k1, k2, item) where the two rarest terms of one of the item's windows stand within a window's width; a lone term by itself."""
    pairs = probes.select("item", "t1", "t2").distinct()
    sides = pairs.select("item", "t1", "t2", F.explode(F.when(F.col("t2").isNull(), F.array("t1")).otherwise(F.array("t1", "t2"))).alias("term"))
    rows = postings.join(checked_broadcast(sides), "term").select("k1", "k2", "item", "t1", "t2", "pos", (F.col("term") == F.col("t1")).alias("first"))
    before = Window.partitionBy("k1", "k2", "item", "t1", "t2").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda which: F.last(F.when(which, F.col("pos")), ignorenulls=True).over(before)
    gap = F.abs(last(F.col("first")) - last(~F.col("first")))
    return rows.withColumn("close", F.col("t2").isNull() | F.coalesce(gap < width, F.lit(False))).where("close").select("k1", "k2", "item").distinct()


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WINDOW,
    share: int = 20,
) -> DataFrame:
    """One row per document row: what of it occurs in the benchmark.

    Columns: doc_id, n_words, n_hit (words inside any occurrence of a window), n_items and
    item_ids (items with an occurring window, sorted as strings), contaminated
    (n_hit > 0 and share * n_hit >= n_words), n_near_items (proximity matches: items of which the
    two rarest terms of a window, by their counts in all documents, stand within ``width`` words).

    A null or empty text has no words, no hits and is clean. Items without words are ignored;
    with an empty benchmark all documents are clean. All items without an id are one item, which counts in n_items and has no
    name in item_ids; texts repeated under one id are one item. Repeated rows give equal rows; a null id is kept. Other columns are not read, whatever their names. Documents are keyed by a 128-bit
    hash of their text, so copies meet once and ids need not be unique.
    """
    words = words_of(F.col("text"))
    key = [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), F.col("text")).alias("k2")]
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    windows = cut(_windows(benchmark, item_id, item_text, width), "windows")
    vocabulary = windows.select(F.explode("window").alias("t")).distinct()

    # how often each test term stands in the training text: all documents count
    counts = cut(src.select(F.explode(words).alias("t")).join(checked_broadcast(cut(vocabulary, "vocabulary"), TERMS), "t").groupBy("t").count(), "df")
    probes = cut(_probes(windows, counts), "probes")

    # the index: one row per document with its length, and one per posting of a probed term
    terms = cut(probes.select(F.explode(F.array("t1", "t2")).alias("term")).where("term IS NOT NULL").distinct(), "terms")
    tokens = src.select(*key, words.alias("w")).select("k1", "k2", F.posexplode("w").alias("pos", "term"))
    postings = cut(tokens.join(checked_broadcast(terms, TERMS), "term").distinct(), "postings")

    # offset-adjusted intersection: on a diagonal, position less offset in the item, both terms of a window must stand
    offsets = probes.select("item", F.explode(F.array(F.struct(F.col("t1").alias("term"), (F.col("begin") + F.col("o1")).alias("off")), F.struct(F.col("t2").alias("term"), (F.col("begin") + F.col("o2")).alias("off")))).alias("o"))
    offsets = cut(offsets.select("item", "o.*").where("term IS NOT NULL").distinct(), "offsets")
    on = postings.join(checked_broadcast(offsets), "term").groupBy("k1", "k2", "item", (F.col("pos") - F.col("off")).alias("diagonal")).agg(F.collect_set("off").alias("offs"))
    has = lambda o: F.array_contains("offs", F.col("begin") + F.col(o))
    able = on.join(checked_broadcast(probes, 20_000), "item").where(has("o1") & (F.col("o2").isNull() | F.coalesce(has("o2"), F.lit(False))))
    able = cut(able.select("k1", "k2", "item", (F.col("diagonal") + F.col("begin") + 1).alias("start"), "window"), "able")

    # the words decide
    named = checked_broadcast(cut(able.select("k1", "k2").distinct(), "named"))
    texts = src.select(*key, "text").join(named, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("k1", "k2", words.alias("w"))
    size = F.size("window")
    stands = (F.col("start") > 0) & (F.slice("w", F.greatest("start", F.lit(1)), size) == F.col("window"))
    met = cut(able.join(texts, ["k1", "k2"]).where(stands).select("k1", "k2", "item", "start", size.alias("len")), "met")

    # words covered by the union of the matched intervals
    runs = met.groupBy("k1", "k2", "start").agg(F.max("len").alias("len"))
    before = Window.partitionBy("k1", "k2").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    fresh = runs.withColumn("reach", F.max(end).over(before)).select("k1", "k2", F.greatest(end - F.greatest("start", F.coalesce("reach", F.lit(0))), F.lit(0)).alias("n"))
    hit = fresh.groupBy("k1", "k2").agg(F.sum("n").alias("n_hit"))
    items = met.select("k1", "k2", "item").distinct().groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_list(F.col("item.id").cast("string"))).alias("item_ids"))
    close = _near(postings, probes, width).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_near_items"))
    found = close.join(hit.join(items, ["k1", "k2"]), ["k1", "k2"], "full")

    base = src.select("doc_id", *key, F.size(words).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return base.join(checked_broadcast(cut(found, "found")), ["k1", "k2"], "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        ids.alias("item_ids"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("n_near_items", F.lit(0)).cast("long").alias("n_near_items"),
    )
