"""Document fingerprints by I-Match over randomised lexicon subsets.

Terms whose inverse document frequency lies in a band make the lexicon. A text's distinct terms in
it, sorted and hashed, are its I-Match signature. The lexicon is also split at random into PARTS
subsets, of the whole lexicon (level 0) and of lexicons thinned four times, sixteen times and so on;
a text gives a signature for each subset of the level that leaves some one to two terms in each,
and of the next. Texts are alike by the share of their subsets whose signatures agree: each is lost
only to an edit that touches its own few terms. Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.decontaminate import words_of
from graphloom.session import checked_broadcast, cut

#: The band: terms in so many of all documents at least, and at most; ln(1000) >= idf >= ln(20).
RARE, COMMON = 0.001, 0.05
#: Subsets of a level. A level fits texts with less than twice as many terms, counted after thinning.
PARTS = 32
#: Terms of a lexicon that tasks get whole. It has at most (mean distinct terms of a document) / RARE terms, however many documents there are.
LEXICON = 2_000_000
NONE = "----"


def terms_of(text: Column) -> Column:
    """Distinct 64-bit hashes of a text's words, ascending; see ``words_of``."""
    return F.array_sort(F.array_distinct(F.transform(words_of(text), lambda w: F.xxhash64(w))))


def lexicon(docs: DataFrame, *, text: str = "text", rare: float = RARE, common: float = COMMON) -> DataFrame:
    """(term, df) of the terms in the band; all documents count, repeated ones too."""
    n = docs.count()
    each = docs.select(F.explode(terms_of(F.col(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return each.where((F.col("df") >= rare * n) & (F.col("df") <= common * n))


def _hash_table(lexicon: DataFrame, bits: int) -> DataFrame:
    """One row: all terms, those of a cell (a term's highest ``bits`` bits) together, and the place where each of the cells begins."""
    cell = F.shiftrightunsigned("term", 64 - bits).cast("int")
    filled = lexicon.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    every = lexicon.sparkSession.range((1 << bits) + 1).select(F.col("id").cast("int").alias("cell")).join(filled, "cell", "left")
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # bounded as the lexicon is
    starts = every.select("cell", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int").alias("start"))
    listed = lambda df, by, what: df.agg(F.transform(F.array_sort(F.collect_list(F.struct(by, what))), lambda x: x[what]).alias(f"{what}s"))
    return listed(lexicon.select("term", cell.alias("cell")), "cell", "term").join(listed(starts, "cell", "start"))


def in_band(rows: DataFrame, lexicon: DataFrame, keys: list[str], *, most: int = LEXICON) -> DataFrame:
    """``rows`` with their column ``terms`` kept to the lexicon; terms of which none is in it stay as they are.

    A lexicon of at most ``most`` terms goes to the tasks as a hash table, a larger one is joined: ``keys`` identify the rows.
    """
    if (n := lexicon.count()) <= most:
        bits = max(1, n.bit_length() - 1)
        made = cut(_hash_table(lexicon, bits), "lexicon_table")
        rows = rows.withColumn("table_", made.select(F.struct("terms", "starts")).scalar())
        at = lambda t: F.shiftrightunsigned(t, 64 - bits).cast("int")
        own = lambda t: F.slice(F.col("table_.terms"), F.get("table_.starts", at(t)) + 1, F.get("table_.starts", at(t) + 1) - F.get("table_.starts", at(t)))
        kept = F.filter("terms", lambda t: F.array_contains(own(t), t))
    else:
        met = rows.select(*keys, F.explode("terms").alias("term")).join(lexicon.select("term"), "term").groupBy(*keys).agg(F.array_sort(F.collect_list("term")).alias("kept"))
        rows, kept = rows.join(met, keys, "left"), F.coalesce("kept", F.array().cast("array<long>"))
    columns = [c for c in rows.columns if c not in ("table_", "kept")]
    found = rows.select(*columns, kept.alias("kept"))
    return found.withColumn("terms", F.when(F.size("kept") > 0, F.col("kept")).otherwise(F.col("terms"))).select(columns)


def _level(n: Column) -> Column:
    """The least level that thins n terms to less than 2 * PARTS."""
    bits = F.length(F.bin(n.cast("long"))) - (2 * PARTS).bit_length() + 1
    return F.greatest(F.floor((bits + 1) / 2), F.lit(0)).cast("int")


def _signatures(terms: Column, level: Column) -> Column:
    """PARTS signatures of four hexadecimal digits, NONE where a subset holds no term of the text."""
    thin = F.filter(terms, lambda t: t.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), 2 * level) - 1) == 0)
    part = lambda t: F.shiftrightunsigned(t, 64 - (PARTS - 1).bit_length())
    digits = lambda own: F.lpad(F.hex(F.xxhash64(own).bitwiseAND(0xFFFF)), 4, "0")
    one = lambda own: F.when(F.size(own) > 0, digits(own)).otherwise(NONE)
    # the thinned terms are an element, so that they are made once and not for each part
    return F.transform(F.array(thin), lambda some: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda k: one(F.filter(some, lambda t: part(t) == k))), ""))[0]


def fingerprint_of(terms: Column) -> Column:
    """Signature of all terms (16 digits), '.', level (2 digits), '.', signatures of that level and of the next."""
    level = _level(F.size(terms))
    whole = F.lpad(F.hex(F.xxhash64(terms)), 16, "0")
    return F.concat(whole, F.lit("."), F.lpad(level.cast("string"), 2, "0"), F.lit("."), _signatures(terms, level), _signatures(terms, level + 1))


def likeness(a: Column, b: Column) -> Column:
    """Share (0 to 1) of agreeing signatures among those of subsets with terms of either text, at the levels that both have, and the whole one."""
    level = lambda f: F.substring(f, 18, 2).cast("int")
    begin = F.greatest(level(a), level(b))  # the first level that both have
    width = 4 * PARTS * (2 - F.abs(level(a) - level(b)))
    cells = lambda f: F.regexp_extract_all(F.substring(f, 21 + 4 * PARTS * (begin - level(f)), width), F.lit(".{4}"), F.lit(0))
    # a pair of cells counts 1 if there is a term in either, and 65536 more if they agree
    marks = F.zip_with(cells(a), cells(b), lambda x, y: F.when(x != y, 1).when(x == NONE, 0).otherwise(65537))
    total = F.aggregate(marks, F.lit(0), lambda n, m: n + m)
    share = F.transform(F.array(total), lambda n: F.shiftright(n, 16) / (n.bitwiseAND(65535) + 1))[0]
    return F.when(a == b, 1.0).when(width > 0, share).otherwise(0.0).cast("double")


def _key(doc_id: str, text: str) -> list[Column]:
    return [F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(F.lit(1), doc_id, text).alias("k2")]


def previous(rows: DataFrame) -> DataFrame:
    """(k1, k2, p1, p2, p_chars): for each distinct (doc_id, k1, k2) the one before it by descending doc_id; before the first is the last.

    Ranges of the order are sorted apart; only one row for each range is looked at together.
    """
    order = [F.desc_nulls_last("doc_id"), F.asc("k1"), F.asc("k2")]
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "order")
    ranges = placed.groupBy(F.shiftright("at", 33).alias("range")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    ranges = cut(ranges, "ranges")  # one row for each partition of the shuffle
    before = F.coalesce(F.lag("last").over(Window.orderBy("range")), F.max("last").over(Window.partitionBy(F.lit(1))))
    starts = ranges.select(F.col("first").alias("at"), before.alias("end"))
    asked = placed.join(F.broadcast(starts), "at", "left").select("k1", "k2", F.coalesce("end", F.col("at") - 1).alias("at"))
    return asked.join(placed.select("at", F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("n_chars").alias("p_chars")), "at").drop("at")


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every document row; null texts are empty, null ids stay, other columns are not read."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = cut(lexicon(src), "lexicon")
    rows = src.withColumns({"terms": terms_of(F.col("text")), "k1": F.monotonically_increasing_id()})
    return in_band(rows, words, ["k1"]).select("doc_id", F.length("text").cast("long").alias("n_chars"), fingerprint_of(F.col("terms")).alias("fingerprint"))


def edited_likeness(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", most: int = LEXICON) -> DataFrame:
    """Every document row beside its edited text and the next document.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_id. The
    edited text's last floor(n_chars / 2) code points are the first as many (or all) of the next document, by
    descending doc_id, after the last the first. Null texts are empty; a null id comes last; of rows with one
    id the texts' hashes give the order, and repeated rows (id and text the same) count once in it and give
    equal rows. A document alone is its own next. Texts without words are alike. Other columns are not read.
    """
    src = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = cut(lexicon(src), "lexicon")
    src = src.select("doc_id", "text", *_key("doc_id", "text"))
    keys = src.select("doc_id", "k1", "k2", F.length("text").cast("long").alias("n_chars"))
    keys = cut(keys.groupBy("doc_id", "k1", "k2", "n_chars").agg(F.count(F.lit(1)).alias("times")), "keys")
    pairs = cut(previous(keys.drop("times")), "previous")

    repeated = keys.where("times > 1").select("k1", "k2")
    single = src
    if not repeated.isEmpty():
        few = checked_broadcast(repeated)
        single = src.join(few, ["k1", "k2"], "left_anti").unionByName(src.join(few, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]))
    own = in_band(single.withColumns({"n_chars": F.length("text").cast("long"), "terms": terms_of(F.col("text"))}), words, ["k1", "k2"], most=most)
    own = own.select("k1", "k2", "doc_id", "n_chars", "text", fingerprint_of(F.col("terms")).alias("fingerprint"))

    # each document sends what its predecessor needs of it; both joins shuffle the texts alike, which Spark does once
    half = lambda c: F.floor(F.col(c) / 2)
    head = F.substring("text", F.lit(1), F.least(half("p_chars"), F.col("n_chars")).cast("int"))
    heads = own.join(pairs, ["k1", "k2"]).select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), head.alias("head"), F.col("fingerprint").alias("next"), F.col("doc_id").alias("next_id"))
    met = own.join(heads, ["k1", "k2"])
    kept = F.substring("text", F.lit(1), (F.col("n_chars") - half("n_chars")).cast("int"))
    met = met.select("k1", "k2", "doc_id", "n_chars", F.concat(kept, "head").alias("edited"), "fingerprint", "next", "next_id")
    met = in_band(met.withColumn("terms", terms_of(F.col("edited"))), words, ["k1", "k2"], most=most)
    met = met.withColumn("edited_fingerprint", fingerprint_of(F.col("terms")))
    out = met.select(
        "k1",
        "k2",
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
        "next_id",
    )
    if repeated.isEmpty():
        return out.drop("k1", "k2")
    out = cut(out, "fingerprints")
    return src.select("k1", "k2").join(out, ["k1", "k2"]).drop("k1", "k2")
