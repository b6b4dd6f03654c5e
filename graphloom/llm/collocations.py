"""Phrase collocations by hierarchical pair naming.

A word's id stands for (language, word). Level k names pairs: where two frequent (k-1)-word phrases
stand one word apart, their ids make a pair, pairs are counted over all documents, and the frequent
ones get an id of their own, which takes their place in the texts of level k + 1. The two ids of a
pair are its phrase without the last and without the first word. Following these pointers gives
the counts of all parts for the cuts, and which shorter phrases a longer one holds.

Every level reads the texts once, sums pairs inside tasks, and sums the rest by one shuffle. Which
ids are frequent reaches the tasks as a bitmap of fixed size: an id that only shares a bit costs
rows, which the counts then drop, so beyond its capacity the result is the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.shingles import chunks, mix, slice_hashes
from graphloom.llm.workers import tidy
from graphloom.session import cut

LEAST, CONTAINED, TOP = 10, 50, 2000
#: Bits of a level's bitmap (8 MB).
BITS = 1 << 26
#: Words counted at once in a task.
FLUSH = 1 << 21

_KIND = np.zeros(256, np.uint8)  # 0 in a word, 1 between words, 2 between pieces
_KIND[[9, 32]] = 1
_KIND[[*b".,;:!?", 10, 11, 12, 13]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _hash_long(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    h = seed + _P5 + np.uint64(8)
    h = _turned(h ^ (_turned(x * _P2, 31) * _P1), 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def pair_names(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The id of each pair of ids: xxHash64 of both, as Spark's xxhash64 of two longs."""
    with np.errstate(over="ignore"):
        return _hash_long(right, _hash_long(left, np.full(len(left), 42, np.uint64)))


class Tokens:
    """The words of some texts: ids, the places of their bytes, and whether each stands in the piece of the word before."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray) -> None:
        kind = _KIND[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        word = np.concatenate([[False], kind == 0, [False]])
        starts = np.flatnonzero(word[1:-1] & (~word[:-2] | first[:-1]))
        self.data = data
        self.starts = starts
        self.ends = np.flatnonzero(word[1:-1] & (~word[2:] | first[1:])) + 1
        text = np.searchsorted(offsets, starts, "right") - 1
        self.lang = langs[text] if len(starts) else np.zeros(0, np.uint64)
        breaks = np.cumsum(kind == 2)[starts] if len(starts) else starts
        self.follows = np.zeros(len(starts), bool)
        self.follows[1:] = (text[1:] == text[:-1]) & (breaks[1:] == breaks[:-1])
        self.ids = mix(slice_hashes(data, starts, self.ends) ^ self.lang)

    def words(self, which: np.ndarray) -> pa.Array:
        """The lower-cased words at ``which``."""
        edges = np.empty(2 * len(self.starts), np.int64)
        edges[::2], edges[1::2] = self.starts, self.ends  # every other element is the gap behind a word
        every = pa.Array.from_buffers(pa.large_string(), max(0, len(edges) - 1), [None, pa.py_buffer(edges), pa.py_buffer(_LOWER[self.data])])
        return every.take(pa.array(2 * which)).cast(pa.string())


def _has(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = ids & np.uint64(64 * len(bits) - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def pairs_of(ids: np.ndarray, follows: np.ndarray, level: int, maps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Both ids of every pair of level ``level`` (from 2) in the words' order: all shorter phrases inside are in their level's map."""
    ok = _has(maps[0], ids)
    for k in range(2, level + 1):
        # position i stands for the phrase of k - 1 words that begins there
        left, right = ids[:-1], ids[1:]
        ok = ok[:-1] & ok[1:] & follows[k - 1 :]
        if k == level:
            return left[ok], right[ok]
        ids = pair_names(left, right)
        ok &= _has(maps[k - 1], ids)
    raise ValueError("pairs begin at level 2")


def _lang_ids(langs: pa.Array) -> tuple[np.ndarray, list[str]]:
    """A 64-bit value for each text's language, and the languages as text (null is 'und')."""
    names = ["und" if x is None else str(x) for x in langs.to_pylist()]
    value = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(names)}
    return np.array([value[x] for x in names], np.uint64), names


def _tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Tokens, dict[int, str]]]:
    for batch in batches:
        langs, names = _lang_ids(batch.column(1))
        by_id = dict(zip(langs.tolist(), names, strict=True))
        for i, j, data, offsets in chunks(batch.column(0)):
            yield Tokens(data, offsets, langs[i:j]), by_id


def _runs(rows: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(order, distinct rows, times) of rows given as columns. They are sorted by a mixed key; rows are told apart by their values."""
    key = rows[0] if len(rows) == 1 else mix(rows[0] * _P1 + rows[1])
    order = np.argsort(key, kind="stable")
    rows = [r[order] for r in rows]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([r[1:] != r[:-1] for r in rows], axis=0)
    at = np.flatnonzero(new)
    return order[at], [r[at] for r in rows], np.diff(np.append(at, len(order)))


def _words(rows: DataFrame) -> DataFrame:
    """(id, lang, word, f) of all words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, by_id in _tokens(batches):
            at, (ids,), times = _runs([own.ids])
            langs = pa.array([by_id[x] for x in own.lang[at].tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), langs, own.words(at), pa.array(times)], names=["id", "lang", "word", "n"])

    found = rows.mapInArrow(tidy(run), "id long, lang string, word string, n long")
    return found.groupBy("id", "lang", "word").agg(F.sum("n").alias("f"))


def _pairs(rows: DataFrame, level: int, maps: list) -> DataFrame:
    """(left, right, f) of all pairs of a level that can be frequent."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [m.value for m in maps]

        def summed(left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
            _, (a, b), times = _runs([np.concatenate(left), np.concatenate(right)])
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(times)], names=["left", "right", "n"])

        left, right, size = [], [], 0
        for own, _ in _tokens(batches):
            if len(own.ids) < level:
                continue
            a, b = pairs_of(own.ids, own.follows, level, known)
            left.append(a)
            right.append(b)
            size += len(a)
            if size > FLUSH:
                yield summed(left, right)
                left, right, size = [], [], 0
        if left:
            yield summed(left, right)

    found = rows.mapInArrow(tidy(run), "left long, right long, n long")
    return found.groupBy("left", "right").agg(F.sum("n").alias("f"))


def _bitmap(ids: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of a column of ids: at most bits / 64 rows reach the driver, however many ids there are."""
    at = F.col("id").bitwiseAND(bits - 1)
    words = ids.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(id & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _told_apart(names: DataFrame) -> None:
    """Ids are 64-bit hashes: stop if two names share one, rather than add up their counts."""
    if not names.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise RuntimeError("two phrases share an id")


def _levels(docs: DataFrame, text: str, lang: str, max_words: int, least: int, bits: int) -> tuple[DataFrame, list[DataFrame]]:
    """All words (id, lang, word, f), and the frequent phrases of each number of words with their pointers and the counts of their parts."""
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    words = cut(_words(rows), "words")
    _told_apart(words)
    none, null = F.array().cast("array<long>"), F.lit(None).cast("long")
    first = words.where(F.col("f") >= least).select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("pre"), none.alias("suf"), null.alias("left"), null.alias("right"))
    levels, maps = [cut(first, "level1")], []
    for k in range(2, max_words + 1):
        maps.append(docs.sparkSession.sparkContext.broadcast(_bitmap(levels[-1].select("id"), bits)))
        named = cut(_pairs(rows, k, maps).where(F.col("f") >= least).select(F.xxhash64("left", "right").alias("id"), "left", "right", "f"), "named")
        _told_apart(named)
        p = levels[-1].select(F.col("id").alias("left"), "lang", F.col("phrase").alias("begin"), F.array_append("pre", F.col("f")).alias("pre"))
        s = levels[-1].select(F.col("id").alias("right"), "last", F.array_append("suf", F.col("f")).alias("suf"))
        level = named.join(p, "left").join(s, "right").select("id", "lang", F.concat_ws(" ", "begin", "last").alias("phrase"), "last", "f", "pre", "suf", "left", "right")
        levels.append(cut(level, f"level{k}"))
    return words, levels


def _held(levels: list[DataFrame]) -> DataFrame:
    """lang, words, phrase, f, pre, suf and inside of all levels."""
    out = None
    for k, (own, longer) in enumerate(zip(levels, [*levels[1:], None], strict=True), 1):
        if longer is None:
            held = own.withColumn("inside", F.lit(None).cast("long"))
        else:
            most = longer.select(F.explode(F.array_distinct(F.array("left", "right"))).alias("id"), "f").groupBy("id").agg(F.max("f").alias("inside"))
            held = own.join(most, "id", "left")
        held = held.select("lang", F.lit(k).alias("words"), "phrase", "f", "pre", "suf", "inside")
        out = held if out is None else out.union(held)
    return out


def phrases(docs: DataFrame, *, text: str = "text", lang: str = "lang", max_words: int = 3, least: int = LEAST, bits: int = BITS) -> DataFrame:
    """All phrases of up to ``max_words`` words that occur ``least`` times: lang, words, phrase, f, pre, suf, inside.

    Texts are lower-cased (A-Z) and split at ``.,;:!?`` and line ends into pieces, those at blanks and tabs into
    words; occurrences may overlap. pre[j] and suf[j] count the phrase's first and last j + 1 words, inside is the
    count of the commonest phrase that is longer by a word and holds it (null: none). A null language is ``und``,
    a null text is empty; repeated rows count again; other columns are not read, whatever their names.
    """
    return _held(_levels(docs, text, lang, max_words, least, bits)[1])


def lowest_cut(a: Column, words: Column) -> Column:
    """(score, k, l, r) of the lowest-scoring cut: floor(10^6 a^2 / (l r)) in exact 38-digit arithmetic, ties to the smallest k."""
    wide = lambda c: c.cast("decimal(19,0)")
    top = (wide(a) * wide(a)).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")

    def one(k: Column) -> Column:
        left, right = F.get("pre", k - 1), F.get("suf", words - k - 1)
        below = (wide(left) * wide(right)).cast("decimal(38,0)")
        return F.struct(F.call_function("div", top, below).cast("long").alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    return F.array_min(F.transform(F.sequence(F.lit(1), words - 1), one))


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", max_words: int = 3, least: int = LEAST, contained: int = CONTAINED, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` phrases of two words or more: lang, rank, phrase, a, l, r, n, score, words.

    Ranked by score, then count, then phrase (bytes). A phrase held by a longer one that has at least
    ``contained`` per cent of its count is dropped. n is the number of the language's words. Odd inputs: see ``phrases``.
    """
    words, levels = _levels(docs, text, lang, max_words, least, BITS)
    found = _held(levels)
    kept = found.where("words > 1").where(F.col("inside").isNull() | (100 * F.col("inside") < contained * F.col("f")))
    scored = kept.withColumn("cut", lowest_cut(F.col("f"), F.col("words"))).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score", "words")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first inside parts of a language, so that no task ranks all of its phrases
    part = F.pmod(F.xxhash64("phrase"), F.lit(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    some = scored.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "words")
