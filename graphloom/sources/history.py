"""Blame: who last changed the lines of a symbol, by an interval join of line ranges with hunks.

Files of up to FILE_ROWS ranges and hunks are dealt out whole, and their ranges meet their hunks in Arrow, PAIRS pairs at a time: no pair and
no set of authors is ever shuffled. Larger files, of which there are few for the rows, spread over tasks by bins of lines.

Ranges and hunks have levels: bins of a level are wider than they are long, by a power of two, so each stands in one or two. A pair
meets in the bins of the greater of its two levels; a side stands in those of its own level and of every greater
one that the other side has. So a range or hunk of a million lines is a few rows, and no task compares all
hunks of a file with all of its symbols.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from graphloom.session import TASK_ROWS, checked_broadcast, cut

#: Levels are multiples of this: fewer rows of each side, for bins up to eight times as wide.
STEP = 3
#: Ranges and hunks of a file that one task takes whole, at most.
FILE_ROWS = 100_000
#: Pairs of a range and a hunk that a task holds at a time, unless one range has more.
PAIRS = 1_000_000


def _level(first: str, last: str) -> Column:
    return (F.ceil(F.length(F.bin(F.col(last) - F.col(first))) / STEP) * STEP).cast("int")


def _standing(rows: DataFrame, first: str, last: str, own: str, others: list[int]) -> DataFrame:
    """A row for each bin (level, bin) in which a row stands, at its own level and at those of ``others`` that are greater."""
    greater = F.filter(F.array(*[F.lit(x) for x in others]).cast("array<int>"), lambda x: x > F.col(own))
    rows = rows.withColumn("level", F.explode(F.concat(F.array(own), greater)))
    at = lambda c: F.call_function("shiftright", c, "level")
    return rows.withColumn("bin", F.explode(F.array_distinct(F.array(at(first), at(last)))))


def overlaps(ranges: DataFrame, hunks: DataFrame) -> DataFrame:
    """Pairs of a range (file, id, first, last) and a hunk (file, from, to, author, email, at) with lines in common.

    Columns: file, id, first, last, author, email, at, lines (the number in common). Lines are whole numbers from 0;
    ranges with a null or reversed end, and null files, meet nothing.
    """
    asked = ranges.where("first <= last").select("file", "id", "first", "last", _level("first", "last").alias("asks"))
    placed = hunks.where("`from` <= `to`").select("file", "from", "to", "author", "email", "at", _level("from", "to").alias("holds"))
    # at most 22 numbers each
    asks, holds = (sorted(r[0] for r in side.select(level).distinct().collect()) for side, level in ((asked, "asks"), (placed, "holds")))
    met = _standing(asked, "first", "last", "asks", holds).join(_standing(placed, "from", "to", "holds", asks), ["file", "level", "bin"])
    shared = F.least("last", "to") - F.greatest("first", "from") + 1
    # a pair that meets at several levels or in several bins counts at the greater of its own levels, in the first bin
    start = F.greatest(F.call_function("shiftright", "first", "level"), F.call_function("shiftright", "from", "level"))
    once = (F.col("level") == F.greatest("asks", "holds")) & (F.col("bin") == start)
    return met.where((shared > 0) & once).select("file", "id", "first", "last", "author", "email", "at", shared.alias("lines"))


def _pairs(first: np.ndarray, last: np.ndarray, a: np.ndarray, z: np.ndarray):
    """Numbers (range, hunk) of all pairs with lines in common, in pieces by ranges; hunks of about one length are searched together."""
    kinds = np.frexp((z - a).astype(float))[1] // 2
    sides = []
    for kind in np.unique(kinds):
        own = np.flatnonzero(kinds == kind)
        own = own[np.argsort(a[own])]
        low = np.searchsorted(a[own], first - (z - a)[own].max())
        sides.append((own, low, np.searchsorted(a[own], last, "right") - low))
    ends = np.cumsum(sum(n for _, _, n in sides))
    i = 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
        met = []
        for own, low, n in sides:
            n = n[i:j]
            r = np.repeat(np.arange(i, j), n)
            h = own[np.arange(len(r)) + np.repeat(low[i:j] - np.cumsum(n) + n, n)]
            met.append(np.stack([r, h])[:, z[h] >= first[r]])
        yield np.concatenate(met, axis=1)
        i = j


def _blamed_file(asked: pa.Table, known: pa.Table) -> pa.Table:
    """``blamed`` of the ranges and hunks of one file."""
    names = ["file", "id", "last_author", "author_email", "changed_at", "authors", "lines"]
    types = [asked["file"].type, asked["id"].type, known["author"].type, known["email"].type, known["at"].type, pa.int64(), pa.int64()]
    if not len(asked) or not len(known):
        return pa.schema(list(zip(names, types, strict=True))).empty_table()
    file = asked["file"][0]
    asked = asked.group_by(["id", "first", "last"], use_threads=False).aggregate([])
    ids = asked["id"].combine_chunks().dictionary_encode(null_encoding="encode")
    code = ids.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    code = code[order].astype(np.int64)
    first, last = (asked[c].to_numpy()[order].astype(np.int64) for c in ("first", "last"))
    # a later hunk, or a greater name, has the greater number
    known = known.take(pc.sort_indices(known, sort_keys=[(c, "ascending") for c in ("at", "author", "email")], null_placement="at_start"))
    a, z = (known[c].to_numpy().astype(np.int64) for c in ("from", "to"))
    who = known["author"].combine_chunks().dictionary_encode()
    one, who = len(who.dictionary), who.indices.to_numpy()
    latest, authors, lines = np.full(len(ids.dictionary), -1), np.zeros(len(ids.dictionary), np.int64), np.zeros(len(ids.dictionary), np.int64)
    open_ = np.zeros(0, np.int64)  # (id, author) of the last id, which may go on
    for r, h in _pairs(first, last, a, z):
        np.maximum.at(latest, code[r], h)
        np.add.at(lines, code[r], np.minimum(last[r], z[h]) - np.maximum(first[r], a[h]) + 1)
        found = np.unique(np.concatenate([open_, code[r] * one + who[h]]))
        end = np.searchsorted(found, found[-1] // one * one) if len(found) else 0
        authors += np.bincount(found[:end] // one, minlength=len(authors))
        open_ = found[end:]
    authors += np.bincount(open_ // one, minlength=len(authors))
    met = np.flatnonzero(latest >= 0)
    last_ = known.take(latest[met])
    columns = [pa.repeat(file, len(met)), ids.dictionary.take(pa.array(met)), last_["author"], last_["email"], last_["at"], pa.array(authors[met]), pa.array(lines[met])]
    return pa.table([c.cast(t) for c, t in zip(columns, types, strict=True)], names)


def blamed(ranges: DataFrame, hunks: DataFrame) -> DataFrame:
    """(file, id, last_author, author_email, changed_at, authors, lines) of every range that hunks touch.

    The last author is that of the latest hunk, of several at one time the greatest name. authors counts the distinct
    ones, lines adds up the lines that hunks have in common with the range. Null authors are no one; a repeated range counts once,
    different ranges of one id are one. Files, ids and times are plain values.
    """
    asked = ranges.where("file IS NOT NULL AND first <= last").select("file", "id", "first", "last")
    known = hunks.where("file IS NOT NULL AND author IS NOT NULL AND `from` <= `to`").select("file", "from", "to", "author", "email", "at")
    sizes = cut(asked.select("file").union(known.select("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n")), "sizes")
    total, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    tasks = max(-(-total // TASK_ROWS), ranges.sparkSession.sparkContext.defaultParallelism)
    large = checked_broadcast(sizes.where(F.col("n") > FILE_ROWS).select("file"))
    whole = lambda df: (df if most <= FILE_ROWS else df.join(large, "file", "left_anti")).repartition(tasks, "file").groupBy("file")
    a, h = asked.schema, known.schema
    kinds = [("file", a["file"]), ("id", a["id"]), ("last_author", h["author"]), ("author_email", h["email"]), ("changed_at", h["at"])]
    schema = StructType([*[StructField(name, f.dataType) for name, f in kinds], StructField("authors", LongType()), StructField("lines", LongType())])
    found = whole(asked).cogroup(whole(known)).applyInArrow(_blamed_file, schema)
    if most <= FILE_ROWS:
        return found
    spread = lambda df: df.join(large, "file", "left_semi")
    return found.union(_blamed_lines(spread(asked).distinct(), spread(known)))


def _blamed_lines(ranges: DataFrame, hunks: DataFrame) -> DataFrame:
    """``blamed`` of distinct ranges, over files of any size."""
    # a range's rows are folded where the bins meet and dealt out once; its distinct authors are one array
    last, authors = F.max(F.struct("at", "author", "email")), F.size(F.collect_set("author")).cast("long")
    found = overlaps(ranges, hunks).groupBy("file", "id").agg(last.alias("x"), authors.alias("authors"), F.sum("lines").alias("lines"))
    return found.select("file", "id", F.col("x.author").alias("last_author"), F.col("x.email").alias("author_email"), F.col("x.at").alias("changed_at"), "authors", "lines")
