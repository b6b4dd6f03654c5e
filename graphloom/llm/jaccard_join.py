"""Exact Jaccard self-join on word shingles: who is linked, through whom, at 0.8 or more.

Two sets that are similar enough share an element among the first (1 - t) of either in any
common order (prefix filter), and their sizes differ by at most 1/t. So the prefix elements,
frequent ones last, are postings in tiles (element, size band): a document is at home in its
band and visits the next lower one. Within tiles, pairs are bounded from above by the bit
counts of hashed bitmaps, then decided by intersecting the sorted arrays.

Copies never meet as pairs: documents with equal sets are one class. Nor does a large group of
near copies give a row for each pair. First every member of a tile is compared with a few anchors
only, which joins most of a dense group into one component. Small tiles that still hold several
components are then compared pair by pair; large ones in blocks of bitmaps, and each member tells
no more than the cluster of components that its possible partners make; inside a cluster the
sorted arrays decide, and only links that join two components come out. So every step makes rows
in proportion to its members, and the components are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from graphloom.llm.shingles import WIDTH, mix, shingle_sets
from graphloom.llm.workers import tidy
from graphloom.operators.components import connected_components
from graphloom.session import checked_broadcast, cut

PERCENT = 80
#: Bitmaps have the power of two of bits from eight times the set size on, so about a tenth of them is set.
LEAST_BITS = 64
#: Elements ordered by frequency; the order steers cost only, never the result.
FREQUENT = 50_000
#: Rows of a task among which they are counted at once, about.
COUNTED = 10_000
#: Anchors per tile in the rounds before tiles and clusters are compared in blocks.
ANCHORS = (1, 16)
#: Members of a block, and bytes of bitmaps or arrays in it, about.
BLOCK, BLOCK_BYTES = 2048, 16 << 20
#: Tiles of at most so many members are compared pair by pair, so a member meets no more than these.
SMALL = 64


def _least(n: int, percent: int) -> int:
    """Fewest common elements of a set of n with any similar one."""
    return -(-percent * n // 100)


def _class_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    with np.errstate(over="ignore"):
        return tuple(int(x) for x in np.array([mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64)], np.uint64).view(np.int64))


def bitmap(s: np.ndarray) -> bytes:
    """Hashed bitmap signature of a set."""
    bits = np.zeros(max(LEAST_BITS, 1 << (8 * len(s)).bit_length()), np.uint8)
    bits[(s & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _sketches(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per row: id, set size, class key; on one row in some COUNTED the prefix elements met twice in these."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, keys, heads = [], [], [], []
        schema = None

        def counted() -> pa.RecordBatch:
            seen, counts = np.unique(np.concatenate([*heads, np.zeros(0, np.uint64)]), return_counts=True)
            often = counts > 1
            lists = [[] for _ in sizes]
            lists[0] = [{"e": int(e), "n": int(n)} for e, n in zip(seen[often].view(np.int64), counts[often], strict=True)]
            columns = [
                *pa.Table.from_batches(ids, schema).combine_chunks().to_batches()[0].columns,
                pa.array(sizes, pa.int64()),
                pa.array([k[0] for k in keys], pa.int64()),
                pa.array([k[1] for k in keys], pa.int64()),
                pa.array(lists, pa.list_(pa.struct([("e", pa.int64()), ("n", pa.int64())]))),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n", "k1", "k2", "often"])

        for batch in batches:
            own = batch.select([0, 2])
            schema = own.schema
            ids.append(own)
            for s in shingle_sets(batch.column(1), width):
                sizes.append(len(s))
                keys.append(_class_key(s))
                heads.append(s[: len(s) - _least(len(s), percent) + 1].copy())
            if len(sizes) >= COUNTED:
                yield counted()
                ids, sizes, keys, heads = [], [], [], []
        if sizes:
            yield counted()

    return docs.mapInArrow(run, "doc_id long, text_hash long, n long, k1 long, k2 long, often array<struct<e:long,n:long>>")


def _prefixes(docs: DataFrame, frequent: list[int], width: int, percent: int) -> DataFrame:
    """Class key, size, longer prefix in the order rare (by hash) before frequent (rarer first), and how many of it are rare.

    A class comes once from each task that holds a copy of it. The prefix has n // 10 elements
    more than the filter needs, see ``_shared``.
    """
    values = np.array(frequent, np.int64).view(np.uint64)
    order = np.argsort(values)
    shared = docs.sparkSession.sparkContext.broadcast((values[order], order))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            sizes, keys, heads, rare = [], [], [], []
            for s in shingle_sets(batch.column(1), width):
                key = _class_key(s)
                if not len(s) or key in seen:
                    continue
                seen.add(key)
                sizes.append(len(s))
                keys.append(key[0])
                p = len(s) - _least(len(s), percent) + 1 + len(s) // 10
                cold = len(s)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    hot = known[at] == s
                    if hot.any():
                        s = np.concatenate([s[~hot], s[hot][np.argsort(-rank[at[hot]])]])
                        cold = len(s) - int(hot.sum())
                heads.append(s[:p].copy())
                rare.append(min(cold, len(heads[-1])))
            offsets = np.concatenate([[0], np.cumsum([len(h) for h in heads])]).astype(np.int32)
            flat = np.concatenate([*heads, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(rare, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["k1", "n", "rare", "prefix"],
            )

    return docs.mapInArrow(run, "k1 long, n long, rare long, prefix array<long>")


def _shared(heads: DataFrame, percent: int) -> DataFrame:
    """Postings (e, k1, n, pos) of the prefix filter that can lead to a link.

    An element that a single class has leads nowhere. Frequent ones are taken to be shared without
    looking, so that no element of very many rows is gathered in one place; the rare ones are
    compared in a window. With k more elements in both prefixes, similar sets have k + 1 of them in
    common. So a class of which fewer prefix elements than that are shared has no links: that
    settles those that share a chance shingle or two, without looking at pairs.
    """
    by_element = Window.partitionBy("e")
    postings = heads.select("k1", "n", "rare", F.posexplode("prefix").alias("pos", "e"))
    rare = postings.where("pos < rare").withColumn("lo", F.min("k1").over(by_element)).withColumn("hi", F.max("k1").over(by_element)).where("lo != hi").select("e", "k1", "n", "pos")
    twice = cut(rare.union(postings.where("pos >= rare").select("e", "k1", "n", "pos")).distinct(), "twice")
    least = F.expr(f"({percent} * n + 99) DIV 100")
    fewest = F.floor(least / 10) + 1  # the partner may be the smaller one
    able = twice.groupBy("k1", "n").agg(F.countDistinct("e").alias("m")).where(F.col("m") >= fewest).select("k1")
    return twice.where(F.col("pos") <= F.col("n") - least).join(checked_broadcast(cut(able, "able")), "k1", "left_semi")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """Per row: id, class key, bitmap and sorted array."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, maps, arrays = [], [], []
            for s in shingle_sets(batch.column(1), width):
                keys.append(_class_key(s))
                maps.append(bitmap(s))
                arrays.append(s.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(maps, pa.binary()), pa.array(arrays, pa.binary())],
                names=["doc_id", "k1", "k2", "bits", "elements"],
            )

    return docs.mapInArrow(run, "doc_id long, k1 long, k2 long, bits binary, elements binary")


def _only(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Bits that only x has and that only y has, after folding the wider map onto the narrower."""
    if len(x) > len(y):
        x = np.bitwise_or.reduce(x.reshape(-1, len(y)), axis=0)
    elif len(y) > len(x):
        y = np.bitwise_or.reduce(y.reshape(-1, len(x)), axis=0)
    both = int(np.bitwise_count(x & y).sum())
    return int(np.bitwise_count(x).sum()) - both, int(np.bitwise_count(y).sum()) - both


@F.pandas_udf(LongType())
def overlap_bound(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
    """Most elements two sets can share: a bit that only one has set is an element the other lacks."""
    only = np.array([_only(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    return pd.Series(np.minimum(n_a.to_numpy() - only[:, 0], n_b.to_numpy() - only[:, 1]))


@F.pandas_udf(LongType())
def overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    """Common elements of two ascending arrays of 64-bit values."""
    read = lambda x: np.frombuffer(x, np.uint64)
    return pd.Series([len(np.intersect1d(read(x), read(y), assume_unique=True)) for x, y in zip(a, b, strict=True)], dtype="int64")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b, n_a, n_b) that are linked: bitmap bound first, exact intersection after."""
    enough = lambda common: 100 * common >= percent * (F.col("n_a") + F.col("n_b") - common)
    side = lambda x, what: sets.select(F.col("rep").alias(x), F.col(what).alias(f"{what}_{x}"))
    near = pairs.join(side("a", "bits"), "a").join(side("b", "bits"), "b").where(enough(overlap_bound("bits_a", "bits_b", "n_a", "n_b"))).drop("bits_a", "bits_b")
    near = cut(near, "near")
    both = near.join(side("b", "elements"), "b").join(side("a", "elements"), "a")
    return both.withColumn("common", overlap("elements_a", "elements_b")).where(enough(F.col("common"))).select("a", "b").distinct()


def _possible(x: np.ndarray, n: np.ndarray, c: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int, reach: np.ndarray | None = None, home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (left, right) of different components that the bitmap bound and the sizes let through.

    ``reach`` is how many elements each set has from the tile's on; pairs of which neither is at
    ``home`` in the tile meet in another one.
    """
    bits = np.bitwise_count(x).sum(axis=1, dtype=np.int64)
    step = max(1, (1 << 19) // max(1, len(right) * x.shape[1]))
    out = []
    for k in range(0, len(left), step):
        i, j = left[k : k + step, None], right[None, :]
        need = -(-percent * (n[i] + n[j]) // (100 + percent))
        fit = (c[i] != c[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        if reach is not None:
            fit &= (home[i] | home[j]) & (reach[i] >= need) & (reach[j] >= need)
        both = np.bitwise_count(x[i[:, 0], None, :] & x[None, right, :]).sum(axis=2, dtype=np.int64)
        fit &= np.minimum(n[i] - bits[i] + both, n[j] - bits[j] + both) >= need
        a, b = np.nonzero(fit)
        out.append(np.stack([left[k + a], right[b]]))
    return tuple(np.concatenate([*out, np.zeros((2, 0), np.int64)], axis=1).astype(np.int64))


def _maps(column: pd.Series) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, folded to the width of the narrowest."""
    least = min(map(len, column))
    return np.stack([np.bitwise_or.reduce(np.frombuffer(b, np.uint64).reshape(-1, least // 8), axis=0) for b in column])


def lowest(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Of each of the nodes 0..n-1, the smallest node that edges (x, y) connect it with."""
    label = np.arange(n)
    while True:
        u, v = label[x], label[y]
        cross = u != v
        if not cross.any():
            return label
        np.minimum.at(label, np.maximum(u, v)[cross], np.minimum(u, v)[cross])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _blocked(rows: DataFrame, keys: list[str], inside: Column, weight: Column) -> DataFrame:
    """``rows`` once for each pair of blocks (i, j) of its group that it belongs to; own is its block.

    Members that are ``inside`` (one component) need not meet each other, so their blocks come first and
    only pairs with a block of others are made. ``weight`` is a row's bytes.
    """
    blocks = lambda which: F.greatest(F.ceil(F.count_if(which) / BLOCK), F.ceil(F.sum(F.when(which, weight).otherwise(0)) / BLOCK_BYTES)).cast("int")
    sizes = rows.groupBy(*keys).agg(blocks(inside).alias("n_in"), blocks(~inside).alias("n_out"))
    rows = rows.join(checked_broadcast(cut(sizes, "sizes")), keys)
    h = F.xxhash64("rep", F.lit(7))
    own = F.when(inside, F.pmod(h, F.greatest("n_in", F.lit(1)))).otherwise(F.col("n_in") + F.pmod(h, F.greatest("n_out", F.lit(1)))).cast("int")
    rows = rows.withColumn("own", own)
    others = F.sequence(F.when(inside, F.col("n_in")).otherwise(F.lit(0)), F.col("n_in") + F.col("n_out") - 1)
    every = F.transform(others, lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    return rows.where("n_out > 0").withColumn("g", F.explode(every)).select("*", "g.*").drop("g", "n_in", "n_out")


def _clusters(tiles: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(rep, c, cluster) of the classes that have a possible partner in another component; partners share a cluster.

    ``tiles`` has main: the component with the most members of its tile.
    """
    rows = _blocked(tiles, ["e", "band"], F.col("c") == F.col("main"), F.col("n") * 2).join(sets.select("rep", "bits"), "rep")

    def compare(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        n, c, rep, home, block = (t[k].to_numpy() for k in ("n", "c", "rep", "home", "own"))
        left, right = np.flatnonzero(block == key[2]), np.flatnonzero(block == key[3])
        a, b = _possible(_maps(t["bits"]), n, c, left, right, percent, n - t["pos"].to_numpy(), home)
        names, at = np.unique(c, return_inverse=True)
        label = names[lowest(at[a], at[b], len(names))]
        met = np.unique(np.concatenate([a, b]))
        return pd.DataFrame({"rep": rep[met], "c": c[met], "d": label[at[met]]})

    met = rows.select("e", "band", "i", "j", "own", "home", "rep", "n", "pos", "c", "bits").groupBy("e", "band", "i", "j").applyInPandas(compare, "rep long, c long, d long")
    met = cut(met.distinct(), "met")
    joined = connected_components(met.select(F.col("c").alias("a"), F.col("d").alias("b")).distinct())
    return met.select("rep", "c").distinct().join(joined.select(F.col("id").alias("c"), F.col("component").alias("cluster")), "c")


def _forest(clusters: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) inside clusters (rep, c, cluster) that join their components as all links do."""
    rows = clusters.join(sets.select("rep", "bits", "elements"), "rep").withColumn("n", F.expr("length(elements) DIV 8"))
    rows = cut(rows, "members")
    main = rows.groupBy("cluster", "c").count().groupBy("cluster").agg(F.max_by("c", F.struct("count", "c")).alias("main"))
    rows = _blocked(rows.join(checked_broadcast(cut(main, "main")), "cluster"), ["cluster"], F.col("c") == F.col("main"), F.length("elements") + F.length("bits"))

    def compare(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        n, c, rep, block = (t[k].to_numpy() for k in ("n", "c", "rep", "own"))
        left, right = np.flatnonzero(block == key[1]), np.flatnonzero(block == key[2])
        a, b = _possible(_maps(t["bits"]), n, c, left, right, percent)
        if key[1] == key[2]:
            a, b = a[a < b], b[a < b]
        sets = [np.frombuffer(e, np.uint64) for e in t["elements"]]
        root = {x: x for x in c.tolist()}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        links = []
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            u, v = find(c[i]), find(c[j])
            if u != v:
                common = len(sets[i]) + len(sets[j]) - len(np.union1d(sets[i], sets[j]))
                if 100 * common >= percent * (n[i] + n[j] - common):
                    root[max(u, v)] = min(u, v)
                    links.append((rep[i], rep[j]))
        return pd.DataFrame(links, columns=["a", "b"])

    return rows.select("cluster", "i", "j", "own", "rep", "n", "c", "bits", "elements").groupBy("cluster", "i", "j").applyInPandas(compare, "a long, b long")


def _band(n: Column, percent: int) -> Column:
    return F.floor(F.log(n) / float(np.log(100 / percent)) + 1e-9)


def jaccard_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, with_hash: bool = False) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id; ``with_hash`` adds text_hash (xxhash64 of the text).

    Documents are linked when 100 * |A & B| >= percent * |A | B| for their sets of distinct
    ``width``-word shingles (fewer words: the whole sequence is the one shingle). component_id is
    the smallest doc_id reachable over links, the document's own included.

    A null or empty text, or one without words, has an empty set: n_shingles 0, linked with
    nothing, its own id. Repeated rows and rows that share an id come out once each, judged by their
    own texts; ids are whole
    numbers (others fail or, outside ANSI mode, become null).
    Rows with a null id are classed by their set but link nothing on their own (component_id
    null unless a row with an id has the same set). Other columns are not read. An empty table
    gives an empty result. Shingles are compared by 64-bit hashes; classes are sets of one 128-bit
    hash, linked by its first half.
    """
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"), F.xxhash64(text).alias("text_hash"))
    sketches = cut(_sketches(src, width, percent), "sketches")
    often = sketches.select(F.explode("often").alias("o")).groupBy("o.e").agg(F.sum("o.n").alias("n"))
    frequent = [r[0] for r in often.orderBy(F.desc("n"), "e").limit(FREQUENT).select("e").collect()]
    classes = cut(sketches.where(F.col("n") > 0).groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id")), "classes")

    named = classes.where(F.col("doc_id").isNotNull()).select("doc_id", "k1", "k2")
    met = cut(_shared(_prefixes(src, frequent, width, percent), percent).join(named.select("k1"), "k1", "left_semi").select("e", F.col("k1").alias("rep"), "n", "pos"), "met")
    # one row's text for each class; where its id has other texts too, the class's key says which is meant
    able = checked_broadcast(cut(named.join(met.select(F.col("rep").alias("k1")).distinct(), "k1"), "able"))
    sets = _sets(src.join(able.select("doc_id").distinct(), "doc_id", "left_semi"), width).join(able, ["doc_id", "k1", "k2"], "left_semi")
    sets = cut(sets.dropDuplicates(["k1"]).select(F.col("k1").alias("rep"), "bits", "elements"), "sets")
    joined = cut(connected_components(_links(met, sets, percent)).select(F.col("id").alias("k1"), "component").join(named, "k1"), "joined")
    least = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    component = classes.join(joined.join(least, "component").select("k1", "component_id"), "k1", "left").select("k1", "k2", F.coalesce("component_id", "doc_id").alias("component"))
    return sketches.select("doc_id", "text_hash", "n", "k1", "k2").join(component, ["k1", "k2"], "left").select(
        *(["text_hash"] if with_hash else []),
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")
    )


def _mixed(tiles: DataFrame, links: DataFrame | None) -> DataFrame:
    """``tiles`` with each class's component by the links so far (c), without tiles in which no two components meet; main is the largest there, size the tile's."""
    tiles = tiles.select("e", "band", "home", "rep", "n", "pos")
    if links is None:
        now = tiles.withColumn("c", F.col("rep"))
    else:
        labels = connected_components(links, stop_after=2).withColumnRenamed("id", "rep")
        now = tiles.join(checked_broadcast(labels), "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")
    per = now.groupBy("e", "band", "c").agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("v"))
    per = per.groupBy("e", "band").agg(
        *[F.sum(x).alias(y) for x, y in (("h", "h"), ("v", "v"), (F.col("h") * F.col("h"), "hh"), (F.col("h") * F.col("v"), "hv"))], F.max_by("c", F.struct(F.col("h") + F.col("v"), "c")).alias("main"), F.sum(F.col("h") + F.col("v")).alias("size")
    )
    left = (F.col("h") * F.col("h") - F.col("hh")) / 2 + F.col("h") * F.col("v") - F.col("hv")
    return cut(now.join(checked_broadcast(cut(per.where(left > 0).select("e", "band", "main", "size"), "left")), ["e", "band"]), "tiles")


def _links(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes that give the components of all links."""
    band = _band(F.col("n"), percent)
    tiles = met.select("e", "rep", "n", "pos", F.explode(F.array(band, band - 1)).alias("band"), band.alias("own")).select("e", "band", (F.col("band") == F.col("own")).alias("home"), "rep", "n", "pos")
    links = None
    for k, anchors in enumerate((*ANCHORS, None)):
        tiles = _mixed(tiles, links)
        home = tiles.where("home")
        if anchors is None:
            home = home.where(F.col("size") <= SMALL)
        else:
            turn = F.row_number().over(Window.partitionBy("e", "band").orderBy(F.xxhash64("rep", F.lit(k)), "rep"))
            home = home.withColumn("turn", turn).where(F.col("turn") <= anchors)
        found = cut(_verified(cut(_pairs(tiles, home, percent), "pairs"), sets, percent), "links")
        links = found if links is None else links.union(found)
    large = tiles.where(F.col("size") > SMALL)
    return links.union(cut(_forest(cut(_clusters(large, sets, percent), "clusters"), sets, percent), "links"))


def _pairs(tiles: DataFrame, home: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b, n_a, n_b) of tile members of different components with some of those at home there.

    Their sizes can be similar, with room for enough common elements from the first common one on.
    """
    home = home.select("e", "band", F.col("rep").alias("s"), F.col("n").alias("n_s"), F.col("c").alias("c_s"), F.col("pos").alias("pos_s"))
    need = F.ceil(percent * (F.col("n") + F.col("n_s")) / float(100 + percent) - 1e-9)
    similar = (100 * F.least("n", "n_s") >= percent * F.greatest("n", "n_s")) & (F.col("pos") <= F.col("n") - need) & (F.col("pos_s") <= F.col("n_s") - need)
    both = tiles.join(home, ["e", "band"]).where((F.col("c") != F.col("c_s")) & similar)
    low, high = F.least(F.struct("rep", "n"), F.struct(F.col("s").alias("rep"), F.col("n_s").alias("n"))), F.greatest(F.struct("rep", "n"), F.struct(F.col("s").alias("rep"), F.col("n_s").alias("n")))
    return both.select(low.alias("x"), high.alias("y")).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b")).distinct()
