"""Best-fit packing: length patterns fitted to the histogram by non-negative least squares.

The lengths of all pieces make a histogram of at most ``capacity`` bins, whatever the corpus
size. Patterns of a few lengths that fill a sequence are enumerated over it, their repeat counts
are fitted to it by non-negative least squares and rounded down, and what is left is packed
best-fit on the histogram. The plan says which ranks of each length go where; every piece then
finds its sequence from its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import json
import threading
import time
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.workers import release, tidy
from graphloom.operators.ordered import free_name, running_sum
from graphloom.session import cut

CAPACITY = 4096
END = 1
#: Words, and bytes of them, whose token ids a Python worker keeps; when full, only the words of the texts at hand stay.
CACHE, CACHE_BYTES = 600_000, 24 << 20
#: Seconds without a task after which a worker gives that memory back.
IDLE = 5.0
#: (least fill of a pattern, share of its fitted count) of the roundings tried; later ones leave more to the residue.
ROUNDINGS = ((0.995, 1.0), (1.0, 1.0), (1.0, 0.5), (1.0, 0.25), (1.0, 0.125))

_words: dict[str, dict[bytes, bytes]] = {}
_kept: dict[str, int] = {}
_used: dict[str, float] = {}


@lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _parts(text: bytes) -> list[bytes]:
    """White-space separated parts, lower-cased as the tokenizer does.

    Texts that could hold a special token, or accents that compose with capitals differently, keep
    their case.
    """
    if not (b"<|" in text or b"\xcc" in text or b"\xcd" in text):
        text = text.lower()
    return text.split()


@lru_cache(2)
def _by_word(path: str) -> bool:
    """Whether the tokenizer lower-cases, drops white space and splits there, so that texts may be encoded word by word."""
    made = json.loads(_tokenizer(path).to_str())
    normal = [n["type"] for n in (made["normalizer"] or {}).get("normalizers", [])]
    splits = [(p["type"], p.get("behavior"), p.get("invert")) for p in (made["pre_tokenizer"] or {}).get("pretokenizers", [])]
    return normal == ["NFC", "Replace", "Lowercase"] and splits == [("Split", "Removed", True), ("ByteLevel", None, None)] and made["post_processor"] is None


@lru_cache(2)
def _final(path: str) -> np.ndarray:
    """Marks the ids that end a word; empty for vocabularies without word ends."""
    suffix = json.loads(_tokenizer(path).to_str())["model"].get("end_of_word_suffix")
    vocabulary = _tokenizer(path).get_vocab(with_added_tokens=True)
    final = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
    final[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
    return final


def _encode(words: list[bytes], path: str) -> list[bytes]:
    """Ids of each word. Words of letters alone go through the tokenizer as one text, cut again at the ids that end a word."""
    out: list[bytes] = [b""] * len(words)
    text = [w.decode() for w in words]
    plain = [i for i, w in enumerate(text) if w.isalpha()]
    ids = np.array(_tokenizer(path).encode_batch_fast([" ".join([text[i] for i in plain])], add_special_tokens=False)[0].ids, "<u4")
    ends = np.flatnonzero(_final(path)[ids]) + 1
    if len(ends) == len(plain) and (not len(ids) or ends[-1] == len(ids)):
        at, whole = (4 * ends).tolist(), ids.tobytes()
        for i, a, b in zip(plain, [0, *at], at, strict=False):
            out[i] = whole[a:b]
        rest = sorted(set(range(len(words))) - set(plain))
    else:
        rest = list(range(len(words)))
    for i, e in zip(rest, _tokenizer(path).encode_batch_fast([text[i] for i in rest], add_special_tokens=False), strict=True):
        out[i] = array("I", e.ids).tobytes()
    return out


def all_token_ids(texts: list[bytes], path: str) -> list[bytes]:
    """Ids of whole texts as little-endian unsigned 32-bit values.

    A tokenizer that drops white space never joins across it, so a text's ids are those of its
    white-space separated parts in turn; a part met before is looked up. Other tokenizers get
    whole texts.
    """
    if not _by_word(path):
        return [array("I", e.ids).tobytes() for e in _tokenizer(path).encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
    known = _words.setdefault(path, {})
    every = [_parts(t) for t in texts]
    if len(known) > CACHE or _kept.get(path, 0) > CACHE_BYTES:
        stay = {p: known[p] for own in every for p in own if p in known}
        known.clear()
        known.update(stay)
        _kept[path] = sum(map(len, stay))
    out: list[bytes | None] = []
    later = []
    for parts in every:
        try:
            out.append(b"".join([known[p] for p in parts]))
        except KeyError:
            later.append((len(out), parts))
            out.append(None)
    if later:
        new = {p for p in set().union(*[own for _, own in later]) if p not in known}
        # a full stop or comma after a letter or digit is a word of its own
        marked = {p: p[:-1] for p in new if p[-1] in b".," and p[-2:-1].isalnum()}
        plain = list({p for p in new if p not in marked} | {w for w in marked.values() if w not in known} | {b".", b","})
        known.update(zip(plain, _encode(plain, path), strict=True))
        known.update({p: known[w] + known[p[-1:]] for p, w in marked.items()})
        _kept[path] = _kept.get(path, 0) + sum(map(len, new))
        for i, parts in later:
            out[i] = b"".join([known[p] for p in parts])
    return out


def _give_back(path: str) -> None:
    """Empty the worker's memory of words if no task uses it for IDLE seconds."""
    at = _used[path] = time.monotonic()

    def empty() -> None:
        if _used.get(path) == at:
            _words.pop(path, None)
            _kept.pop(path, None)
            release()

    later = threading.Timer(IDLE, empty)
    later.daemon = True
    later.start()


def tokenize(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids (binary, unsigned 32-bit little-endian).

    A document is its token ids and ``end``; only longer ones than ``capacity`` are cut. Null and
    empty texts are the end token alone. Rows with a null id, repeated rows and repeated ids each
    give their own pieces. ``tokenizer`` is a path that all executors can open.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    tail = np.array([end], "<u4").tobytes()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _used[tokenizer] = time.monotonic()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                row, piece, start, ids = [], [], [], []
                for k, own in enumerate(all_token_ids([t or b"" for t in part.column(1).to_pylist()], tokenizer)):
                    whole = own + tail
                    for j, at in enumerate(range(0, len(whole), 4 * capacity)):
                        row.append(k)
                        piece.append(j)
                        start.append(at // 4)
                        ids.append(whole[at : at + 4 * capacity])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )
        _give_back(tokenizer)

    return src.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def patterns(lengths: np.ndarray, capacity: int, wide: int = 6) -> list[tuple[int, ...]]:
    """Few-document patterns, longest length first: the fullest pairs, triples and quadruples that begin with each length."""
    found: set[tuple[int, ...]] = set()

    def below(room: int, most: int) -> np.ndarray:
        hi = np.searchsorted(lengths, min(room, most), "right")
        return lengths[max(0, hi - wide) : hi]

    for a in lengths:
        room = capacity - a
        found.add((int(a),) * (capacity // int(a)))
        for b in below(room, a):
            found.add((int(a), int(b)))
        hi = np.searchsorted(lengths, min(room, a), "right")
        for b in lengths[np.unique(np.linspace(0, hi - 1, wide).astype(int))] if hi else []:
            for c in below(room - b, b)[-2:]:
                found.add((int(a), int(b), int(c)))
                for d in below(room - b - c, c)[-1:]:
                    found.add((int(a), int(b), int(c), int(d)))
    return sorted((p for p in found if len(p) <= 8), key=lambda p: (sum(p), p), reverse=True)


def nnls(slots: list[tuple[int, ...]], histogram: np.ndarray, capacity: int, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that make the patterns' use of each length fit the histogram in least squares.

    Multiplicative updates, which keep x non-negative; fuller patterns start higher.
    """
    where = np.repeat(np.arange(len(slots)), [len(p) for p in slots])
    what = np.concatenate([np.array(p) for p in slots])
    fill = np.array([sum(p) for p in slots]) / capacity
    use = np.bincount(what, minlength=len(histogram))
    x = fill**64 * np.bincount(where, histogram[what] / np.maximum(use[what], 1))
    goal = np.bincount(where, histogram[what])
    for _ in range(rounds):
        now = np.bincount(what, x[where], len(histogram))
        x *= goal / np.maximum(np.bincount(where, now[what]), 1e-12)
    return x


def plan(histogram: np.ndarray, capacity: int, fitted: bool = True) -> tuple[np.ndarray, int]:
    """(entries, sequences): rows of (length, first rank, count, first sequence, offset).

    Ranks first..first+count-1 of a length go to sequences first.., one each, at the offset. The
    fitted counts are rounded once for each of ROUNDINGS; the rounding with the fewest sequences
    is the plan. Without ``fitted`` all is residue: the baseline of the tests.
    """
    lengths = np.flatnonzero(histogram)
    if not fitted or len(lengths) < 2:
        return _rounded([], np.zeros(0), histogram, capacity)
    slots = patterns(lengths, capacity)
    x = nnls(slots, histogram.astype(float), capacity)
    plans = (_rounded(slots, x * share, histogram, capacity, floor) for floor, share in ROUNDINGS)
    return min(plans, key=lambda p: p[1])


def _rounded(slots: list[tuple[int, ...]], x: np.ndarray, histogram: np.ndarray, capacity: int, floor: float = 1.0) -> tuple[np.ndarray, int]:
    """Entries and sequences of the patterns filled to ``floor`` at least, x times each rounded down, and of the residue."""
    left = histogram.astype(np.int64).copy()
    used = np.zeros_like(left)
    rows: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def place(length: int, count: int, base: int, offset: int) -> None:
        rows.append((length, int(used[length]), count, base, offset))
        used[length] += count
        left[length] -= count

    for p, times in zip(slots, x, strict=True):
        if sum(p) < floor * capacity:
            break  # sorted by fill: the rest is packed better as residue
        need = {n: p.count(n) for n in p}
        k = min(int(times), *(int(left[n]) // c for n, c in need.items()))
        if k > 0:
            at = 0
            for n in p:
                place(n, k, sequences, at)
                at += n
            sequences += k
    # residue, longest first, each into the fullest open sequences that have room; equal ones move together
    open_: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    for n in np.flatnonzero(left)[::-1].tolist():
        while left[n]:
            rooms = [r for r in rooms if open_.get(r)]
            fit = min((r for r in rooms if r >= n), default=0)
            if fit:
                base, count = open_[fit].pop()
                k = min(count, int(left[n]))
                if k < count:
                    open_[fit].append((base + k, count - k))
                room = fit
            else:
                each = capacity // n
                k = int(left[n]) // each
                if k:
                    for j in range(each):
                        place(n, k, sequences, j * n)
                    open_.setdefault(capacity - each * n, []).append((sequences, k))
                    rooms = sorted({*rooms, capacity - each * n} - {0})
                    sequences += k
                    continue
                base, k, room = sequences, 1, capacity
                sequences += 1
            place(n, k, base, capacity - room)
            if room > n:
                open_.setdefault(room - n, []).append((base, k))
                rooms = sorted({*rooms, room - n})
    return np.array(sorted(rows), np.int64).reshape(-1, 5), sequences


def pack(pieces: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length and any others) with sequence_id and offset.

    Lengths run from 1 to ``capacity``. Pieces of one length are interchangeable: each gets a rank by a running
    count over rows in any order, which spreads every length over tasks, also one of rows that are all alike. Other
    columns pass through, whatever their names. ``pieces`` must be a written table.
    """
    histogram = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        histogram[r["length"]] = r["n"]
    entries, _ = plan(histogram, capacity)
    row, rank = free_name(pieces.columns, "row_"), free_name(pieces.columns, "rank_")
    numbered = pieces.withColumn(row, F.monotonically_increasing_id())
    ranked = running_sum(numbered, ["length"], [F.col(row).asc()], F.lit(1), rank)
    return _placed(ranked.select(*pieces.columns, F.col(rank).cast("long").alias(rank)), rank, entries)


def _placed(ranked: DataFrame, rank_name: str, entries: np.ndarray) -> DataFrame:
    shared = ranked.sparkSession.sparkContext.broadcast(entries)  # a few entries per length at most

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def at(length: pa.Array, rank: pa.Array) -> pa.Array:
        e = shared.value
        n, r = length.to_numpy(zero_copy_only=False).astype(np.int64), rank.to_numpy(zero_copy_only=False).astype(np.int64)
        most = int(e[:, 1].max(initial=0)) + int(r.max(initial=0)) + 1
        i = np.searchsorted(e[:, 0] * most + e[:, 1], n * most + r, "right") - 1
        return pa.StructArray.from_arrays([pa.array(e[i, 3] + r - e[i, 1]), pa.array(e[i, 4])], names=["sequence_id", "offset"])

    place = free_name(ranked.columns, "at_")
    out = ranked.withColumn(place, at(F.col("length"), F.col(rank_name)))
    return out.select(*[c for c in ranked.columns if c != rank_name], f"{place}.sequence_id", f"{place}.offset")


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids, joined from ``tokenize`` and ``pack`` by (doc_id, piece).

    For corpora with unique ids; at most ``capacity`` pieces meet in a sequence.
    """
    at = placed.select("doc_id", "piece", "sequence_id", "offset")
    both = pieces.join(at, (pieces["doc_id"].eqNullSafe(at["doc_id"])) & (pieces["piece"] == at["piece"])).select("sequence_id", "offset", "ids")
    parts = both.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.expr("aggregate(p, CAST('' AS BINARY), (s, x) -> s || x.ids)").alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Placement of every piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Each sequence is filled without gaps from offset 0 and holds at most ``capacity`` tokens. Rows
    without an id are packed like others; repeated rows are packed as often as they come; an empty
    table packs into nothing. Other columns are not read.
    """
    made = tokenize(docs, tokenizer, doc_id=doc_id, text=text, capacity=capacity, end=end)
    pieces = cut(made.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return pack(pieces, capacity=capacity)
