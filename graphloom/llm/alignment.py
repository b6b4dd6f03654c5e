"""Cross-tokenizer alignment by a dangling-suffix transducer.

Two tokenizers cut the same bytes. The transducer's state says which side leads and by which bytes;
the next token of the side behind either eats from that residue or turns the lead around, and an
empty residue closes a group. Transitions are memoised by (state, token); groups of whole words are
memoised too, since both tokenizers cut wherever a blank follows a visible character.

A link's two tokens end at one byte, so that the shorter one is a suffix of the longer: each token
meets at most two tokens of the other side for every length. The table of linked id pairs is
therefore bounded by the vocabularies (``most_pairs``), whatever the corpus, and may be handed to every task.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.workers import tidy
from graphloom.session import cut

#: Words whose groups a Python worker keeps, twice at most, and transitions; when full, it keeps what it met since, or starts anew.
CACHE, MEMO = 200_000, 1_000_000
#: Bytes of new words given to the tokenizers at once.
ENCODE = 1 << 18

# A blank behind one of these begins a new token in both tokenizers, whatever stands around.
_VISIBLE = r"[!-~\w]"
_SPLIT = re.compile(rf"(?<={_VISIBLE})(?= )")
_OTHER = re.compile(r"[^!-~\w] ")

Word = tuple[bytes, bytes, int]  # groups as text, links as int64 pairs, (tokens of A) << 32 | tokens of B


class Transducer:
    """Aligns two token sequences over the same bytes.

    ``a`` and ``b`` map ids to bytes. ``residue`` memoises what a token makes of the leading side's unmatched bytes; a state
    is such a residue with the tokens of the open group, so that a closed group is met as a whole: its number in ``text`` (as
    text), ``link`` (its last two ids), ``size`` (bytes) and ``count`` (tokens of A << 32 | tokens of B).
    """

    def __init__(self, a: list[bytes], b: list[bytes]) -> None:
        self.sides = (a, b)
        self.forget()

    def forget(self) -> None:
        self.residue: dict[tuple[int, bytes, int], tuple[int, bytes]] = {}
        self.memo: dict[int, int] = {}
        self.states: list[tuple[int, bytes, tuple[int, ...], tuple[int, ...]]] = [(0, b"", (), ())]
        self.next_side = [0]  # whose token each state waits for: the side behind
        self.text: list[bytes] = []
        self.link: list[int] = []
        self.size: list[int] = []
        self.count: list[int] = []

    def _after(self, side: int, left: bytes, token: int) -> tuple[int, bytes]:
        """(leading side, unmatched bytes) once the side behind (A if none leads) has sent ``token``."""
        behind = 1 - side if left else 0
        new = self.sides[behind][token]
        if left.startswith(new):
            return side, left[len(new) :]
        if new.startswith(left):
            return behind, new[len(left) :]
        raise ValueError("the two sides have different bytes")

    def _step(self, state: int, token: int) -> int:
        """The state after ``token``, or ~k if it closes group k."""
        side, left, a, b = self.states[state]
        found = self.residue.get((side, left, token))
        if found is None:
            found = self.residue[side, left, token] = self._after(side, left, token)
        a, b = (a, (*b, token)) if left and side == 0 else ((*a, token), b)
        if found[1]:
            self.states.append((*found, a, b))
            self.next_side.append(1 - found[0])
            return len(self.states) - 1
        self.text.append((",".join(map(str, a)) + "|" + ",".join(map(str, b))).encode())
        self.link.append(a[-1] << 32 | b[-1])
        self.size.append(sum([len(self.sides[0][x]) for x in a]))
        self.count.append(len(a) << 32 | len(b))
        return ~(len(self.text) - 1)

    def groups(self, a: list[int], b: list[int]) -> list[int]:
        """Numbers of the groups of both sequences, valid until ``forget``: cut wherever tokens of both sides end at one byte."""
        memo, next_side, out = self.memo, self.next_side, []
        sides, state = (iter(a), iter(b)), 0
        try:
            while True:
                token = next(sides[next_side[state]])
                key = state << 20 | token
                after = memo.get(key)
                if after is None:
                    after = memo[key] = self._step(state, token)
                if after < 0:
                    out.append(~after)
                    state = 0
                else:
                    state = after
        except StopIteration:
            pass
        if state or next(sides[1], None) is not None:
            raise ValueError("the two sides have different bytes")
        return out


def _unescaped() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable bytes stand for themselves, the rest in turn from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(rest)}


class Pair:
    """A byte-level BPE vocabulary (A) and a sentencepiece model that adds a blank (B)."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of, known = _unescaped(), self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(known.values(), default=0) + 1)
        for token, i in known.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.blank = self.b.piece_to_id("▁")
        # no piece may hold a blank behind something else, a blank must be one, and A must split its text before it merges
        pre = json.loads(self.a.to_str())["pre_tokenizer"] or {}
        self.by_word = pre.get("type") == "ByteLevel" and pre.get("use_regex", False) and self.blank != self.b.unk_id() and not any(re.search("[^▁]▁", p) for p in pieces)
        self.transducer = Transducer(self.a_bytes, self.b_bytes)
        self.words: dict[str, Word | None] = {}
        self.old: dict[str, Word | None] = {}

    def tokens(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of both sides for a text that begins with a blank; a blank alone gets none from B as a text, but does as a word."""
        return self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(text[1:]) or [self.blank]

    def _alone(self, word: str) -> Word | None:
        a, b = self.tokens(word)
        raw = word.encode()
        if b"".join([self.a_bytes[x] for x in a]) != raw or b"".join([self.b_bytes[x] for x in b]) != raw:
            return None
        t = self.transducer
        found = t.groups(a, b)
        return b";".join([t.text[k] for k in found]), np.array([t.link[k] for k in found], np.int64).tobytes(), sum([t.count[k] for k in found])

    def _learn(self, words: list[str]) -> None:
        """Encode new words as one text and cut its groups at the words' ends; words that this doesn't fit are encoded alone."""
        t = self.transducer
        if len(t.memo) > MEMO:
            t.forget()
        joined = "".join(words)
        a, b = self.tokens(joined)
        raw = joined.encode()
        if self.by_word and b"".join([self.a_bytes[x] for x in a]) == raw and b"".join([self.b_bytes[x] for x in b]) == raw:
            found = t.groups(a, b)
            ends = np.cumsum([t.size[k] for k in found])
            at = np.cumsum([len(w.encode()) for w in words])
            where = np.searchsorted(ends, at)
            if np.array_equal(ends[where], at):
                texts, links = [t.text[k] for k in found], np.array([t.link[k] for k in found], np.int64).tobytes()
                counts = np.concatenate([[0], np.cumsum([t.count[k] for k in found])])
                cuts = np.concatenate([[0], where + 1])
                for w, i, j, n in zip(words, cuts[:-1].tolist(), cuts[1:].tolist(), np.diff(counts[cuts]).tolist(), strict=True):
                    self.words[w] = (b";".join(texts[i:j]), links[8 * i : 8 * j], n)
                return
        self.words.update((w, self._alone(w)) for w in words)  # a token stands over a word's end, or bytes are lost

    def parts(self, text: str) -> list[str]:
        """``text`` with its blank in front, cut before every blank behind a visible character."""
        if not self.by_word:
            return [" " + text]
        if _OTHER.search(text) or text[0] == " ":
            return _SPLIT.split(" " + text)
        return [" " + w for w in text.split(" ")]

    def align(self, texts: list[str | None]) -> Iterator[list[Word] | None]:
        """Aligned words of each text, None where it has no tokens (null, empty, or bytes that a side can't give back)."""
        every = [self.parts(t) if t else [] for t in texts]
        known = self.words
        if len(known) > CACHE:  # words met since the last time stay
            self.old, self.words = known, {}
            known = self.words
        new, size = [], 0
        for w in dict.fromkeys([w for own in every for w in own]):
            if w not in known:
                if w in self.old:
                    known[w] = self.old[w]
                    continue
                new.append(w)
                size += len(w)
                if size > ENCODE:
                    self._learn(new)
                    new, size = [], 0
        if new:
            self._learn(new)
        for own in every:
            found = [known[w] for w in own]
            yield None if not found or None in found else found


@lru_cache(1)
def _pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def most_pairs(pair: Pair) -> int:
    """A bound on the id pairs that can ever be linked: for each token and length, the tokens of the other side with those bytes."""

    def times(side: list[bytes]) -> dict[bytes, int]:
        out: dict[bytes, int] = {}
        for x in side:
            out[x] = out.get(x, 0) + 1
        return out

    a, b = times(pair.a_bytes), times(pair.b_bytes)
    shorter = lambda side, other: sum(other.get(x[k:], 0) for x in side for k in range(len(x)))
    return shorter(pair.a_bytes, b) + shorter(pair.b_bytes, a)


_ALIGNED = "doc_id {}, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>"


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about ``most`` bytes of text."""
    sizes = np.asarray(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    total, i = np.concatenate([[0], np.cumsum(sizes)]), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(total, total[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def align(docs: DataFrame, a_path: str, b_path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_a and n_b tokens, n_groups, groups_sha256, and its linked id pairs with their times.

    A pair is (A's id) << 32 | B's id. Null and empty texts, and those whose bytes a side can't give back
    (as with U+2581, which B takes for a blank), have no tokens: zeros, '' and no pairs. Long texts are whole;
    repeated rows give equal rows; null ids stay; other columns are not read, whatever their names.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(a_path, b_path)
        for batch in batches:
            for part in _slices(batch, 1 << 22):
                rows: list[tuple] = []
                for found in pair.align(part.column("text").to_pylist()):
                    if found is None:
                        rows.append((0, 0, 0, "", [], []))
                        continue
                    n = sum([w[2] for w in found])
                    links = np.frombuffer(b"".join([w[1] for w in found]), np.int64)
                    digest = hashlib.sha256(b";".join([w[0] for w in found])).hexdigest()
                    rows.append((n >> 32, n & 0xFFFFFFFF, len(links), digest, *np.unique(links, return_counts=True)))
                columns = list(zip(*rows, strict=True))
                plain = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *plain], names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(tidy(run), _ALIGNED.format(rows.schema["doc_id"].dataType.simpleString()))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, a, b, n, best): how often each id pair is linked in all documents, and whether no other pair of its B id is linked more often."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    each = each.select("pair", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), "n")
    most = each.groupBy("b").agg(F.max("n").alias("most"))
    return each.join(most, "b").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, a_path: str, b_path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document row; see ``align`` for odd inputs.

    The counts of the pairs are read on the driver and sent to the tasks: ``most_pairs`` bounds them.
    """
    aligned = cut(align(docs, a_path, b_path, doc_id=doc_id, text=text), "aligned")
    table = pair_counts(aligned).select("pair", "n", "best").orderBy("pair").toArrow()
    if table.num_rows > most_pairs(_pair(a_path, b_path)):
        raise RuntimeError("more linked pairs than the vocabularies allow")
    known = docs.sparkSession.sparkContext.broadcast([table.column(k).to_numpy() for k in ("pair", "n", "best")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = known.value
        for batch in batches:
            own, times = batch.column("pairs"), np.asarray(batch.column("times").flatten(), np.int64)
            at = np.searchsorted(pairs, np.asarray(own.flatten(), np.int64))
            sizes = np.asarray(pc.list_value_length(own), np.int64)
            ends = np.cumsum(sizes)
            total = lambda x: pa.array(np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])]).astype(np.int64))  # noqa: B023, E731
            first = [batch.column(k) for k in ("doc_id", "n_a", "n_b", "n_groups")]
            yield pa.RecordBatch.from_arrays([*first, batch.column("n_groups"), total(best[at] * times), total(counts[at] * times), batch.column("groups_sha256")], names=names)

    schema = f"doc_id {aligned.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return aligned.mapInArrow(tidy(run), schema)
