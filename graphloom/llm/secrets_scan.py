"""Secret scans: probabilistic automata inferred from labelled credentials score every candidate.

Credentials found by their labels (an assignment's name, a key prefix, a long hexadecimal run)
are the training set. Their prefix tree is turned into a probabilistic automaton by merging
states whose futures do not differ significantly (ALERGIA, Carrasco & Oncina 1994), one per
kind, and one for ordinary long tokens. A token is reported when its likelihood ratio against
the ordinary automaton, per character, is above what ordinary tokens reach.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.workers import tidy
from graphloom.session import cut

KINDS = ("assign", "access", "hex")
#: Most distinct credentials of a kind, and most ordinary tokens, that automata are inferred from (smallest hashes).
SAMPLE = 400
ORDINARY = 1_500
#: Longest credential or token in that training set; longer ones are scored and counted like others.
FIT_LENGTH = 256
#: Share of held-back ordinary tokens that may score above the threshold.
FALSE_ALARMS = 0.001
#: Bins per unit of a likelihood ratio in which the held-back tokens are counted.
BINS = 4_096

_names = "|".join("".join(f"[{c}{c.upper()}]" for c in name) for name in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
_ASSIGN = re.compile(rf"""({_names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_LONG = re.compile(r"[^\x00-\x20]{16,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def base_spans(text: str) -> list[tuple[int, str, int, str]]:
    """(start, kind, end, credential) of the labelled credentials, by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    for chunk in _LONG.finditer(text):
        at = chunk.start()
        found += [(at + m.start(), 2, at + m.end(), m[0]) for m in _HEX.finditer(chunk[0])]
    return [(a, KINDS[k], b, v) for a, k, b, v in sorted(found)]


def candidates(text: str, spans: list[tuple[int, str, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, token) of long tokens that touch no base span."""
    ends, top = [], 0
    for s in spans:
        top = max(top, s[2])
        ends.append(top)
    starts = [s[0] for s in spans]
    out = []
    for chunk in _LONG.finditer(text):
        at = chunk.start()
        for m in _TOKEN.finditer(chunk[0]):
            a, b = at + m.start(), at + m.end()
            i = bisect_right(starts, b - 1)
            if not i or ends[i - 1] <= a:
                out.append((a, b, m[0]))
    return out


_CLASS = np.full(128, 9, np.int64)
for _chars, _n in (("0123456789", 0), ("abcdef", 1), ("ghijklmnopqrstuvwxyz", 2), ("ABCDEF", 3), ("GHIJKLMNOPQRSTUVWXYZ", 4), ("_", 5), ("-", 6), ("/+", 7), ("=.", 8)):
    _CLASS[[ord(c) for c in _chars]] = _n
SYMBOLS = 10


def symbols(token: str) -> list[int]:
    return _CLASS[np.minimum(np.frombuffer(token.encode("ascii", "replace"), np.uint8), 127)].tolist()


@dataclass
class Automaton:
    """next[state][symbol] (-1: none), logp[state][symbol] and end[state]: log probabilities, smoothed."""

    next: list[list[int]]
    logp: list[list[float]]
    end: list[float]
    floor: float

    def score(self, word: list[int]) -> float:
        """Log likelihood; from a state without a matching arc on, every symbol costs the floor."""
        state, total = 0, 0.0
        for k, s in enumerate(word):
            if state < 0:
                return total + self.floor * (len(word) - k + 1)
            total += self.logp[state][s]
            state = self.next[state][s]
        return total + (self.end[state] if state >= 0 else self.floor)


def infer(words: list[list[int]], alpha: float = 0.05) -> Automaton:
    """Merge statistically compatible states of the words' prefix tree, red-blue order."""
    arcs: list[dict[int, int]] = [{}]
    times: list[dict[int, int]] = [{}]
    ends, seen = [0], [0]
    for w in words:
        q = 0
        seen[0] += 1
        for s in w:
            if s not in arcs[q]:
                arcs[q][s] = len(arcs)
                arcs.append({})
                times.append({})
                ends.append(0)
                seen.append(0)
            times[q][s] = times[q].get(s, 0) + 1
            q = arcs[q][s]
            seen[q] += 1
        ends[q] += 1
    slack = float(np.sqrt(0.5 * np.log(2 / alpha)))

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > slack * (n1**-0.5 + n2**-0.5)

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            if not seen[x] or not seen[y]:
                continue
            if differ(ends[x], seen[x], ends[y], seen[y]):
                return False
            for s in arcs[x].keys() | arcs[y].keys():
                if differ(times[x].get(s, 0), seen[x], times[y].get(s, 0), seen[y]):
                    return False
                if s in arcs[x] and s in arcs[y]:
                    todo.append((arcs[x][s], arcs[y][s]))
        return True

    def fold(a: int, b: int) -> None:
        """Add the tree below b to a."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            ends[x] += ends[y]
            seen[x] += seen[y]
            for s, z in arcs[y].items():
                times[x][s] = times[x].get(s, 0) + times[y][s]
                if s in arcs[x]:
                    todo.append((arcs[x][s], z))
                else:
                    arcs[x][s] = z

    red, place = [0], {0: 0}
    blue = [(0, s) for s in sorted(arcs[0])]
    while blue:
        # the best-supported blue state first: its test is the most reliable
        blue.sort(key=lambda e: (-seen[arcs[e[0]][e[1]]], e))
        q, s = blue.pop(0)
        b = arcs[q][s]
        if b in place:
            continue
        match = next((r for r in red if compatible(r, b)), None)
        if match is None:
            place[b] = len(red)
            red.append(b)
        else:
            arcs[q][s] = match
            fold(match, b)
        blue = sorted({(r, t) for r in red for t, z in arcs[r].items() if z not in place})
    n = len(red)
    nxt, logp, end = [], [], []
    for r in red:
        total = seen[r] + 0.5 * (SYMBOLS + 1)
        nxt.append([place[arcs[r][s]] if s in arcs[r] else -1 for s in range(SYMBOLS)])
        logp.append([float(np.log((times[r].get(s, 0) + 0.5) / total)) for s in range(SYMBOLS)])
        end.append(float(np.log((ends[r] + 0.5) / total)))
    return Automaton(nxt, logp, end, float(np.log(0.5 / (len(words) + 1))) if n else -8.0)


@dataclass
class Grammars:
    """An automaton and a threshold per kind, and the automaton of ordinary tokens."""

    kinds: dict[str, Automaton] = field(default_factory=dict)
    ordinary: Automaton | None = None
    threshold: dict[str, float] = field(default_factory=dict)

    def ratios(self, token: str) -> dict[str, float]:
        w = symbols(token)
        plain = self.ordinary.score(w)
        return {k: (a.score(w) - plain) / (len(w) + 1) for k, a in self.kinds.items()}

    def best(self, token: str) -> tuple[str, float] | None:
        """The kind that a token's format speaks for most clearly, if any."""
        over = [(r - self.threshold[k], k, r) for k, r in self.ratios(token).items() if r > self.threshold[k]] if self.ordinary else []
        return max(over)[1:] if over else None


def automata(credentials: dict[str, list[str]], ordinary: list[str]) -> tuple[Grammars, list[str]]:
    """Grammars without thresholds yet, and the ordinary tokens they were inferred from: the first two thirds.

    A kind with fewer than ten credentials gets no automaton; without ten ordinary tokens none does.
    """
    grammars = Grammars()
    if len(ordinary) < 10:
        return grammars, []
    some = 2 * len(ordinary) // 3
    grammars.ordinary = infer([symbols(t) for t in ordinary[:some]])
    for kind, tokens in credentials.items():
        if len(tokens) >= 10:
            grammars.kinds[kind] = infer([symbols(t) for t in tokens])
    return grammars, ordinary[:some]


def fit(credentials: dict[str, list[str]], ordinary: list[str]) -> Grammars:
    """Automata, and thresholds from the ordinary tokens that these were not inferred from."""
    grammars, learnt = automata(credentials, ordinary)
    held = [grammars.ratios(t) for t in ordinary[len(learnt) :]]
    for kind in grammars.kinds:
        grammars.threshold[kind] = max(0.0, float(np.quantile([h[kind] for h in held], 1 - FALSE_ALARMS)))
    return grammars


def _quantile(bins: list[tuple[int, int]], share: float) -> float:
    """np.quantile of the values in (bin, count), each as the lower edge of its bin."""
    number, counts = (np.array(x, np.int64) for x in zip(*sorted(bins), strict=True))
    upto = np.cumsum(counts)
    at = share * (int(upto[-1]) - 1)
    low, high = (number[np.searchsorted(upto, k, "right")] / BINS for k in (math.floor(at), math.ceil(at)))
    return float(low + (at - math.floor(at)) * (high - low))


def _texts(column: pa.Array) -> Iterator[str]:
    for i in range(0, len(column), 128):
        for t in column.slice(i, 128).to_pylist():
            yield t or ""


def learn(docs: DataFrame, *, text: str = "text", sample: int = SAMPLE, ordinary: int = ORDINARY, fit_length: int = FIT_LENGTH) -> Grammars:
    """Grammars from the documents' own labelled credentials and ordinary long tokens.

    Every whole text is scanned once; of the distinct tokens found, ``sample`` of each kind and
    ``ordinary`` others, those of at most ``fit_length`` characters with the smallest hashes, are the
    automata's training set. The thresholds come from the ratios of all other distinct ordinary
    tokens, of any length, counted by kind and bin.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, tokens = [], []
            for t in _texts(batch.column(0)):
                spans = base_spans(t)
                found = {(k, v) for _, k, _, v in spans} | {("", v) for _, _, v in candidates(t, spans)}
                for k, v in sorted(found):
                    kinds.append(k)
                    tokens.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(tokens, pa.string())], names=["kind", "token"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "kind string, token string")
    tokens = cut(found.groupBy("kind", "token").agg(F.xxhash64("token").alias("h")), "tokens")
    picked = None
    for kind, n in [*((k, sample) for k in KINDS), ("", ordinary)]:
        part = tokens.where((F.col("kind") == kind) & (F.length("token") <= fit_length)).orderBy("h", "token").limit(n)
        picked = part if picked is None else picked.union(part)
    got: dict[str, list[str]] = {k: [] for k in (*KINDS, "")}
    for r in sorted(picked.collect(), key=lambda r: (r["h"], r["token"])):
        got[r["kind"]].append(r["token"])
    grammars, learnt = automata({k: got[k] for k in KINDS}, got[""])
    if not grammars.kinds:
        return grammars
    for kind, bins in _held_counts(tokens.where("kind = ''").select("token"), grammars, frozenset(learnt)).items():
        grammars.threshold[kind] = max(0.0, _quantile(bins, 1 - FALSE_ALARMS))
    return grammars


def _held_counts(tokens: DataFrame, grammars: Grammars, learnt: frozenset[str]) -> dict[str, list[tuple[int, int]]]:
    """(bin, count) by kind of the ratios of all distinct ordinary tokens but the learnt ones."""
    kinds = sorted(grammars.kinds)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ratios = [grammars.ratios(v) for v in batch.column(0).to_pylist() if v not in learnt]
            bins = [[math.floor(r[k] * BINS) for k in kinds] for r in ratios]
            yield pa.RecordBatch.from_arrays([pa.array(bins, pa.list_(pa.int64()))], names=["bins"])

    counts = tokens.mapInArrow(run, "bins array<long>").select(F.posexplode("bins").alias("kind", "bin")).groupBy("kind", "bin").agg(F.count(F.lit(1)).alias("n"))
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in kinds}
    for r in counts.collect():  # a bounded range of ratios in bins
        out[kinds[r["kind"]]].append((r["bin"], r["n"]))
    return out


SPAN = "array<struct<start:int,kind:string,end:int,score:double>>"


def secret_spans(grammars: Grammars, text: Column) -> Column:
    """All spans of a text column by start, then kind: base ones (score null) and ``like_<kind>`` ones."""

    def run(texts: pa.Array) -> pa.Array:
        rank = {k: i for i, k in enumerate((*KINDS, *(f"like_{k}" for k in KINDS)))}
        out = []
        for t in _texts(texts):
            spans = base_spans(t)
            all_ = [(a, k, b, None) for a, k, b, _ in spans]
            for a, b, token in candidates(t, spans):
                if best := grammars.best(token):
                    all_.append((a, f"like_{best[0]}", b, best[1]))
            out.append([{"start": a, "kind": k, "end": b, "score": s} for a, k, b, s in sorted(all_, key=lambda x: (x[0], rank[x[1]]))])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("score", pa.float64())])))

    return F.arrow_udf(run, SPAN)(text)


def scan_secrets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", grammars: Grammars | None = None) -> DataFrame:
    """One row per document row: doc_id and spans (start, kind, end, score; code points, end exclusive).

    Null and empty texts have no spans. Rows without an id and repeated rows are scanned like
    others. With too few labelled credentials or ordinary tokens only base spans are reported.
    Other columns are not read; an empty table gives an empty result.
    """
    grammars = grammars or learn(docs, text=text)
    return docs.select(F.col(doc_id).alias("doc_id"), secret_spans(grammars, F.col(text)).alias("spans"))


def redacted(grammars: Grammars, text: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span replaced; touching and nested spans become one mask."""

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t, is_null in zip(_texts(texts), texts.is_null().to_pylist(), strict=True):
            found = base_spans(t)
            where = sorted([(a, b) for a, _, b, _ in found] + [(a, b) for a, b, token in candidates(t, found) if grammars.best(token)])
            parts, at = [], 0
            for a, b in where:
                if a >= at:
                    parts += [t[at:a], mask]
                at = max(at, b)
            out.append(None if is_null else "".join([*parts, t[at:]]))
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(text)
