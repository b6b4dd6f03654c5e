"""Personal data: overlapping candidate spans, boosted trees over format and context, thresholds.

High-recall generators propose spans; validators confirm some of them (the base kinds). Whether
a candidate passes its validator is the label from which gradient-boosted trees learn what valid
ones look like, from format and context features that the validators don't use as such. Features
are small integers, so the whole corpus is summed up as a table of feature cells; trees are
fitted to that table, thresholds are chosen on held-back counts, and the trees are scored as a
column expression. Extraction, counting and scoring are DataFrame expressions throughout.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut

KINDS = ("email", "ip", "card", "phone")
#: Generators beyond the base kinds; their spans are reported as like_<generator> when selected.
WIDE = ("handle", "number", "hextets", "code")
#: Share of valid ones among held-back candidates that score at least the threshold.
PRECISION = 0.9
ROUNDS, DEPTH_GAIN, RATE = 40, 1e-3, 0.3

# Possessive loops and the look-behind keep matching linear in the text; matches are those of the plain patterns.
_LOCAL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"
PATTERNS = {
    "email": _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "handle": _LOCAL + r"\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++",
    "number": r"[+(]?[0-9][\x20().0-9-]{5,30}[0-9]",
    "hextets": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}",
    "code": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}",
}
#: A text without this has no match; saves the longer patterns on most texts.
_GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "handle": r"@|[(\[]at[)\]]", "number": "[0-9]", "hextets": ":[0-9A-Fa-f]{0,4}:", "code": "[A-Z]{2}[0-9]{2}"}
FEATURES = ("kind", "digits", "letters", "separators", "plus", "paren", "dots", "dashes", "before", "after", "cue")
_CUES = r"(?i)(mail|tel|phone|call|fax|mobile|card|visa|iban|account|address|contact|server|host|ip|from|von|para|pour|de|by)[^\p{L}]{0,3}$"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, value), code points, end exclusive."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        span = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], span).alias("out"))

    pairs = F.zip_with(gaps, found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    begin = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.aggregate(F.filter(pairs, lambda p: p["value"].isNotNull()), begin, step, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        double = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((n - i) % 2 == 1, double).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), part), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _bin(x: Column, edges: list[int]) -> Column:
    """Number of edges that x reaches."""
    return sum((F.when(x >= e, 1).otherwise(0) for e in edges), F.lit(0)).cast("int")


def _class(c: Column) -> Column:
    """0 none, 1 white space, 2 letter, 3 digit, 4 other."""
    return F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"\p{L}"), 2).when(c.rlike("[0-9]"), 3).otherwise(4)


def _candidate(text: Column, kind: int, span: Column, base: Column) -> Column:
    v = span["value"]
    count = lambda chars: F.length(v) - F.length(F.regexp_replace(v, chars, ""))
    left = F.substring(text, F.greatest(span["start"] - 11, F.lit(1)), F.least(span["start"], F.lit(12)))
    confirmed = F.exists(base, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))
    return F.struct(
        span["start"].alias("start"),
        span["end"].alias("end"),
        confirmed.alias("confirmed"),
        (F.crc32(v.cast("binary")) % 5 == 0).alias("held"),
        F.lit(kind).alias("kind"),
        _bin(count("[0-9]"), [1, 6, 9, 10, 11, 13, 16, 17, 20]).alias("digits"),
        _bin(count(r"\p{L}"), [1, 4, 8, 16]).alias("letters"),
        _bin(count(r"[\x20().:-]"), [1, 2, 3, 4, 6]).alias("separators"),
        F.startswith(v, F.lit("+")).cast("int").alias("plus"),
        F.contains(v, F.lit("(")).cast("int").alias("paren"),
        _bin(count(r"\."), [1, 2, 3, 4]).alias("dots"),
        _bin(count("-"), [1, 2, 3]).alias("dashes"),
        _class(F.when(span["start"] > 0, F.substring(text, span["start"], F.lit(1))).otherwise("")).alias("before"),
        _class(F.substring(text, span["end"] + 1, F.lit(1))).alias("after"),
        left.rlike(_CUES).cast("int").alias("cue"),
    )


@dataclass
class Trees:
    """Boosted depth-2 trees over integer features: (root, left, right) of (feature, threshold), four leaf values each."""

    start: float = 0.0
    trees: list[tuple] = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)

    def margin(self, cells: np.ndarray) -> np.ndarray:
        z = np.full(len(cells), self.start)
        for (f, t), (lf, lt), (rf, rt), leaves in self.trees:
            high = cells[:, f] >= t
            z += np.where(high, np.where(cells[:, rf] >= rt, leaves[3], leaves[2]), np.where(cells[:, lf] >= lt, leaves[1], leaves[0]))
        return z

    def expression(self, x: Column) -> Column:
        """The same sum as a column expression over a struct with the features."""
        z = F.lit(self.start)
        at = lambda f, t: x[FEATURES[f]] >= int(t)
        for root, left, right, v in self.trees:
            z = z + F.when(at(*root), F.when(at(*right), v[3]).otherwise(v[2])).otherwise(F.when(at(*left), v[1]).otherwise(v[0]))
        return z


def _split(cells: np.ndarray, g: np.ndarray, h: np.ndarray, own: np.ndarray) -> tuple[int, int]:
    """(feature, threshold) of the largest gain among the cells marked."""
    best, where = DEPTH_GAIN, (0, 0)
    total_g, total_h = g[own].sum(), h[own].sum()
    for f in range(cells.shape[1]):
        x = cells[own, f]
        up_g, up_h = (np.bincount(x, w[own], minlength=2)[::-1].cumsum()[::-1] for w in (g, h))
        low_g, low_h = total_g - up_g, total_h - up_h
        gain = up_g**2 / (up_h + 1) + low_g**2 / (low_h + 1) - total_g**2 / (total_h + 1)
        t = int(gain[1:].argmax()) + 1
        if gain[t] > best:
            best, where = gain[t], (f, t)
    return where


def boost(cells: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> Trees:
    """Gradient boosting with logistic loss on weighted cells."""
    n1, n0 = positive.sum(), negative.sum()
    model = Trees(float(np.log((n1 + 1) / (n0 + 1))))
    z = np.full(len(cells), model.start)
    everything = np.ones(len(cells), bool)
    for _ in range(ROUNDS if n1 and n0 else 0):
        p = 1 / (1 + np.exp(-z))
        g, h = positive - (positive + negative) * p, (positive + negative) * p * (1 - p)
        f, t = _split(cells, g, h, everything)
        high = cells[:, f] >= t
        lf, lt = _split(cells, g, h, ~high)
        rf, rt = _split(cells, g, h, high)
        leaf = 2 * high + np.where(high, cells[:, rf] >= rt, cells[:, lf] >= lt)
        values = RATE * np.bincount(leaf, g, 4) / (np.bincount(leaf, h, 4) + 1)
        model.trees.append(((f, t), (lf, lt), (rf, rt), values.tolist()))
        z += values[leaf]
    return model


def fit(table: np.ndarray) -> Trees:
    """Trees from rows of (features..., valid, invalid, held-back valid, held-back invalid), one threshold per kind.

    A kind's threshold is the lowest score from which on PRECISION of the held-back candidates are
    valid; a kind for which no score is good enough reports nothing.
    """
    k = len(FEATURES)
    table = table.reshape(-1, k + 4).astype(np.int64)
    model = boost(table[:, :k], table[:, k].astype(float), table[:, k + 1].astype(float))
    z = model.margin(table[:, :k])
    for kind in range(len(WIDE)):
        own = table[:, 0] == kind
        order = np.argsort(-z[own], kind="stable")
        scores, good, bad = z[own][order], table[own, k + 2][order].cumsum(), table[own, k + 3][order].cumsum()
        last = np.append(scores[1:] != scores[:-1], True) if len(scores) else np.zeros(0, bool)  # ties stand together
        fine = np.flatnonzero(last & (good > 0) & (good >= PRECISION * (good + bad)))
        model.thresholds[kind] = float(scores[fine[-1]]) if len(fine) else float("inf")
    return model


def candidates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, base (validated spans: start, k, end, kind) and wide (candidates with features)."""
    t = F.coalesce(F.col("text"), F.lit(""))
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).select("doc_id", t.alias("text"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    gated = lambda k: F.when(F.col("text").rlike(_GATES[k]), matches(F.col("text"), PATTERNS[k])).otherwise(none)
    found = src.select("doc_id", "text", *[gated(k).alias(k) for k in PATTERNS])

    def base(i: int, kind: str) -> Column:
        valid = F.filter(kind, lambda s: _valid(kind, s["value"]))
        return F.transform(valid, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("k"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    spans = F.array_sort(F.concat(*[base(i, k) for i, k in enumerate(KINDS)]))
    held = found.select("doc_id", "text", spans.alias("base"), *WIDE)

    def wide(i: int, kind: str) -> Column:
        return F.transform(kind, lambda s: _candidate(F.col("text"), i, s, F.col("base")))

    return held.select("doc_id", "base", F.concat(*[wide(i, k) for i, k in enumerate(WIDE)]).alias("wide"))


def train(found: DataFrame) -> Trees:
    """Trees from the counts of all candidates by feature cell; the bins bound the number of cells."""
    one = found.select(F.explode("wide").alias("w")).select("w.*")
    n = lambda c: F.sum(c.cast("long"))
    valid, held = F.col("confirmed"), F.col("held")
    cells = one.groupBy(*FEATURES).agg(n(valid & ~held).alias("a"), n(~valid & ~held).alias("b"), n(valid & held).alias("c"), n(~valid & held).alias("d"))
    return fit(np.array([list(r) for r in cells.orderBy(*FEATURES).collect()], np.int64))


def find_pii(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: doc_id and spans (start, k, end, kind), by start, then kind.

    Base kinds (email, ip, card, phone) are all validated matches; like_* spans are candidates
    that no base span touches and whose score reaches their generator's threshold. Null texts are
    empty and have no spans. Rows without an id and repeated rows are searched like others. With
    nothing to learn from only base spans are reported. Other columns are not read; an empty table
    gives an empty result.
    """
    found = cut(candidates(docs, doc_id=doc_id, text=text), "pii")
    model = train(found)
    limits = [model.thresholds.get(i, float("inf")) for i in range(len(WIDE))]

    def selected(w: Column) -> Column:
        limit = F.lit(float("inf"))
        for i, at in enumerate(limits):
            limit = F.when(w["kind"] == i, F.lit(at)).otherwise(limit)
        return ~w["confirmed"] & (model.expression(w) >= limit)

    names = F.array(*[F.lit(f"like_{k}") for k in WIDE])
    extra = F.transform(F.filter("wide", selected), lambda w: F.struct(w["start"].alias("start"), (w["kind"] + len(KINDS)).alias("k"), w["end"].alias("end"), F.get(names, w["kind"]).alias("kind")))
    return found.select("doc_id", F.array_sort(F.concat("base", extra)).alias("spans"))
