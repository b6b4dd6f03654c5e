"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017) on hashed word parts.

Confirmed toxic texts are the positives; unlabelled texts of the corpus are a mixture in which
the class prior says how much is toxic. The corrected estimator
  prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))
needs no clean labels; where the second term turns negative its gradient is reversed. A linear
model over word, prefix and suffix hashes is fitted with numpy on a bounded sample, its scores
are calibrated on labelled rows, and all whole texts are scored inside Spark tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shingles import _BYTE, _power, chunks, mix

DIM = 1 << 18
#: Most documents of each kind that the model is fitted on, taken by smallest hash of their ids.
SAMPLE = {"positive": 6_000, "unlabelled": 12_000, "calibration": 6_000}
#: Documents of the sample that must have a feature for the fit to look at it.
MET = 5
PREFIXES = (3, 4, 5, 6, 7, 8, 9)
SUFFIXES = (4, 6)
THRESHOLD = 0.7
#: The scores that calibrate come from models fitted without a row's own fold, so no row calibrates a model it has trained.
FOLDS = 3

_KIND = np.arange(256, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)
_PART = np.zeros(256, dtype=bool)
_PART[48:58] = _PART[65:91] = _PART[97:123] = _PART[128:] = True


def features(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each text (of those that ``keep`` marks), concatenated, and where each text's begin."""
    n, texts = len(data), len(offsets) - 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(texts + 1, np.int64)
    word = _PART[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, ~word[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ~word[1:]
    starts = np.flatnonzero(word & (before | first[:-1]))
    ends = np.flatnonzero(word & (after | first[1:])) + 1
    size = ends - starts
    up, down = _power(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=sums[1:])
    doc = np.searchsorted(offsets, starts, "right") - 1
    parts = [(starts, ends, 0)]
    for k in PREFIXES:
        long = size > k
        parts.append((starts[long], starts[long] + k, k))
    for k in SUFFIXES:
        long = size > k
        parts.append((ends[long] - k, ends[long], 100 + k))
    keys = []
    for a, b, kind in parts:
        hashed = (mix((sums[b] - sums[a]) * down[a] + _KIND[kind]) % np.uint64(DIM)).astype(np.int64)
        owner = doc if kind == 0 else doc[size > kind % 100]
        if keep is not None:
            own = keep[hashed]
            hashed, owner = hashed[own], owner[own]
        keys.append(owner * DIM + hashed)
    keys = np.unique(np.concatenate(keys))
    return keys % DIM, np.searchsorted(keys, np.arange(texts + 1) * DIM)


@dataclass
class Model:
    """Weights of the hashed features, bias, and the calibration of the raw score."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, index: np.ndarray, at: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.weights[index], dtype=np.float64)])
        return self.bias + sums[at[1:]] - sums[at[:-1]]

    def score(self, index: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(index, at) + self.shift, -40, 40)))


def _pick(rows: list[np.ndarray], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = [rows[i] for i in which]
    return np.concatenate([*own, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)


def select(feature: np.ndarray, p: np.ndarray, u: np.ndarray, n: int, m: int, least: float = 4.0) -> np.ndarray:
    """Marks the features whose document frequencies differ between n positives and m unlabelled texts by a z score of ``least`` at least."""
    telling = np.zeros(DIM, bool)
    if n and m and len(feature):
        share = (p + u + 1) / (n + m + 2)
        z = np.abs(p / n - u / m) / np.sqrt(share * (1 - share) * (1 / n + 1 / m))
        telling[feature[z >= least]] = True
    return telling


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, used: np.ndarray, *, steps: int = 400, rate: float = 0.05, l2: float = 1e-4) -> Model:
    """Linear model over the ``used`` features under the non-negative PU risk with logistic loss and an L2 term, by Adam on the whole sample."""
    model = Model(np.zeros(DIM), float(np.log(prior / (1 - prior))))
    if not positive or not unlabelled:
        return model
    column = np.full(DIM, -1)
    column[used] = np.arange(len(used))

    def sparse(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Row and column numbers of the ones, beside the bias in column 0."""
        c = column[_pick(rows, np.arange(len(rows)))[0]] + 1
        r = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        return r[c > 0], c[c > 0]

    (rp, cp), (ru, cu) = sparse(positive), sparse(unlabelled)
    times = lambda r, c, n, w: w[0] + np.bincount(r, w[c], n)

    def back(r: np.ndarray, c: np.ndarray, g: np.ndarray) -> np.ndarray:
        out = np.bincount(c, g[r], len(used) + 1)
        out[0] = g.sum()
        return out

    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    w = np.zeros(len(used) + 1)
    w[0] = model.bias
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        zp, zu = times(rp, cp, len(positive), w), times(ru, cu, len(unlabelled), w)
        risk_neg = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        neg = back(ru, cu, sigmoid(zu) / len(zu)) - prior * back(rp, cp, sigmoid(zp) / len(zp))
        grad = -prior * back(rp, cp, sigmoid(-zp) / len(zp)) + neg if risk_neg >= 0 else -neg
        grad[1:] += l2 * w[1:]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * min(1.0, 2 - 2 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model.bias = float(w[0])
    model.weights[used] = w[1:]
    return model


def calibrate(model: Model, z: np.ndarray, labels: np.ndarray) -> Model:
    """Platt scaling of raw scores by Newton steps, with Platt's smoothed targets."""
    if len(z) == 0 or labels.min() == labels.max():
        return model
    scale = np.std(z) + 1e-9
    z = z / scale
    n1, n0 = labels.sum(), (1 - labels).sum()
    y = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        g = np.array([((q - y) * z).sum() + 1e-3 * a, (q - y).sum()])
        s = q * (1 - q) + 1e-9
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum()]])
        step = np.linalg.solve(h + 1e-6 * np.eye(2), g)
        step *= min(1.0, 5 / (np.abs(step).max() + 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return Model(model.weights, model.bias, max(a, 1e-6) / scale, b)


def held_out(doc_id: Column) -> Column:
    """The fold whose labels are never learnt from: crc32 of the id as text, remainder 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample_ids(docs: DataFrame, labels: DataFrame, sample: dict[str, int]) -> DataFrame:
    """(doc_id, label, flags) of the bounded sample, by smallest hash of the id; only ids that may be learnt from."""
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    both = ids.join(known, "doc_id", "left")

    def first(rows: DataFrame, kind: str, bit: int) -> DataFrame:
        return rows.orderBy(F.xxhash64("doc_id", F.lit(bit)), "doc_id").limit(sample[kind]).select("doc_id", "label", F.lit(bit).alias("bit"))

    picked = first(both.where("label = 1"), "positive", 1).union(first(both.where("label IS NULL"), "unlabelled", 2)).union(first(both.where("label IS NOT NULL"), "calibration", 4))
    return picked.groupBy("doc_id").agg(F.max("label").alias("label"), F.sum("bit").cast("int").alias("flags"))


def _each(texts: pa.Array, keep: np.ndarray | None = None) -> Iterator[np.ndarray]:
    for _, _, data, offsets in chunks(texts):
        index, at = features(data, offsets, keep)
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield index[a:b]


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sample: dict[str, int] | None = None, met: int = MET) -> Model:
    """A calibrated model from at most ``sample`` documents of each kind outside the held-out fold.

    Features are those that ``met`` of its documents have. Document frequencies of all features in the sample are summed by Spark; the driver gets two
    counts for each of the DIM hash values at most, then the telling features of the sample.
    """
    sample = SAMPLE | (sample or {})
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    lab = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    ids = _sample_ids(src, lab, sample)
    rows = src.join(F.broadcast(ids), "doc_id").select("text", "doc_id", "label", "flags")  # the sample's bound is the proof of size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, u = np.zeros(DIM, np.int64), np.zeros(DIM, np.int64)
            for index, flags in zip(_each(batch.column(0)), batch.column(3).to_pylist(), strict=True):
                p[index] += flags & 1
                u[index] += (flags >> 1) & 1
            met = np.flatnonzero(p + u)
            yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(p[met]), pa.array(u[met])], names=["feature", "p", "u"])

    sums = rows.mapInArrow(count, "feature long, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    table = sums.where(F.col("p") + F.col("u") >= met).orderBy("feature").toPandas()
    sizes = {r["label"]: r["n"] for r in ids.select(F.explode(F.expr("filter(array(1, 2, 4), b -> flags & b > 0)")).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    telling = select(table["feature"].to_numpy(), table["p"].to_numpy(), table["u"].to_numpy(), sizes.get(1, 0), sizes.get(2, 0))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.astype(np.int32).tobytes() for x in _each(batch.column(0), telling)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), pa.array(found, pa.binary())], names=["doc_id", "label", "flags", "features"])

    got = rows.mapInArrow(project, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, label int, flags int, features binary")
    got = sorted(got.collect(), key=lambda r: (str(r["doc_id"]), bytes(r["features"])))
    row = [np.frombuffer(r["features"], np.int32).astype(np.int64) for r in got]
    flags, fold = np.array([r["flags"] for r in got], np.int64), np.array([zlib.crc32(str(r["doc_id"]).encode()) // 3 % FOLDS for r in got], np.int64)
    of = lambda which: [row[i] for i in np.flatnonzero(which)]
    marked = (flags & 4) > 0
    y = np.array([r["label"] for r in got if r["flags"] & 4], float)
    # smoothed share of toxic texts among the labelled rows that may be learnt from
    prior, used = float((y.sum() + 0.5) / (len(y) + 25)), np.flatnonzero(telling)
    z = np.zeros(len(got))
    for f in range(FOLDS):
        own = marked & (fold == f)
        if own.any():
            part = fit_nnpu(of(((flags & 1) > 0) & (fold != f)), of((flags & 2) > 0), prior, used)
            z[own] = part.raw(*_pick(row, np.flatnonzero(own)))
    model = fit_nnpu(of((flags & 1) > 0), of((flags & 2) > 0), prior, used)
    return calibrate(model, z[marked], y)


def score(model: Model, text: Column) -> Column:
    """Score of a text column, 0 to 1; whole texts, null as empty."""
    shared = model

    def run(texts: pa.Array) -> pa.Array:
        keep = shared.weights != 0
        out = [np.zeros(0)]
        for _, _, data, offsets in chunks(texts):
            out.append(shared.score(*features(data, offsets, keep)))
        return pa.array(np.concatenate(out))

    return F.arrow_udf(run, "double")(text.cast("binary"))


def toxicity(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, sample: dict[str, int] | None = None) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted (1 from ``threshold`` on).

    The score depends on the text alone. Null and empty texts get the score of a text without
    features. Rows without an id are scored and never learnt from; repeated rows get equal
    scores; of repeated labels the largest counts, null labels are ignored. Without positive or
    unlabelled rows to learn from, every text gets the prior. Other columns are not read; an
    empty table gives an empty result.
    """
    model = train(docs, labels, doc_id=doc_id, text=text, sample=sample)
    scored = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), score(model, F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
