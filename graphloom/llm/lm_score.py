"""LM scoring: stupid-backoff scores from n-gram count tables that are partitioned by hash.

The corpus is exploded into n-grams chunk by chunk (a chunk is a run of consecutive rows of a
file). What a chunk sends out is each distinct n-gram's 64-bit key once with its count, sorted,
split over hash buckets; so a word pair that a third of all rows share meets its bucket once per
chunk. A bucket adds up the counts of its n-grams over the corpus and answers every chunk with
the totals in the order in which the keys came, so the answer needs no keys. The chunk's rows are
joined with their answers by chunk, and the scores are summed up per document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shingles import _WEIGHT, chunks, mix, word_hashes
from graphloom.session import cut

ORDER = 2
ALPHA = 0.4
#: Rows of a file in a chunk, and corpus rows per hash bucket.
ROWS, PER_BUCKET = 2048, 4000


def _ngrams(words: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all runs of ``order`` words inside a text, and the number of each run's text."""
    n = max(0, len(words) - order + 1)
    key = np.zeros(n, np.uint64)
    for j in range(order):
        key += words[j : j + n] * _WEIGHT[j]
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = text[:n] == text[order - 1 : order - 1 + n]
    return mix(key + np.uint64(order))[inside], text[:n][inside]


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts, bounds, base = [], [np.zeros(1, np.int64)], 0
    for _, _, data, offsets in chunks(pa.array(texts, pa.large_binary())):
        h, at = word_hashes(data, offsets)
        parts.append(h)
        bounds.append(at[1:] + base)
        base += len(h)
    return np.concatenate([np.zeros(0, np.uint64), *parts]), np.concatenate(bounds)


def _numbered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text, chunk, row: rows by their place in their file; what isn't read from files is written first."""
    where = [F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / ROWS)).alias("chunk"), F.col("_metadata.row_index").alias("row")]
    own = [F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")]
    try:
        return docs.select(*own, *where)
    except AnalysisException:  # not a plain file scan
        return cut(docs.select(*own), "corpus").select("doc_id", "text", *where)


def count_requests(rows: DataFrame, order: int, buckets: int) -> DataFrame:
    """(k, bucket, chunk, first, last, keys, counts): the distinct n-grams of each chunk, or of each part of one that a task holds."""

    def emit(chunk: int, first: int, last: int, texts: list[bytes]) -> Iterator[tuple]:
        words, at = _words(texts)
        for k in range(1, order + 1):
            keys, counts = np.unique(_ngrams(words, at, k)[0], return_counts=True)
            place = (keys % np.uint64(buckets)).astype(np.int64)
            for b in np.unique(place).tolist():
                own = place == b
                yield k, b, chunk, first, last, keys[own].tobytes(), zlib.compress(counts[own].astype(np.int64).tobytes(), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, last, texts = None, 0, 0, []
        names = ["k", "bucket", "chunk", "first", "last", "keys", "counts"]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=names)

        for batch in batches:
            for text, chunk, row in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if chunk != now or row != last + 1:
                    if texts:
                        yield batch_of(list(emit(now, first, last, texts)))
                    now, first, texts = chunk, row, []
                last = row
                texts.append(text.as_py() or b"")
        if texts:
            yield batch_of(list(emit(now, first, last, texts)))

    return rows.select("text", "chunk", "row").mapInArrow(run, "k int, bucket int, chunk long, first long, last long, keys binary, counts binary")


def count_answers(requests: DataFrame) -> DataFrame:
    """(k, bucket, chunk, first, last, totals, tokens): corpus totals in the order of each request's keys."""

    def total(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(x, np.uint64) for x in rows["keys"]]
        counts = [np.frombuffer(zlib.decompress(x), np.int64) for x in rows["counts"]]
        every, where = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.zeros(len(every), np.int64)
        np.add.at(sums, where, np.concatenate(counts))
        ends = np.cumsum([len(x) for x in keys])
        answers = [zlib.compress(sums[where[e - len(x) : e]].tobytes(), 1) for e, x in zip(ends, keys, strict=True)]
        return rows[["k", "bucket", "chunk", "first", "last"]].assign(totals=answers, tokens=[int(c.sum()) for c in counts])

    return requests.groupBy("k", "bucket").applyInPandas(total, "k int, bucket int, chunk long, first long, last long, totals binary, tokens long")


def _scores(texts: list[bytes], totals: dict[int, dict[int, np.ndarray]], corpus: int, order: int, buckets: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, sum of natural log scores) of each text; counts leave the text itself out."""
    words, at = _words(texts)
    n = np.diff(at)
    text = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(words)) - at[text]
    others = []  # others[k-1][i]: occurrences in other texts of the k-gram that ends at word i, 0 where there is none
    for k in range(1, order + 1):
        keys, owner = _ngrams(words, at, k)
        every, where = np.unique(keys, return_inverse=True)
        total = np.zeros(len(every), np.int64)
        bucket = (every % np.uint64(buckets)).astype(np.int64)
        for b, own in totals.get(k, {}).items():
            total[bucket == b] = own
        _, pair, times = np.unique(owner * max(1, len(every)) + where, return_inverse=True, return_counts=True)
        out = np.zeros(len(words), np.int64)
        out[place >= k - 1] = total[where] - times[pair]
        others.append(out)
    rest = np.maximum(corpus - n, 1)[text]
    score = np.log(np.where(others[0] > 0, others[0], 0.5) / rest)
    best = np.minimum(place, order - 1)  # backoff steps from the longest n-gram that fits
    steps = best.astype(np.float64)
    for k in range(2, order + 1):
        seen = others[k - 1] > 0
        context = np.concatenate([[1], others[k - 2][:-1]]) if len(words) else others[k - 2]
        score[seen] = np.log(others[k - 1][seen] / context[seen])
        steps[seen] = best[seen] - (k - 1)
    score += steps * np.log(alpha)
    return n, np.bincount(text, score, len(texts))


def backoff_scores(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, alpha: float = ALPHA) -> DataFrame:
    """One row per document row: doc_id, n_tokens, log_score (sum of natural logs).

    Words are lower-cased (A-Z) runs between ASCII white space. A word's score is the relative
    frequency c(n-gram) / c(context) for the longest n-gram, up to ``order``, that occurs in
    another row, times ``alpha`` for every step down from the longest that fits; a word that no
    other row has counts a half. Counts are those of all rows but the scored one, copies of which
    are other rows. Null and empty texts have no tokens and score 0; rows without an id are scored
    like others; other columns are not read; an empty table gives an empty result.
    """
    rows = _numbered(docs, doc_id, text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    buckets = max(8, rows.count() // PER_BUCKET)
    answers = cut(count_answers(count_requests(rows, order, buckets)), "answers")
    corpus = answers.where("k = 1").agg(F.sum("tokens")).first()[0] or 0

    def score(key: tuple, part: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row", kind="stable")
        n, s = np.zeros(len(part), np.int64), np.zeros(len(part))
        number = part["row"].to_numpy()
        for (first, last), own in found.groupby(["first", "last"]):
            totals: dict[int, dict[int, np.ndarray]] = {}
            for k, b, t in zip(own["k"], own["bucket"], own["totals"], strict=True):
                totals.setdefault(k, {})[b] = np.frombuffer(zlib.decompress(t), np.int64)
            i, j = np.searchsorted(number, first, "left"), np.searchsorted(number, last, "right")
            n[i:j], s[i:j] = _scores([t or b"" for t in part["text"].iloc[i:j]], totals, corpus, order, buckets, alpha)
        return pd.DataFrame({"doc_id": part["doc_id"], "n_tokens": n, "log_score": s})

    answered = answers.select("k", "bucket", "chunk", "first", "last", "totals")
    return rows.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInPandas(score, f"doc_id {kind}, n_tokens long, log_score double")
