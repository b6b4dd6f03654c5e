"""Word shingles of whole texts as 64-bit hashes, for Arrow batches inside Spark tasks.

Words are runs of bytes other than ASCII white space, with A-Z lowered. A word's hash is a
polynomial over random byte values read off one running sum for the whole batch; a shingle's
is a weighted sum over its words, mixed once more. No Python loop runs over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
#: Bytes hashed at once, so that the running sums stay small; one longer text is a chunk of its own.
CHUNK = 1 << 18

_rng = np.random.default_rng(20240229)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WEIGHT = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK)
        for k, base in enumerate((_BASE, _UNBASE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts data[offsets[i]:offsets[i+1]], and each text's first word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, ~word[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ~word[1:]
    starts = np.flatnonzero(word & (before | first[:-1]))
    ends = np.flatnonzero(word & (after | first[1:])) + 1
    return slice_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each data[starts[i]:ends[i]], with A-Z lowered."""
    up, down = _power(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, offsets) of consecutive texts with about CHUNK bytes; null is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, ascending; fewer than ``width`` words make one shingle, none make none."""
    for _, _, data, offsets in chunks(texts):
        words, at = word_hashes(data, offsets)
        whole = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width if len(whole) else 0):
            whole += words[k : k + len(whole)] * _WEIGHT[k]
        whole = mix(whole + np.uint64(width))
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= width:
                yield np.unique(whole[a : b - width + 1])
            elif b > a:
                yield mix(np.array([(words[a:b] * _WEIGHT[: b - a]).sum()], np.uint64) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
