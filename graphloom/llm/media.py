"""Media columns: payloads stored as FLAC, read back with checksums, cut into seekable PCM blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import flac

#: Payload bytes coded together in a task; one longer payload is a group of its own.
GROUP = 1 << 20
ALIGN = 64


def _groups(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive values of about GROUP bytes, null as empty, with the first one's index."""
    at, group, n = 0, [], 0
    for i in range(len(column)):
        group.append(column[i].as_py() or b"")
        n += len(group[-1])
        if n >= GROUP:
            yield at, group
            at, group, n = i + 1, [], 0
    if group:
        yield at, group


def pad(value: bytes) -> bytes:
    return value + b"\0" * (-len(value) % ALIGN or (0 if value else ALIGN))


def _feature(payload: bytes, blocks: list[tuple[int, int, int]]) -> str:
    """Integer features of the samples: blocks, sum, energy, sign changes, largest step."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    step = np.diff(x)
    return f"blocks={len(blocks)};sum={x.sum()};energy={(x * x).sum()};crossings={np.count_nonzero(np.diff(np.signbit(x)))};step={np.abs(step).max(initial=0)}"


def to_flac(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each whole text's UTF-8, zero-padded to a positive multiple of 64, as mono 8-bit FLAC.

    Null and empty texts are 64 zero bytes with n_bytes 0; rows without an id and repeated rows are
    stored like others; other columns are not read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, group in _groups(batch.column(1)):
                media = flac.encode([pad(g) for g in group])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(group)), pa.array([len(g) for g in group], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return src.mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


BLOCKS = "array<struct<sample_offset:long,byte_offset:long,samples:int>>"


def from_flac(media: DataFrame) -> DataFrame:
    """The stored bytes read back: doc_id, n_bytes, media, payload, blocks (seekable sample and byte offsets), feature.

    Frame and stream checksums are verified; a damaged stream fails the job. Where nothing is
    stored (null media), payload, blocks and feature are null.
    """
    kind = media.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, group in _groups(batch.column(2)):
                stored = np.flatnonzero(batch.column(2).slice(at, len(group)).is_valid().to_numpy(zero_copy_only=False)).tolist()
                payloads, listed, features = ([None] * len(group) for _ in range(3))
                for k, payload, own in zip(stored, *(flac.decode([group[k] for k in stored]) if stored else ([], [])), strict=True):
                    payloads[k], features[k] = payload, _feature(payload, own)
                    listed[k] = [{"sample_offset": s, "byte_offset": b, "samples": n} for s, b, n in own]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(group)),
                        batch.column(1).slice(at, len(group)),
                        batch.column(2).slice(at, len(group)),
                        pa.array(payloads, pa.binary()),
                        pa.array(listed, pa.list_(pa.struct([("sample_offset", pa.int64()), ("byte_offset", pa.int64()), ("samples", pa.int32())]))),
                        pa.array(features, pa.string()),
                    ],
                    names=["doc_id", "n_bytes", "media", "payload", "blocks", "feature"],
                )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary, payload binary, blocks {BLOCKS}, feature string")


def pcm_blocks(read: DataFrame) -> DataFrame:
    """One row per block: doc_id, block, sample_offset, byte_offset, samples, pcm (unsigned 8-bit)."""
    each = read.select("doc_id", "payload", F.posexplode("blocks").alias("block", "b"))
    return each.select("doc_id", "block", "b.*", F.expr("substring(payload, CAST(b.sample_offset AS INT) + 1, b.samples)").alias("pcm"))
