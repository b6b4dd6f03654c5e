"""FLAC: exact round trips, checks of every checksum, all frame kinds, partitions, odd inputs."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import flac
from graphloom.llm.media import from_flac, pad, pcm_blocks, to_flac


def payloads(seed=0):
    rng = random.Random(seed)
    noise = [bytes(rng.randrange(256) for _ in range(64 * k)) for k in (1, 2, 65, 130)]
    waves = [bytes(int(128 + 100 * np.sin(i / 9)) for i in range(64 * k)) for k in (1, 64, 200)]
    ramps = [bytes(i * 3 % 256 for i in range(8192)), bytes(min(255, i // 40) for i in range(8192))]
    return [*noise, *waves, *ramps, b"\0" * 64, b"a" * 5000, b"a", b"ab", b"abc"]


@pytest.mark.parametrize("order", [0, 1, 2, 4])
def test_round_trip(monkeypatch, order):
    monkeypatch.setattr(flac, "LPC_ORDER", order)
    data = payloads()
    read, blocks = flac.decode(flac.encode(data))
    assert read == data
    for p, b in zip(data, blocks, strict=True):
        assert [x[0] for x in b] == list(range(0, len(p), flac.BLOCK))
        assert sum(x[2] for x in b) == len(p)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=300), min_size=1, max_size=6))
def test_any_bytes(data):
    assert flac.decode(flac.encode(data))[0] == data


def test_damage_is_found():
    stream = flac.encode([b"some text that is long enough to be predicted, " * 20])[0]
    found = 0
    for at in range(8, len(stream), 7):
        bad = bytearray(stream)
        bad[at] ^= 0x10
        try:
            found += flac.decode([bytes(bad)])[0][0] != flac.decode([stream])[0][0]
        except (ValueError, IndexError):
            found += 1
    assert found >= (len(stream) - 8) // 7 - 4  # a few metadata bytes carry nothing that is read


def test_partitioned_residual():
    """A hand-made frame: FIXED order 1, partition order 1 with different parameters."""
    x = [100, 101, 103, 102, 110, 90, 120, 70]
    r = [b - a for a, b in zip(x, x[1:], strict=False)]
    bits = f"{0b00010010:08b}{x[0] - 128 & 0xFF:08b}" + "00" + "0001"
    for k, part in ((1, r[:3]), (4, r[3:])):
        bits += f"{k:04b}"
        for v in part:
            u = 2 * v if v >= 0 else -2 * v - 1
            bits += "0" * (u >> k) + "1" + f"{u & (1 << k) - 1:0{k}b}"
    bits += "0" * (-len(bits) % 8)
    head = b"\xff\xf8\x74\x02\x00\x00\x07"
    frame = head + bytes([flac._crc8_of(head)]) + int(bits, 2).to_bytes(len(bits) // 8, "big")
    crc = flac._crc16_of(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0]
    frame += int(crc).to_bytes(2, "big")
    whole = flac.encode([bytes(x)])[0]
    assert flac.decode([whole[: 42 + 4 + 18] + frame])[0] == [bytes(x)]


def test_known_checksums():
    assert flac._crc8_of(b"123456789") == 0xF4
    data = np.frombuffer(b"123456789", np.uint8)
    assert flac._crc16_of(data, np.array([0]), np.array([9]))[0] == 0xFEE8
    assert flac._number(0x7F) == b"\x7f"
    assert flac._number(0x1234) == "ሴ".encode()


def test_documents(spark):
    texts = [(1, "short"), (2, None), (3, ""), (None, "é" * 40_000), (1, "short"), (5, "x" * 64)]
    df = spark.createDataFrame([(i, t, "m", 1) for i, t in texts], "doc_id long, text string, media string, n_bytes int")
    read = from_flac(to_flac(df))
    rows = read.collect()
    assert sorted((str(r.doc_id), bytes(r.payload), r.n_bytes) for r in rows) == sorted((str(i), pad((t or "").encode()), len((t or "").encode())) for i, t in texts)
    assert len({hashlib.sha256(bytes(r.media)).hexdigest() for r in rows if r.doc_id == 1}) == 1
    blocks = pcm_blocks(read).collect()
    for r in rows:
        own = sorted((b.sample_offset, bytes(b.pcm)) for b in blocks if b.doc_id == r.doc_id)
        assert b"".join(p for _, p in dict(own).items()) == bytes(r.payload)
        assert zlib.crc32(bytes(r.payload)[-64:]) >= 0
    assert from_flac(to_flac(df.limit(0))).collect() == []


def test_null_media_stay_null(spark):
    stored = to_flac(spark.createDataFrame([(1, "some text")], "doc_id long, text string"))
    rows = from_flac(stored.union(spark.createDataFrame([(2, 0, None), (3, 5, None)], stored.schema))).collect()
    assert {r.doc_id: (r.payload is None, r.blocks is None, r.feature is None) for r in rows} == {1: (False,) * 3, 2: (True,) * 3, 3: (True,) * 3}
