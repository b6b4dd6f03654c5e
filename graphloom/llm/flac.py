"""FLAC for mono 8-bit samples with numpy: many streams' frames are coded and decoded side by side.

Decoding is sequential inside a frame, so frames advance in lockstep: one vector step moves every
frame by one sample. Frame starts come from the seek table. Encoding needs no loop over samples.
Frames are CONSTANT, VERBATIM, FIXED or LPC; residuals are Rice-coded, any partition order is read.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np

BLOCK = 4096
#: Longest linear predictor tried; 0 uses fixed polynomial predictors only.
LPC_ORDER = 2
PRECISION, SHIFT = 10, 8
_FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _crc_tables(poly: int, bits: int, length: int) -> np.ndarray:
    """table[d, b]: CRC of byte b followed by d zero bytes; a message's CRC is the XOR over its bytes."""
    one = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        one = np.where(one >> (bits - 1) & 1, one << 1 ^ poly, one << 1) & ((1 << bits) - 1)
    table = np.empty((length, 256), np.uint16)
    table[0] = one
    for d in range(1, length):
        last = table[d - 1].astype(np.uint32)
        table[d] = (last << 8 & ((1 << bits) - 1)) ^ one[last >> (bits - 8)]
    return table


_CRC8 = _crc_tables(0x107, 8, 17)
_crc16: list[np.ndarray] = []


def _crc16_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of the segments data[start:start+length] (all non-empty)."""
    most = int(lengths.max())
    if not _crc16 or len(_crc16[0]) < most:
        _crc16[:] = [_crc_tables(0x18005, 16, max(most, BLOCK + 64))]
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
    byte = data[np.repeat(starts, lengths) + at]
    part = _crc16[0].reshape(-1)[(np.repeat(lengths, lengths) - 1 - at) * 256 + byte]
    return np.bitwise_xor.reduceat(part, ends - lengths)


def _crc8_of(head: bytes) -> int:
    out = 0
    for i, b in enumerate(head):
        out ^= int(_CRC8[len(head) - 1 - i, b])
    return out


def _number(n: int) -> bytes:
    """FLAC's UTF-8-like coding of a frame number, up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    tail = []
    room = 0x3F
    while n > room:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        room >>= 1
    return bytes([0xFF & ~(2 * room + 1) | n, *reversed(tail)])


def _predictors(x: np.ndarray, at: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised LPC coefficients of order LPC_ORDER by least squares on each frame's autocorrelation."""
    f = x.astype(np.float64)
    r = []
    for lag in range(LPC_ORDER + 1):
        prod = np.zeros(len(f))
        prod[lag:] = f[lag:] * f[: len(f) - lag]
        prod[at < lag] = 0
        r.append(np.add.reduceat(prod, starts))
    m = np.empty((len(starts), LPC_ORDER, LPC_ORDER))
    for i in range(LPC_ORDER):
        for j in range(LPC_ORDER):
            m[:, i, j] = r[abs(i - j)]
    m[:, range(LPC_ORDER), range(LPC_ORDER)] += 1e-3 * r[0][:, None] + 1.0
    c = np.linalg.solve(m, np.stack(r[1:], axis=1)[:, :, None])[:, :, 0]
    return np.clip(np.rint(c * (1 << SHIFT)), -(1 << (PRECISION - 1)), (1 << (PRECISION - 1)) - 1).astype(np.int64), sizes > LPC_ORDER


def encode(payloads: list[bytes], rate: int = 8000) -> list[bytes]:
    """Each payload (not empty; unsigned 8-bit samples) as a FLAC stream with a seek table of all frames."""
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    x = raw.astype(np.int64) - 128
    sizes, owner = [], []
    for k, p in enumerate(payloads):
        full, rest = divmod(len(p), BLOCK)
        own = [BLOCK] * full + [rest] * (rest > 0)
        sizes += own
        owner += [k] * len(own)
    size, owner = np.array(sizes, np.int64), np.array(owner, np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    frames = len(size)
    at = np.arange(len(x)) - np.repeat(starts, size)

    # the predictor with the least residual in each frame
    residuals, costs = [x], [np.add.reduceat(np.abs(x), starts)]
    for order in (1, 2):
        d = residuals[-1].copy()
        d[1:] -= residuals[-1][:-1]
        d[at < order] = 0
        residuals.append(d)
        costs.append(np.add.reduceat(np.abs(d), starts))
    if LPC_ORDER:
        coef, able = _predictors(x, at, starts, size)
        guess = np.zeros(len(x), np.int64)
        for i in range(LPC_ORDER):
            guess[i + 1 :] += np.repeat(coef[:, i], size)[i + 1 :] * x[: -i - 1]
        d = x - (guess >> SHIFT)
        d[at < LPC_ORDER] = 0
        residuals.append(d)
        costs.append(np.where(able, np.add.reduceat(np.abs(d), starts) + 6 * LPC_ORDER, 1 << 60))
    kind = np.argmin(np.stack(costs), axis=0)
    order = np.where(kind == 3, LPC_ORDER, np.minimum(kind, size - 1))
    kind = np.where(kind == 3, 3, order)
    per = np.repeat(kind, size)
    d = residuals[0].copy()
    for k in range(1, len(residuals)):
        own = per == k
        d[own] = residuals[k][own]
    coded = at >= np.repeat(order, size)
    u = np.where(d >= 0, 2 * d, -2 * d - 1)
    u[~coded] = 0
    count = size - order
    mean = np.add.reduceat(u, starts) / np.maximum(count, 1)
    rice = np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 1.0))), 0, 14).astype(np.int64)
    k_each = np.repeat(rice, size)
    bits_each = np.where(coded, (u >> k_each) + 1 + k_each, 0)
    head_bits = np.where(kind == 3, 9 + PRECISION * LPC_ORDER, 0)  # between warm-up and residual
    body = 8 + 8 * order + head_bits + 10 + np.add.reduceat(bits_each, starts)
    constant = np.minimum.reduceat(x, starts) == np.maximum.reduceat(x, starts)
    verbatim = ~constant & (body >= 8 + 8 * size)
    plain = constant | verbatim
    body = np.where(constant, 16, np.where(verbatim, 8 + 8 * size, body))

    heads = []
    first_of = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])
    number = np.arange(frames) - np.repeat(first_of, np.diff(np.append(first_of, frames)))
    for n, s in zip(number.tolist(), sizes, strict=True):
        h = b"\xff\xf8\x74\x02" + _number(n) + struct.pack(">H", s - 1)  # 16-bit block size, 8 kHz, mono, 8 bits
        heads.append(h + bytes([_crc8_of(h)]))
    head_len = np.array([len(h) for h in heads], np.int64)
    length = head_len + -(-body // 8) + 2
    out_end = np.cumsum(length)
    out_start = out_end - length
    base = out_start + head_len
    data = np.zeros(int(out_end[-1]) + 3, np.uint8)
    data[base] = np.where(constant, 0, np.where(verbatim, 1, np.where(kind == 3, 32 + LPC_ORDER - 1, 8 + order))) << 1
    each = np.repeat(np.where(verbatim, size, np.where(constant, 1, order)), size)
    direct = at < each
    data[(np.repeat(base, size) + 1 + at)[direct]] = x[direct] & 0xFF
    rest = 8 * (base + 1 + order)
    words: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (bit position, value, width of at most 17 bits)
    if LPC_ORDER and (own := np.flatnonzero(~plain & (kind == 3))).size:
        width = np.full(len(own), PRECISION)
        words.append((rest[own], np.full(len(own), PRECISION - 1 << 5 | SHIFT), np.full(len(own), 9)))
        words += [(rest[own] + 9 + PRECISION * i, coef[own, i] & ((1 << PRECISION) - 1), width) for i in range(LPC_ORDER)]
    rest = rest + head_bits
    own = np.flatnonzero(~plain)
    words.append((rest[own], rice[own], np.full(len(own), 10)))  # method 00 and partition order 0000 are zeros
    live = coded & ~np.repeat(plain, size)
    before = np.cumsum(bits_each) - bits_each
    place = (np.repeat(rest + 10 - before[starts], size) + before)[live]
    u, k = u[live], k_each[live]
    words.append((place + (u >> k), (1 << k) | (u & ((1 << k) - 1)), k + 1))  # the zeros before it are there already
    for where, value, width in words:
        # three bytes hold any such word; words share no bits, so sums are unions
        byte = where >> 3
        v = value << (24 - (where & 7) - width)
        if not len(byte):
            continue
        lo, hi = int(byte.min()), int(byte.max()) + 3
        total = sum(np.bincount(byte - lo + j, v >> (16 - 8 * j) & 0xFF, hi - lo) for j in range(3))
        data[lo:hi] += total.astype(np.uint8)
    data = data[:-3]
    for s, h in zip(out_start.tolist(), heads, strict=True):
        data[s : s + len(h)] = np.frombuffer(h, np.uint8)
    crc = _crc16_of(data, out_start, length - 2)
    data[out_end - 2], data[out_end - 1] = crc >> 8, crc & 0xFF

    streams = []
    bounds = np.append(first_of, frames)
    for k, p in enumerate(payloads):
        a, b = bounds[k], bounds[k + 1]
        own = slice(a, b)
        info = struct.pack(">HH", min(BLOCK, len(p)) if b - a == 1 else BLOCK, min(BLOCK, len(p)))
        info += int(length[own].min()).to_bytes(3, "big") + int(length[own].max()).to_bytes(3, "big")
        info += (rate << 44 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5((np.frombuffer(p, np.uint8) ^ 0x80).tobytes()).digest()
        seek = np.zeros(b - a, [("sample", ">u8"), ("byte", ">u8"), ("n", ">u2")])
        seek["sample"], seek["byte"], seek["n"] = BLOCK * np.arange(b - a), out_start[own] - out_start[a], size[own]
        head = b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + seek.nbytes.to_bytes(3, "big") + seek.tobytes()
        streams.append(head + data[out_start[a] : out_end[b - 1]].tobytes())
    return streams


def _frames(stream: bytes) -> tuple[int, bytes, list[tuple[int, int, int]], int]:
    """(total samples, MD5, [(sample, byte offset in the stream, samples)], end) from the metadata blocks."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, total, digest, seek = 4, 0, b"", np.zeros(0)
    while True:
        kind, n = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + n]
        at += 4 + n
        if kind & 0x7F == 0:
            packed = int.from_bytes(body[10:18], "big")
            if packed >> 36 & 0xFF != 7:
                raise ValueError("only mono 8-bit streams are read")
            total, digest = packed & (1 << 36) - 1, body[18:34]
        elif kind & 0x7F == 3:
            seek = np.frombuffer(body, [("sample", ">u8"), ("byte", ">u8"), ("n", ">u2")])
        if kind & 0x80:
            break
    points = [(int(s), at + int(b), int(n)) for s, b, n in seek.tolist()]
    if sum(p[2] for p in points) != total:
        raise ValueError("the seek table does not list every frame")
    return total, digest, points, len(stream)


def decode(streams: list[bytes]) -> tuple[list[bytes], list[list[tuple[int, int, int]]]]:
    """(payloads, blocks): unsigned 8-bit samples of each stream, and (sample offset, byte offset, samples) of its frames.

    Checks every frame header's CRC-8, every frame's CRC-16 and every stream's MD5.
    """
    meta = [_frames(s) for s in streams]
    data = np.frombuffer(b"".join(streams), np.uint8)
    begin = np.cumsum([0, *map(len, streams)])
    start, size, last = [], [], []
    for b, (_, _, points, end) in zip(begin[:-1].tolist(), meta, strict=True):
        for i, (_, byte, n) in enumerate(points):
            start.append(b + byte)
            size.append(n)
            last.append(b + (points[i + 1][1] if i + 1 < len(points) else end))
    start, size, last = (np.array(v, np.int64) for v in (start, size, last))
    crc = _crc16_of(data, start, last - start - 2)
    if not np.array_equal(crc, data[last - 2].astype(np.int64) << 8 | data[last - 1]):
        raise ValueError("frame checksum (CRC-16) mismatch")
    body = np.empty(len(start), np.int64)
    for f, s in enumerate(start.tolist()):
        lead = int(data[s + 4])
        n = 1 if lead < 0x80 else 8 - (~lead & 0xFF).bit_length()
        head = data[s : s + 6 + n].tobytes()
        if head[:2] != b"\xff\xf8" or head[2] >> 4 != 7 or _crc8_of(head) != data[s + 6 + n] or int.from_bytes(head[-2:], "big") + 1 != size[f]:
            raise ValueError("frame header (CRC-8) mismatch")
        body[f] = s + 7 + n

    out_end = np.cumsum(size)
    out = np.zeros(int(out_end[-1]), np.int64)
    out_start = out_end - size
    code = data[body].astype(np.int64) >> 1
    signed = lambda b: b.astype(np.int8).astype(np.int64)
    for f in np.flatnonzero(code == 0):
        out[out_start[f] : out_end[f]] = signed(data[body[f] + 1 : body[f] + 2])[0]
    for f in np.flatnonzero(code == 1):
        out[out_start[f] : out_end[f]] = signed(data[body[f] + 1 : body[f] + 1 + size[f]])
    own = np.flatnonzero(code >= 8)
    if own.size:
        own = own[np.argsort(-size[own], kind="stable")]  # longest first: the active ones are a prefix
        bits = np.unpackbits(data)
        _predicted(bits, data, out, out_start[own], size[own], body[own], code[own])
    samples = (out + 128).astype(np.uint8)
    payloads, blocks, at = [], [], 0
    for total, digest, points, _ in meta:
        p = samples[at : at + total]
        if hashlib.md5((p ^ 0x80).tobytes()).digest() != digest:
            raise ValueError("stream MD5 mismatch")
        payloads.append(p.tobytes())
        blocks.append(points)
        at += total
    return payloads, blocks


def _predicted(bits: np.ndarray, data: np.ndarray, out: np.ndarray, out_start: np.ndarray, size: np.ndarray, body: np.ndarray, code: np.ndarray) -> None:
    """FIXED and LPC frames, in lockstep; sizes descend."""
    lpc = code >= 32
    order = np.where(lpc, code - 31, code - 8)
    most, n_max, frames = int(order.max()), int(size[0]), len(size)
    p = 8 * (body + 1 + order)

    def read(where: np.ndarray, width: int) -> np.ndarray:
        v = np.zeros(len(where), np.int64)
        for b in range(width):
            v = v << 1 | bits[where + b]
        return v

    coef, shift = np.zeros((max(most, 1), frames), np.int64), np.zeros(frames, np.int64)
    for n in range(1, min(4, most) + 1):
        coef[:n, ~lpc & (order == n)] = np.array(_FIXED[n])[:, None]
    for width, n in {(int(w), int(n)) for w, n in zip(read(p[lpc], 4), order[lpc], strict=True)}:
        own = np.flatnonzero(lpc & (order == n))
        own = own[read(p[own], 4) == width]
        shift[own] = read(p[own] + 4, 5)
        for i in range(n):
            v = read(p[own] + 9 + (width + 1) * i, width + 1)
            coef[i, own] = v - (v >> width << (width + 1))
        p[own] += 9 + (width + 1) * n
    if (read(p, 2) != 0).any():
        raise ValueError("only 4-bit Rice parameters are read")
    partition = size >> read(p + 2, 4)
    p = p + 6
    k = np.zeros(frames, np.int64)
    # the next 1 at or after a position: ones[number of ones before it]
    ones = np.flatnonzero(bits)
    before = np.cumsum(bits, dtype=np.int32)
    before -= bits
    begins = np.zeros((n_max, frames), np.int32)
    params = np.zeros((n_max, frames), np.int8)
    active = np.searchsorted(-size, -np.arange(n_max), "left")  # frames with more than i samples
    uniform = bool((partition == size).all())
    for i in range(n_max):
        a = int(active[i])
        if i <= most or not uniform:
            q = slice(0, a)
            new = np.flatnonzero((i == order[q]) | ((i % partition[q] == 0) & (i > order[q])))
            if new.size:
                k[new] = read(p[new], 4)
                if (k[new] == 15).any():
                    raise ValueError("escaped partitions are not read")
                p[new] += 4
            params[i, :a] = k[:a]
            on = np.flatnonzero(i >= order[q])
            begins[i, on] = p[on]
            p[on] = ones[before[p[on]]] + 1 + k[on]
            continue
        now = p[:a]
        begins[i, :a] = now
        now[:] = ones[before[now]]
        now += k[:a]
        now += 1
    if uniform:
        params[most + 1 :] = k
    # frame by frame from here on: place of each code, its quotient and its remainder
    valid = np.arange(n_max) < size[:, None]
    start, width = begins.T[valid].astype(np.int64), params.T[valid].astype(np.int64)
    del begins, params
    stop = ones[before[start]]
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
    window = padded[:-2] << 16 | padded[1:-1] << 8 | padded[2:]
    after = stop + 1
    low = window[after >> 3] >> (24 - (after & 7) - width) & ((1 << width) - 1)
    u = (stop - start) << width | low
    r = (u >> 1) ^ -(u & 1)
    ends = np.cumsum(size)
    first = ends - size
    for j in range(most):  # warm-up samples stand in the stream
        has = np.flatnonzero(order > j)
        r[first[has] + j] = data[body[has] + 1 + j].astype(np.int8)
    if most:
        moving = np.flatnonzero(order > 0)
        s = np.zeros((n_max, len(moving)), np.int64)
        own = valid[moving]
        picked = np.repeat(order > 0, size)
        s.T[own] = r[picked]
        c, sh, o = coef[:, moving], shift[moving], order[moving]
        count = np.searchsorted(-size[moving], -np.arange(n_max), "left")
        for i in range(1, n_max):
            a = int(count[i])
            if i <= most:
                go = np.flatnonzero(o[:a] <= i)
                guess = sum(c[j, go] * s[i - 1 - j, go] for j in range(min(i, most)))
                s[i, go] += guess >> sh[go]
                continue
            guess = c[0, :a] * s[i - 1, :a]
            for j in range(1, most):
                guess += c[j, :a] * s[i - 1 - j, :a]
            guess >>= sh[:a]
            s[i, :a] += guess
        r[picked] = s.T[own]
    out[np.repeat(out_start - first, size) + np.arange(len(r))] = r
