"""FLAC for 8-bit mono streams, many frames side by side.

Frames are lanes: all frames of a batch of streams are predicted, coded, checked and decoded
together, one numpy step for each sample of a block. A stream has a seek point for every
frame, which also lets a reader start all of them at once; streams without a seek table are
read frame by frame. Encoding uses constant, fixed (orders 0 to 4) and linear predictors
(order 4) with one Rice partition. Decoding also takes verbatim subframes, other orders,
several partitions and escaped ones. Header and frame checksums and the sample digest are
verified.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cache

import numpy as np

BLOCK, ORDER, PRECISION = 512, 4, 12
SAMPLE_RATE = 8000
#: Frames decoded or encoded at once.
LANES = 4096
#: Longest run of unary zeros that the encoder writes.
MAX_UNARY = 40
#: Checksum polynomials; coefficients of the fixed predictors by order.
CRC8_POLY, CRC16_POLY = 0x07, 0x8005
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


class FlacError(ValueError):
    """The stream breaks the format, or a checksum does not match."""


@cache
def _crc_table(poly: int, bits: int) -> np.ndarray:
    table = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        table = np.where(table >> (bits - 1), table << 1 ^ poly, table << 1) & ((1 << bits) - 1)
    return table


def crc8(raw: bytes) -> int:
    table, crc = _crc_table(CRC8_POLY, 8), 0
    for b in raw:
        crc = int(table[crc ^ b])
    return crc


def crc16(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Checksums of many byte ranges, longest first internally so that lanes end in order."""
    table = _crc_table(CRC16_POLY, 16)
    order = np.argsort(-sizes, kind="stable")
    at, crc = starts[order], np.zeros(len(starts), dtype=np.int64)
    active = len(at) - np.searchsorted(sizes[order][::-1], np.arange(sizes.max(initial=0)), "right")
    for i, n in enumerate(active.tolist()):
        crc[:n] = table[(crc[:n] >> 8) ^ buffer[at[:n] + i]] ^ (crc[:n] << 8 & 0xFF00)
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _coded_number(n: int) -> bytes:
    """A frame number in the variable-length code of the frame header."""
    if n < 0x80:
        return bytes([n])
    tail = []
    while n >= 1 << (6 - len(tail)):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    lead = (0xFF << (7 - len(tail))) & 0xFF | n
    return bytes([lead, *tail[::-1]])


@cache
def frame_header(number: int, size: int) -> bytes:
    code, extra = (9, b"") if size == BLOCK else (6, bytes([size - 1])) if size <= 256 else (7, (size - 1).to_bytes(2, "big"))
    head = bytes([0xFF, 0xF8, code << 4, 0x02]) + _coded_number(number) + extra
    return head + bytes([crc8(head)])


def _put(out: np.ndarray, end: np.ndarray, value: np.ndarray) -> None:
    """Add values of at most 17 bits into ``out`` (bytes) so that they end before bit ``end``."""
    last, value = (end - 1) >> 3, value << (-end & 7)
    for back in range(3):
        if back and not (value >> 8 * back).any():
            break
        byte = value >> 8 * back & 0xFF
        if byte.ndim and len(byte) > 64:
            top = int(last.max()) - back + 1
            out[:top] += np.bincount((last - back).ravel(), byte.ravel(), top)[:top].astype(np.uint8) if last.min() >= back else 0
        else:
            np.add.at(out, last - back, byte.astype(np.uint8))


def linear_predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (lanes, ORDER) and shifts, by the Levinson recursion."""
    f = x.astype(np.float32)
    r = np.stack([np.einsum("ij,ij->i", f[:, : x.shape[1] - k], f[:, k:]) for k in range(ORDER + 1)], 1).astype(np.float64)
    error = r[:, 0] * (1 + 1e-5) + 1e-9
    a = np.zeros((len(x), ORDER))
    for i in range(ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / error
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        error *= np.maximum(1e-9, 1 - k * k)
    most = (1 << (PRECISION - 1)) - 1
    shift = np.clip(np.floor(np.log2(most / np.maximum(1e-9, np.abs(a).max(1)))), 0, 14).astype(np.int64)
    return np.clip(np.rint(a * (1 << shift)[:, None]), -most, most).astype(np.int64), shift


def _zigzag(r: np.ndarray) -> np.ndarray:
    return r << 1 ^ r >> 31


def encode_frames(blocks: np.ndarray, sizes: np.ndarray, headers: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of frames laid end to end, and the end of each. ``blocks`` is (lanes, BLOCK)
    of signed samples, of which lane i uses the first sizes[i] (64 at least)."""
    lanes = len(blocks)
    x = blocks.astype(np.int32)
    place = np.arange(BLOCK)
    # residuals of each kind of predictor; positions before the order are warm-up samples
    residual, best, cost = None, np.zeros(lanes, dtype=np.int64), None
    coefficients, shift = linear_predictors(np.where(place < sizes[:, None], x, 0))
    predicted = sum(coefficients[:, j, None].astype(np.int32) * x[:, ORDER - 1 - j : BLOCK - 1 - j] for j in range(ORDER)) >> shift[:, None].astype(np.int32)
    linear = np.concatenate([np.zeros((lanes, ORDER), np.int32), x[:, ORDER:] - predicted], 1)
    difference = x
    for kind in range(len(FIXED) + 1):  # 0 to 4: fixed; 5: linear
        if 0 < kind < len(FIXED):
            difference = np.concatenate([np.zeros((lanes, 1), np.int32), np.diff(difference, axis=1)], 1)
        r = linear if kind == len(FIXED) else difference
        order = ORDER if kind == len(FIXED) else kind
        u = np.where((place >= order) & (place < sizes[:, None]), _zigzag(r), 0)
        total = u.sum(1, dtype=np.int64) + (PRECISION * ORDER // 2 if kind == len(FIXED) else 0)
        if cost is None:
            residual, cost = u, total
        else:
            less = total < cost
            residual = np.where(less[:, None], u, residual)
            best, cost = np.where(less, kind, best), np.minimum(cost, total)
    order = np.where(best == len(FIXED), ORDER, best)
    constant = ((x == x[:, :1]) | (place >= sizes[:, None])).all(1)
    used = (place >= order[:, None]) & (place < sizes[:, None]) & ~constant[:, None]
    mean = cost / np.maximum(1, sizes - order)
    k = np.clip(np.floor(np.log2(mean * 0.75 + 1)), 0, 14).astype(np.int64)
    k = np.maximum(k, np.frexp(residual.max(1).astype(np.float64))[1] - 5).clip(0, 14)
    code_bits = np.where(used, (residual >> k[:, None].astype(np.int32)) + 1 + k[:, None], 0)

    head_bits = 8 * np.fromiter(map(len, headers), np.int64, lanes)
    is_linear = best == len(FIXED)
    side = np.where(constant, 0, np.where(is_linear, 9 + PRECISION * ORDER, 0) + 10)
    warm = np.where(constant, 1, order)
    code_start = head_bits + 8 + 8 * warm + side
    total_bits = code_start + code_bits.sum(1)
    sizes_out = (total_bits + 7) // 8 + 2
    ends = np.cumsum(sizes_out)
    begin = ends - sizes_out
    out = np.zeros(int(ends[-1]), dtype=np.uint8)
    raw = b"".join(headers)
    lens = head_bits // 8
    out[np.repeat(begin, lens) + np.arange(len(raw)) - np.repeat(np.cumsum(lens) - lens, lens)] = np.frombuffer(raw, np.uint8)
    body = 8 * begin + head_bits
    kind = np.where(constant, 0, np.where(is_linear, 32 | (ORDER - 1), 8 | best))
    out[body >> 3] = kind << 1
    for j in range(ORDER):
        has = j < warm
        out[(body[has] >> 3) + 1 + j] = x[has, j] & 0xFF
    at = body + 8 + 8 * warm
    some = np.flatnonzero(is_linear & ~constant)
    if len(some):
        _put(out, at[some] + 9, (PRECISION - 1) << 5 | shift[some])
        for j in range(ORDER):
            _put(out, at[some] + 9 + PRECISION * (j + 1), coefficients[some, j] & ((1 << PRECISION) - 1))
    some = np.flatnonzero(~constant)
    if len(some):
        _put(out, 8 * begin[some] + code_start[some], k[some])  # method 0, partition order 0, parameter
    code_end = 8 * begin[:, None] + code_start[:, None] + np.cumsum(code_bits, axis=1)
    kk = np.broadcast_to(k[:, None], used.shape)[used]
    _put(out, code_end[used], (1 << kk) | (residual[used] & ((1 << kk) - 1)))
    crc = crc16(out, begin, sizes_out - 2)
    out[ends - 2], out[ends - 1] = crc >> 8, crc & 0xFF
    return out, ends


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload; bytes are samples less 128. Payloads hold a positive
    multiple of 64 bytes."""
    numbers = [(i, n) for i, p in enumerate(payloads) for n in range(-(-len(p) // BLOCK))]
    frames: list[list[bytes]] = [[] for _ in payloads]
    for start in range(0, len(numbers), LANES):
        some = numbers[start : start + LANES]
        sizes = np.array([min(BLOCK, len(payloads[i]) - n * BLOCK) for i, n in some])
        raw = b"".join(payloads[i][n * BLOCK : (n + 1) * BLOCK].ljust(BLOCK, b"\x80") for i, n in some)
        blocks = np.frombuffer(raw, np.uint8).reshape(-1, BLOCK).astype(np.int32) - 128
        out, ends = encode_frames(blocks, sizes, [frame_header(n, s) for (_, n), s in zip(some, sizes.tolist(), strict=True)])
        whole, at = out.tobytes(), 0
        for (i, _), end in zip(some, ends.tolist(), strict=True):
            frames[i].append(whole[at:end])
            at = end
    return [_stream(p, f) for p, f in zip(payloads, frames, strict=True)]


def _stream(payload: bytes, frames: list[bytes]) -> bytes:
    signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
    lens = [len(f) for f in frames]
    info = BLOCK.to_bytes(2, "big") * 2 + min(lens).to_bytes(3, "big") + max(lens).to_bytes(3, "big")
    info += (SAMPLE_RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(signed).digest()
    n = np.arange(len(frames))
    points = np.zeros(len(frames), dtype=[("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")])
    points["sample"], points["offset"] = n * BLOCK, np.cumsum([0, *lens[:-1]])
    points["size"] = np.minimum(BLOCK, len(payload) - n * BLOCK)
    seek = points.tobytes()
    return b"".join([b"fLaC", bytes([0]), len(info).to_bytes(3, "big"), info, bytes([0x83]), len(seek).to_bytes(3, "big"), seek, *frames])


@dataclass
class Stream:
    raw: bytes
    samples: int
    digest: bytes
    frames_at: int
    points: np.ndarray  # of the seek table: sample, offset, size


def open_stream(raw: bytes) -> Stream:
    if raw[:4] != b"fLaC":
        raise FlacError("no stream marker")
    at, final, info, seek = 4, False, None, b""
    while not final:
        kind, size = raw[at] & 0x7F, int.from_bytes(raw[at + 1 : at + 4], "big")
        final = bool(raw[at] & 0x80)
        block = raw[at + 4 : at + 4 + size]
        if kind == 0:
            info = block
        elif kind == 3:
            seek = block
        at += 4 + size
    if info is None:
        raise FlacError("no stream information")
    packed = int.from_bytes(info[10:18], "big")
    if packed >> 41 & 7 or (packed >> 36 & 31) != 7:
        raise FlacError("only 8-bit mono streams are read")
    points = np.frombuffer(seek, dtype=[("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")])
    return Stream(raw, packed & (1 << 36) - 1, info[18:34], at, points[points["sample"] != 0xFFFFFFFFFFFFFFFF])


def read_header(raw: bytes, at: int) -> tuple[int, int]:
    """(bytes of the frame header, samples of the block), its checksum verified."""
    if raw[at] != 0xFF or raw[at + 1] & 0xFE != 0xF8:
        raise FlacError(f"no frame at byte {at}")
    code, lead = raw[at + 2] >> 4, raw[at + 4]
    size = 5 if lead < 0x80 else 4 + 8 - (lead ^ 0xFF).bit_length()
    extra = raw[at + size : at + size + 2]
    if code == 6:
        samples, size = extra[0] + 1, size + 1
    elif code == 7:
        samples, size = int.from_bytes(extra, "big") + 1, size + 2
    elif code >= 8:
        samples = 256 << (code - 8)
    elif code == 1:
        samples = 192
    elif code:
        samples = 576 << (code - 2)
    else:
        raise FlacError("reserved block size")
    size += {12: 1, 13: 2, 14: 2}.get(raw[at + 2] & 15, 0)
    _checked_header(raw[at : at + size + 1])
    return size + 1, samples


@cache
def _checked_header(head: bytes) -> None:
    if crc8(head[:-1]) != head[-1]:
        raise FlacError("header checksum")


class Bits:
    """Bit reads at many positions of one buffer."""

    def __init__(self, raw: bytes):
        self.bytes = np.frombuffer(raw + bytes(16), np.uint8)
        self.words = np.ndarray((len(self.bytes) - 7,), dtype=">u8", buffer=self.bytes, strides=(1,))

    def window(self, at: np.ndarray) -> np.ndarray:
        """The next 57 bits or more, from the top of a 64-bit word."""
        return self.words[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)

    def read(self, at: np.ndarray, bits) -> np.ndarray:
        bits = np.broadcast_to(np.asarray(bits, dtype=np.uint64), at.shape)
        got = self.window(at) >> np.uint64(1) >> (np.uint64(63) - bits)
        return np.where(bits > 0, got, 0).astype(np.int64)

    def signed(self, at: np.ndarray, bits) -> np.ndarray:
        got = self.read(at, bits)
        return got - (got >> (bits - 1) << bits)


def decode_frames(bits: Bits, starts: np.ndarray, samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (lanes, longest block) and the bit where each frame's body ends. ``starts``
    are the bits where subframes begin."""
    lanes, width = len(starts), int(samples.max())
    kind = bits.read(starts, 8)
    if (kind & 0x81).any():
        raise FlacError("wasted bits or padding in a subframe header")
    kind >>= 1
    out = np.zeros((lanes, width), dtype=np.int64)
    at = starts + 8
    linear, fixed = kind >= 32, (kind >= 8) & (kind <= 12)
    if (~linear & ~fixed & (kind > 1)).any():
        raise FlacError("reserved subframe type")
    order = np.where(linear, (kind & 31) + 1, np.where(fixed, kind & 7, 0))
    warm = np.where(kind == 0, 1, np.where(kind == 1, samples, order))
    for j in range(int(warm.max())):
        has = np.flatnonzero(j < warm)
        out[has, j] = bits.signed(at[has], 8)
        at[has] += 8
    constant = kind == 0
    out[constant] = out[constant, :1]
    coefficients, shift = np.zeros((lanes, 32), dtype=np.int64), np.zeros(lanes, dtype=np.int64)
    some = np.flatnonzero(linear)
    if len(some):
        precision, shift[some] = bits.read(at[some], 4) + 1, bits.read(at[some] + 4, 5)
        at[some] += 9
        for j in range(int(order[some].max())):
            has = some[j < order[some]]
            p = precision[j < order[some]]
            got = bits.read(at[has], p)
            coefficients[has, j] = got - (got >> (p - 1) << p)
            at[has] += p
    coded = np.flatnonzero(linear | fixed)
    if len(coded):
        residual, at[coded] = rice_residuals(bits, at[coded], samples[coded], order[coded], width)
        restore(out, coded, residual, order, samples, linear, coefficients, shift)
    return out, at


def rice_residuals(bits: Bits, at: np.ndarray, samples: np.ndarray, order: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Residuals of all lanes, placed from each lane's order on."""
    method, parts = bits.read(at, 2), bits.read(at + 2, 4)
    if (method > 1).any():
        raise FlacError("reserved residual coding")
    at = at + 6
    count = samples - order
    sort = np.argsort(-count, kind="stable")
    at, width, parts, part_size, order, count = at[sort], 4 + method[sort], parts[sort], samples[sort] >> parts[sort], order[sort], count[sort]
    out = np.zeros((len(at), columns), dtype=np.int64)
    boundary = np.zeros(len(at), dtype=np.int64)  # residual number at which a partition begins
    k, escape = np.zeros(len(at), dtype=np.int64), np.full(len(at), -1)
    active = len(count) - np.searchsorted(count[::-1], np.arange(int(count.max())), "right")
    more = 0
    for j, n in enumerate(active.tolist()):
        if j == more:
            new = np.flatnonzero(boundary[:n] == j)
            k[new] = bits.read(at[new], width[new])
            at[new] += width[new]
            raw = new[k[new] == (1 << width[new]) - 1]
            escape[new] = -1
            escape[raw] = bits.read(at[raw], 5)
            at[raw] += 5
            boundary[new] += part_size[new] - np.where(boundary[new] == 0, order[new], 0)
            more = int(boundary[:n].min())
            special = bool((escape >= 0).any())
        window = bits.window(at[:n])
        zeros = 53 - np.frexp((window >> np.uint64(11)).astype(np.float64))[1].astype(np.int64)
        if (zeros >= 53).any() and not special:
            value = _long_unary(bits, at[:n], k[:n])
        else:
            kn = k[:n]
            low = zeros + 1
            if (low + kn).max() <= 57:
                tail = ((window << low.astype(np.uint64)) >> np.uint64(1) >> (63 - kn).astype(np.uint64)).astype(np.int64)
            else:
                tail = bits.read(at[:n] + low, kn)
            value = zeros << kn | np.where(kn > 0, tail, 0)
            if special:
                raw = np.flatnonzero(escape[:n] >= 0)
                low[raw] = 0
                got = bits.read(at[raw], escape[raw])
                e = np.maximum(1, escape[raw])
                got -= got >> (e - 1) << e
                value[raw] = got << 1 ^ got >> 63
                at[:n] += low + np.where(escape[:n] >= 0, escape[:n], kn)
            else:
                at[:n] += low + kn
        out[np.arange(n), order[:n] + j] = value >> 1 ^ -(value & 1)
    back = np.empty_like(sort)
    back[sort] = np.arange(len(sort))
    return out[back], at[back]


def _long_unary(bits: Bits, at: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Values where some unary part is longer than a window; ``at`` is advanced."""
    zeros, open_ = np.zeros(len(at), dtype=np.int64), np.arange(len(at))
    while len(open_):
        got = 53 - np.frexp((bits.window(at[open_]) >> np.uint64(11)).astype(np.float64))[1].astype(np.int64)
        zeros[open_] += np.minimum(got, 53)
        at[open_] += np.where(got < 53, got + 1, 53)
        open_ = open_[got >= 53]
    value = zeros << k | bits.read(at, k)
    at += k
    return value


def restore(out, coded, residual, order, samples, linear, coefficients, shift) -> None:
    """Fill ``out[coded]`` from residuals and predictors."""
    place = np.arange(out.shape[1])
    for p in np.unique(order[coded[~linear[coded]]]):
        own = (order[coded] == p) & ~linear[coded]
        r = residual[own]
        r[:, :p] = 0
        # differences of warm-up samples begin each summation
        start = out[coded[own], :p]
        for level in range(p, 0, -1):
            begin = np.diff(start, n=level - 1, axis=1)[:, 0]
            r = np.cumsum(np.concatenate([np.zeros((len(r), level - 1), np.int64), begin[:, None], r[:, level:]], 1), axis=1)
        r[:, :p] = start
        out[coded[own]] = np.where(place < samples[coded[own]][:, None], r, 0)
    own = np.flatnonzero(linear[coded])
    if not len(own):
        return
    lanes, most = coded[own], int(order[coded[own]].max())
    history = np.zeros((most, len(own)), dtype=np.int64)  # the last samples, newest first
    c, s, p = coefficients[lanes, :most].T.copy(), shift[lanes], order[lanes]
    x, r = out[lanes].T.copy(), residual[own].T.copy()
    for i in range(x.shape[0]):
        if i < most:
            x[i] = np.where(i < p, x[i], r[i] + ((c * history).sum(0) >> s))
        else:
            x[i] = r[i] + (np.einsum("ij,ij->j", c, history) >> s)
        history[1:] = history[:-1]
        history[0] = x[i]
    out[lanes] = np.where(place < samples[lanes][:, None], x.T, 0)


def decode(streams: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """(payload, seek points) of each stream, checked against its digest."""
    opened = [open_stream(s) for s in streams]
    pieces: list[list[bytes]] = [[] for _ in streams]
    lanes = []
    for i, s in enumerate(opened):
        if len(s.points) and s.points["sample"][0] == 0 and int(s.points["size"].sum()) == s.samples:
            lanes.extend((i, s.frames_at + int(o)) for o in s.points["offset"])
        else:
            pieces[i] = _one_by_one(s)
    for start in range(0, len(lanes), LANES):
        _decode_lanes(opened, lanes[start : start + LANES], pieces)
    out = []
    for s, p in zip(opened, pieces, strict=True):
        signed = b"".join(p)
        if len(signed) != s.samples or hashlib.md5(signed).digest() != s.digest:
            raise FlacError("sample digest")
        out.append(((np.frombuffer(signed, np.uint8) ^ 0x80).tobytes(), s.points))
    return out


def _decode_lanes(opened: list[Stream], lanes: list[tuple[int, int]], pieces: list[list[bytes]]) -> np.ndarray:
    """Decode frames (stream, byte) into pieces; returns the byte after each frame."""
    used = dict.fromkeys(i for i, _ in lanes)
    base, buffers, size = {}, [], 0
    for i in used:
        base[i] = size
        buffers.append(opened[i].raw)
        size += len(opened[i].raw)
    bits = Bits(b"".join(buffers))
    heads = [read_header(opened[i].raw, at) for i, at in lanes]
    begin = np.array([base[i] + at for i, at in lanes])
    samples = np.array([h[1] for h in heads])
    out, at = decode_frames(bits, 8 * (begin + [h[0] for h in heads]), samples)
    end = (at + 7) >> 3
    if (crc16(bits.bytes, begin, end - begin) != (bits.bytes[end].astype(np.int64) << 8 | bits.bytes[end + 1])).any():
        raise FlacError("frame checksum")
    signed = out.astype(np.int8)
    for (i, _), row, n in zip(lanes, signed, samples.tolist(), strict=True):
        pieces[i].append(row[:n].tobytes())
    return end + 2 - [base[i] for i, _ in lanes]


def _one_by_one(s: Stream) -> list[bytes]:
    at, pieces, got = s.frames_at, [[]], 0
    while got < s.samples:
        at = int(_decode_lanes([s], [(0, at)], pieces)[0])
        got += len(pieces[0][-1])
    return pieces[0]
