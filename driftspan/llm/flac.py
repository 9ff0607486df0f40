"""FLAC for 8-bit mono samples, vectorised over frames of equal length.

Written: STREAMINFO with the MD5 of the samples, a SEEKTABLE, and frames of 192 samples, each with the
cheapest of a constant, a fixed predictor of order 0 to 4, a quantised linear predictor or verbatim samples, Rice-coded in one
partition, with CRC-8 of the header and CRC-16 of the frame. Read: the same subframe kinds, all checksums
verified. Both directions loop over positions within a frame and treat all frames of a batch of
streams at once, so a stream's length costs no Python work per sample.
"""

from dataclasses import dataclass
from hashlib import md5

import numpy as np

BLOCK = 192
SEEK_EVERY = 64
SLICE = 4096
LPC_ORDER, LPC_BITS, LPC_SHIFT = 4, 12, 9
# Rows of the fixed predictors of FLAC, orders 0 to 4.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
MAX_RICE = 14


def _crc_table(bits: int, polynomial: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        table = np.where(table >> (bits - 1) & 1, table << 1 ^ polynomial, table << 1) & ((1 << bits) - 1)
    return table


CRC8, CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def _crc(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, wide: bool) -> np.ndarray:
    """CRC-16 (or CRC-8) of many stretches of data at once."""
    order = np.argsort(-lengths, kind="stable")
    starts, longest, crc = starts[order], lengths[order], np.zeros(len(starts), np.uint32)
    live = len(starts)
    for i in range(int(longest[0]) if len(longest) else 0):
        while live and longest[live - 1] <= i:
            live -= 1
        b, c = data[starts[:live] + i], crc[:live]
        crc[:live] = (c << 8 & 0xFFFF) ^ CRC16[c >> 8 ^ b] if wide else CRC8[c ^ b]
    out = np.zeros_like(crc)
    out[order] = crc
    return out


def _frame_number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The coded frame numbers, 6 bytes a row, and how many of the bytes count."""
    n = n.astype(np.int64)
    size = 1 + sum((n >= limit).astype(int) for limit in (1 << 7, 1 << 11, 1 << 16, 1 << 21, 1 << 26))
    out = np.zeros((len(n), 6), np.uint8)
    for k in range(1, 7):
        own = size == k
        v = n[own]
        if k == 1:
            out[own, 0] = v
        else:
            for j in range(k):
                bits = v >> 6 * (k - 1 - j)
                out[own, j] = (256 - (1 << 8 - k)) | bits if j == 0 else 128 | bits & 63
    return out, size


def _residual(x: np.ndarray, order: int) -> np.ndarray:
    return np.diff(x, n=order, axis=1) if order else x


def _fold(residual: np.ndarray) -> np.ndarray:
    """Signed to unsigned: 0, -1, 1, -2 ... become 0, 1, 2, 3 ..."""
    return residual << 1 ^ residual >> 31


def _rice(folded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parameter, bits) of the cheaper Rice codes of each row, near the logarithm of its mean."""
    middle = np.log2(folded.mean(1) + 1).astype(np.int32)
    choices = np.stack([(middle + d).clip(0, MAX_RICE) for d in (-1, 0)])
    costs = np.stack([(folded >> k[:, None]).sum(1) + (k + 1) * folded.shape[1] for k in choices])
    best, row = costs.argmin(0), np.arange(len(folded))
    return choices[best, row], costs[best, row]


def _predictors(x: np.ndarray) -> np.ndarray:
    """Quantised coefficients of order LPC_ORDER of each row, by its autocorrelation (Levinson-Durbin)."""
    y = x.astype(np.float32)
    lags = np.stack([np.einsum("ij,ij->i", y[:, k:], y[:, : y.shape[1] - k]) for k in range(LPC_ORDER + 1)], 1).astype(float)
    error, a = np.maximum(lags[:, 0], 1e-9), np.zeros((len(x), LPC_ORDER))
    for i in range(LPC_ORDER):
        k = (lags[:, i + 1] - (a[:, :i] * lags[:, i:0:-1]).sum(1)) / error
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1].copy()
        a[:, i] = k
        error = np.maximum(error * (1 - k * k), 1e-9)
    limit = (1 << LPC_BITS - 1) - 1
    return np.clip(np.rint(a * (1 << LPC_SHIFT)), -limit, limit).astype(np.int32)


def _lpc_residual(x: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    guess = sum(coefficients[:, j : j + 1] * x[:, LPC_ORDER - 1 - j : n - 1 - j] for j in range(LPC_ORDER))
    return x[:, LPC_ORDER:] - (guess >> LPC_SHIFT)


class _Bits:
    """Bits of many rows of one layout: each field has the same place in the order, not the same width.

    Of a field wider than 16 bits only the last 16 may be set.
    """

    def __init__(self, rows: int):
        self.rows, self.values, self.widths = rows, [], []

    def put(self, value: np.ndarray | int, width: np.ndarray | int) -> None:
        """Columns of a matrix are fields in turn; a width of 0 leaves a field out."""
        value = np.asarray(value)
        value = np.broadcast_to(value[:, None] if value.ndim == 1 else value, (self.rows, value.shape[1] if value.ndim == 2 else 1)).astype(np.int32)
        width = np.asarray(width)
        self.values.append(value)
        self.widths.append(np.broadcast_to(width[:, None] if width.ndim == 1 else width, value.shape).astype(np.int32))

    def pack(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all rows in turn, each row padded to whole bytes; bytes of each row)"""
        value, width = np.concatenate(self.values, 1), np.concatenate(self.widths, 1)
        ends = np.cumsum(width, 1)
        sizes = -(-ends[:, -1] // 8)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        last = (begin[:-1, None] * 8 + ends - 1).ravel()
        shifted, at = value.ravel() << (7 - (last & 7)), (last >> 3) + 2  # no two fields share a bit, so sums do
        total = np.zeros(begin[-1] + 3)
        for j in range(3):
            total += np.bincount(at - j, shifted >> 8 * j & 255, minlength=len(total))
        return total[2:-1].astype(np.uint8), sizes


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, whose length must be a positive multiple of BLOCK; a byte b is the sample b - 128."""
    if any(not p or len(p) % BLOCK for p in payloads):
        raise ValueError(f"payloads must be positive multiples of {BLOCK} bytes")
    if not payloads:
        return []
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    frames = np.array([len(p) // BLOCK for p in payloads])
    first = np.concatenate([[0], np.cumsum(frames)])
    numbers = np.arange(len(samples)) - np.repeat(first[:-1], frames)
    parts = [_encode_frames(samples[i : i + SLICE].astype(np.int32) - 128, numbers[i : i + SLICE]) for i in range(0, len(samples), SLICE)]
    raw, sizes = b"".join(p[0] for p in parts), np.concatenate([p[1] for p in parts])
    start = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for i, payload in enumerate(payloads):
        lo, hi = first[i], first[i + 1]
        own = sizes[lo:hi]
        info = BLOCK.to_bytes(2, "big") * 2 + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big")
        info += (8000 << 44 | 7 << 36 | len(payload)).to_bytes(8, "big") + md5(_flip(payload)).digest()
        points = np.arange(0, hi - lo, SEEK_EVERY)
        seek = b"".join((int(p) * BLOCK).to_bytes(8, "big") + int(start[lo + p] - start[lo]).to_bytes(8, "big") + BLOCK.to_bytes(2, "big") for p in points)
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + raw[start[lo] : start[hi]])
    return out


def _flip(data: bytes) -> bytes:
    """Bytes from or to signed samples."""
    return (np.frombuffer(data, np.uint8) ^ 128).tobytes()


def _encode_frames(x: np.ndarray, numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(frames in turn, their sizes) of rows of samples."""
    number, number_size = _frame_number(numbers)
    coefficients = _predictors(x)
    residuals = [_residual(x, k) for k in range(5)] + [_lpc_residual(x, coefficients)]
    extra = np.array([0, 8, 16, 24, 32, 8 * LPC_ORDER + 9 + LPC_BITS * LPC_ORDER])[:, None]
    mean = np.stack([np.abs(r).sum(1) / r.shape[1] for r in residuals])
    kind = (np.log2(mean + 0.5) * BLOCK + extra).argmin(0)
    rice = np.zeros(len(x), np.int32)
    for k in range(6):
        own = np.flatnonzero(kind == k)
        if len(own):
            rice[own], cost = _rice(_fold(residuals[k][own]))
            kind[own[cost + extra[k] + 10 >= 8 * BLOCK]] = 6
    kind[(x == x[:, :1]).all(1)] = 7

    bodies: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for k in np.unique(kind):
        own = np.flatnonzero(kind == k)
        bits, s = _Bits(len(own)), x[own]
        bits.put(0xFFF8, 16)  # synchronisation, fixed block size
        bits.put(0x10, 8)  # 192 samples, the rate of STREAMINFO
        bits.put(0x02, 8)  # one channel, 8 bits a sample
        bits.put(number[own], 8 * (np.arange(6) < number_size[own, None]))
        bits.put(0, 8)  # CRC-8, set below
        bits.put({6: 2, 7: 0, 5: 2 * (32 + LPC_ORDER - 1)}.get(int(k), 2 * (8 + int(k))), 8)
        if k >= 6:
            bits.put(s[:, : 1 if k == 7 else BLOCK] & 255, 8)
        else:
            order = LPC_ORDER if k == 5 else int(k)
            bits.put(s[:, :order] & 255, 8) if order else None
            if k == 5:
                bits.put(LPC_BITS - 1, 4)
                bits.put(LPC_SHIFT, 5)
                bits.put(coefficients[own] & (1 << LPC_BITS) - 1, LPC_BITS)
            bits.put(0, 6)  # Rice codes with 4-bit parameters, one partition
            p, folded = rice[own][:, None], _fold(residuals[k][own])
            bits.put(p, 4)
            bits.put(1 << p | folded & (1 << p) - 1, (folded >> p) + 1 + p)
        bodies.append((own, *bits.pack()))

    sizes = np.zeros(len(x), np.int64)
    for own, _, n in bodies:
        sizes[own] = n + 2
    start = np.concatenate([[0], np.cumsum(sizes)])
    data = np.zeros(start[-1], np.uint8)
    for own, body, n in bodies:
        source = np.arange(len(body)) + np.repeat(start[own] - (np.cumsum(n) - n), n)
        data[source] = body
    head = 4 + number_size
    data[start[:-1] + head] = _crc(data, start[:-1], head, False)
    crc = _crc(data, start[:-1], sizes - 2, True)
    data[start[1:] - 2], data[start[1:] - 1] = crc >> 8, crc & 255

    return data.tobytes(), sizes


@dataclass
class Stream:
    """What a stream's metadata says, and where its frames begin."""

    samples: int
    block: int
    md5: bytes
    seek: list[tuple[int, int]]
    frames: int


def metadata(stream: bytes) -> Stream:
    """Reads the metadata blocks; raises ValueError on a stream of another layout."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, out = 4, False, Stream(0, 0, b"", [], 0)
    while not last:
        last, kind, size = bool(stream[at] & 128), stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            if body[:2] != body[2:4] or packed >> 36 & 31 != 7 or packed >> 41 & 7:
                raise ValueError("only mono 8-bit streams of one block size are read")
            out.samples, out.block, out.md5 = packed & (1 << 36) - 1, int.from_bytes(body[:2], "big"), body[18:34]
        elif kind == 3:
            out.seek = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big")) for i in range(0, size, 18)]
        at += 4 + size
    out.frames = at
    return out


class _Bits64:
    """Reads at many bit positions of one array of bytes at once."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
        self.window = np.zeros(len(data) + 8, np.uint64)
        for j in range(8):
            self.window |= padded[j : j + len(self.window)] << np.uint64(56 - 8 * j)

    def _top(self, at: np.ndarray) -> np.ndarray:
        """57 bits or more from each position, at the top."""
        return self.window[np.minimum(at >> 3, len(self.window) - 1)] << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """Unsigned values of up to 32 bits; at moves on."""
        width = np.broadcast_to(width, at.shape)
        value = (self._top(at) >> np.uint64(1)) >> (63 - width).astype(np.uint64)
        at += width
        return value.astype(np.int64)

    def signed(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        value = self.take(at, width)
        return value - (value >> (np.broadcast_to(width, at.shape) - 1) << np.broadcast_to(width, at.shape))

    def unary(self, at: np.ndarray) -> np.ndarray:
        """Zeros before the next one; at moves behind it."""
        _, exponent = np.frexp((self._top(at) >> np.uint64(11)).astype(np.float64))
        zeros = 53 - exponent.astype(np.int64)
        at += zeros
        more = np.flatnonzero(zeros == 53)
        if len(more):
            if (at[more] >= 8 * len(self.window)).any():
                raise ValueError("a Rice code runs over the end")
            rest = at[more]
            zeros[more] += self.unary(rest)
            at[more] = rest - 1
        at += 1
        return zeros


def _find_frames(data: np.ndarray, lo: int, hi: int, count: int) -> np.ndarray:
    """Where the `count` frames of a stream begin: synchronisation code, right CRC-8, numbers in turn."""
    part = data[lo:hi]
    hit = lo + np.flatnonzero((part[:-4] == 0xFF) & (part[1:-3] == 0xF8) & (part[2:-2] == 0x10) & (part[3:-1] == 0x02))
    if len(hit) != count:  # the code also came up within a frame
        kept = []
        for at in hit:
            number, size = _frame_number(np.array([len(kept)]))
            head = np.array([4 + int(size[0])])
            if bytes(data[at + 4 : at + head[0]]) == bytes(number[0, : size[0]]) and _crc(data, np.array([at]), head, False)[0] == data[at + head[0]]:
                kept.append(at)
        hit = np.array(kept, np.int64)
    if len(hit) != count:
        raise ValueError("frames are missing or out of order")
    return hit


def decode(streams: list[bytes]) -> list[bytes]:
    """The payloads; every CRC-8, CRC-16, frame number, seek point and MD5 is verified, or ValueError raised."""
    heads = [metadata(s) for s in streams]
    data = np.frombuffer(b"".join(streams), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(s) for s in streams])])
    if any(h.block != BLOCK or h.samples % BLOCK for h in heads):
        raise ValueError("a block size of another kind")
    counts = np.array([h.samples // BLOCK for h in heads], np.int64)
    begin = np.concatenate([np.zeros(0, np.int64), *(_find_frames(data, int(base[i]) + h.frames, int(base[i + 1]), int(counts[i])) for i, h in enumerate(heads))])
    first = np.concatenate([[0], np.cumsum(counts)])
    end = np.append(begin[1:], 0)
    end[first[1:] - 1] = base[1:]
    numbers = np.arange(len(begin)) - np.repeat(first[:-1], counts)
    for i, h in enumerate(heads):
        if any(s // BLOCK >= counts[i] or begin[first[i] + s // BLOCK] - base[i] - h.frames != offset for s, offset in h.seek):
            raise ValueError("a seek point is wrong")
    x = np.concatenate([np.zeros((0, BLOCK), np.uint8), *(_decode_frames(data, begin[i : i + SLICE], end[i : i + SLICE], numbers[i : i + SLICE]) for i in range(0, len(begin), SLICE))])
    out = []
    for i, h in enumerate(heads):
        samples = x[first[i] : first[i + 1]].tobytes()
        if md5(samples).digest() != h.md5:
            raise ValueError("the MD5 of the samples is wrong")
        out.append(_flip(samples))
    return out


def _decode_frames(data: np.ndarray, begin: np.ndarray, end: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Signed samples, a row a frame, as bytes."""
    low = int(begin.min())
    data, begin, end = data[low : int(end.max())], begin - low, end - low
    bits, at = _Bits64(data), begin * 8 + 32
    number, size = _frame_number(numbers)
    for j in range(int(size.max())):
        own = np.flatnonzero(size > j)
        if (data[begin[own] + 4 + j] != number[own, j]).any():
            raise ValueError("frames are out of order")
    at += 8 * size
    if (bits.take(at, 8) != _crc(data, begin, 4 + size, False)).any():
        raise ValueError("a frame header's CRC-8 is wrong")
    kind, x = bits.take(at, 8), np.zeros((len(begin), BLOCK), np.int64)
    for k in np.unique(kind):
        own, code = np.flatnonzero(kind == k), int(k) >> 1
        cursor = at[own]
        if k & 129:
            raise ValueError("wasted bits are not read")
        if code == 0:
            x[own] = bits.signed(cursor, 8)[:, None]
        elif code == 1:
            x[own] = np.stack([bits.signed(cursor, 8) for _ in range(BLOCK)], 1)
        elif 8 <= code <= 12 or code >= 32:
            x[own] = _predicted(bits, cursor, code)
        else:
            raise ValueError("a reserved subframe")
        at[own] = cursor
    if ((at + 7) // 8 + 2 != end).any():
        raise ValueError("a frame's length is wrong")
    if _crc(data, begin, end - begin, True).any():  # a frame with its own CRC-16 leaves none
        raise ValueError("a frame's CRC-16 is wrong")
    if (x < -128).any() or (x > 127).any():
        raise ValueError("a sample is out of range")
    return x.astype(np.int8).view(np.uint8)


def _predicted(bits: _Bits64, at: np.ndarray, code: int) -> np.ndarray:
    order = code - 8 if code < 32 else code - 31
    x = np.zeros((BLOCK, len(at)), np.int64)
    for i in range(order):
        x[i] = bits.signed(at, 8)
    if code < 32:
        coefficients, shift = np.tile(np.array(FIXED[order], np.int64).reshape(-1, 1), (1, len(at))), 0
    else:
        precision, shift = bits.take(at, 4) + 1, bits.signed(at, 5)
        coefficients = np.stack([bits.signed(at, precision) for _ in range(order)])
    if bits.take(at, 6).any():
        raise ValueError("only one partition of Rice codes is read")
    rice = bits.take(at, 4)
    if (rice > MAX_RICE).any():
        raise ValueError("escaped partitions are not read")
    for i in range(order, BLOCK):
        folded = bits.unary(at) << rice | bits.take(at, rice)
        guess = (coefficients * x[i - order : i][::-1]).sum(0) >> shift if order else 0
        x[i] = (folded >> 1 ^ -(folded & 1)) + guess
    return x.T
