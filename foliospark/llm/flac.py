"""Media columns: texts kept as FLAC streams, read back as PCM blocks.

A payload of bytes is one channel of 8-bit samples (byte - 128) in frames of
576. The writer makes constant, verbatim, fixed-predictor and linear-predictor
subframes with Rice-coded residuals, a seek table and the checksums of the
format. The reader parses the metadata, checks each header's CRC-8, each
frame's CRC-16 and the stream's MD5, decodes the residuals, and runs
the predictors; it gives PCM blocks with their sample offsets and the byte
offsets at which their frames start, so that a block can be read alone.

Both sides work on many frames of many streams at once: what is sequential
within a frame is a loop over its samples, vectorised over frames.

Written here from the public format description (RFC 9639). The writer makes
one channel of 8 bits in blocks of 576 samples, and such streams are read many
frames at once. Any other stream (channels, sample sizes and block sizes of
all kinds, wasted bits, residuals that are not coded) is read by a plain
reader, frame by frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import by_bytes, map_batches

BLOCK = 576
RATE = 16000
#: Frames between two points of the seek table.
SEEK_EVERY = 16
#: Frames that are coded at once.
AT_ONCE = 1024
MAX_ORDER = 4
MAX_RICE = 14
_PRECISION = 10
#: Coefficients of the format's fixed predictors, by order.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


class FlacError(ValueError):
    """A stream that is damaged or not of the format."""


class _Unusual(FlacError):
    """What the reader of many frames at once leaves to the plain one."""


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for x in range(256):
        x <<= bits - 8
        for _ in range(8):
            x = ((x << 1) ^ poly if x & top else x << 1) & mask
        out.append(x)
    return np.array(out, np.int32)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc8(data: bytes) -> int:
    out = 0
    for b in data:
        out = int(_CRC8[out ^ b])
    return out


def crc16(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-16 of many spans of one array of bytes, longest first inside."""
    order = np.argsort(-length, kind="stable")
    begin, size = start[order], length[order]
    out = np.zeros(len(start), np.int32)
    live = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")
    for i, n in enumerate(live.tolist()):
        out[:n] = ((out[:n] << 8) & 0xFFFF) ^ _CRC16[(out[:n] >> 8) ^ data[begin[:n] + i]]
    back = np.empty_like(out)
    back[order] = out
    return back


def _coded_number(n: int) -> bytes:
    """A frame number in the format's extension of UTF-8, up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    more = next(k for k in range(1, 7) if n < 1 << (6 + 5 * k))  # bytes after the first, six bits each
    return bytes([(0xFF00 >> (more + 1)) & 0xFF | n >> 6 * more, *[0x80 | n >> 6 * k & 0x3F for k in reversed(range(more))]])


_HEADERS: dict[int, bytes] = {}


def frame_header(number: int) -> bytes:
    """Sync code, 576 samples, rate of the stream, one channel, 8 bits, number, CRC-8."""
    if number not in _HEADERS:
        head = b"\xff\xf8\x20\x02" + _coded_number(number)
        made = head + bytes([_crc8(head)])
        if number >= 4096:
            return made
        _HEADERS[number] = made
    return _HEADERS[number]


def padded(data: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of a block."""
    return data + b"\xff" * (-len(data) % BLOCK if data else BLOCK)


def _linear(x: np.ndarray, order: int) -> tuple[np.ndarray, int]:
    """Quantised coefficients of an order-``order`` predictor for each frame, and their shift."""
    z = (x - x.mean(1, keepdims=True)) * np.hanning(BLOCK)
    r = np.stack([(z[:, : BLOCK - k] * z[:, k:]).sum(1) for k in range(order + 1)], 1) + np.array([1e-3] + [0.0] * order)
    r[:, 0] *= 1.0001
    a, error = np.zeros((len(x), order)), r[:, 0].copy()
    for i in range(order):  # Levinson and Durbin's recursion
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / error
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        error *= 1 - k * k
    shift = 7
    top = (1 << (_PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)), -top, top).astype(np.int32), shift


def _residual(x: np.ndarray, coefficients: np.ndarray, shift: int) -> np.ndarray:
    order = coefficients.shape[1]
    guess = sum(coefficients[:, j : j + 1] * x[:, order - 1 - j : BLOCK - 1 - j] for j in range(order))
    return x[:, order:] - (guess >> shift if order else 0)


def _rice(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A good parameter for each frame's folded residuals, next to their mean's logarithm, and the bits they take."""
    guess = np.floor(np.log2(np.maximum(u.mean(1, dtype=np.float64) * 0.69, 1.0))).astype(u.dtype)
    ks = np.stack([np.maximum(guess - 1, 0), guess, guess + 1], 1)
    bits = np.stack([(u >> ks[:, j : j + 1]).sum(1, dtype=np.int64) for j in range(3)], 1) + u.shape[1] * (ks.astype(np.int64) + 1)
    best = bits.argmin(1)
    rows = np.arange(len(u))
    return ks[rows, best].astype(np.int64), bits[rows, best]


def _fold(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def encode_frames(x: np.ndarray, numbers: list[int], linear: bool = True) -> list[bytes]:
    """Whole frames of the rows of ``x``, samples of 8 bits with a sign."""
    out: list[bytes] = []
    for at in range(0, len(x), AT_ONCE):
        out += _encode(x[at : at + AT_ONCE].astype(np.int32), numbers[at : at + AT_ONCE], linear)
    return out


def _encode(x: np.ndarray, numbers: list[int], linear: bool) -> list[bytes]:
    n = len(x)
    # Candidates: verbatim (-1), fixed orders 0 to 2, and one linear order; constant (-2) where it holds.
    choice, bits = np.full(n, -1), np.full(n, 8 * BLOCK)
    order, rice, shifts = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    coefficients = np.zeros((n, MAX_ORDER), np.int32)
    trials = [(o, np.tile(np.array(FIXED[o], np.int32), (n, 1)).reshape(n, o), 0, 0) for o in (0, 1, 2)]
    if linear:
        c, shift = _linear(x.astype(float), MAX_ORDER)
        trials.append((MAX_ORDER, c, shift, 9 + _PRECISION * MAX_ORDER))
    for kind, (o, c, shift, extra) in enumerate(trials):
        k, b = _rice(_fold(_residual(x, c, shift)))
        b = b + 8 * o + 10 + extra
        better = b < bits
        choice[better], bits[better], order[better], rice[better], shifts[better] = kind, b[better], o, k[better], shift
        coefficients[better, :o] = c[better]
        coefficients[better, o:] = 0
    choice[(x == x[:, :1]).all(1)] = -2
    coded = choice >= 0
    size = np.where(choice == -2, 8, np.where(coded, bits, 8 * BLOCK)) + 8
    heads = [frame_header(k) for k in numbers]
    head = np.array([len(h) for h in heads])
    length = head + -(-size // 8) + 2
    start = np.cumsum(length) - length
    line = np.zeros(int(length.sum()) * 8, np.uint8)
    at = (start + head) * 8

    def put(where: np.ndarray, value: np.ndarray, width: int) -> None:
        for b in range(width):
            line[where + b] = (value >> (width - 1 - b)) & 1

    kind = np.where(choice == -2, 0, np.where(choice == -1, 1, np.where(choice == 3, 32 + order - 1, 8 + order)))
    put(at, kind << 1, 8)
    at = at + 8
    same, plain = choice == -2, choice == -1
    put(at[same], x[same, 0] & 255, 8)
    spots = np.arange(BLOCK) * 8
    put(at[plain][:, None] + spots, x[plain] & 255, 8)
    for o in np.unique(order[coded]).tolist():
        own = np.flatnonzero(coded & (order == o))
        put(at[own][:, None] + spots[:o], x[own, :o] & 255, 8)
    at = at + 8 * order
    lpc = np.flatnonzero(choice == 3)
    put(at[lpc], np.full(len(lpc), _PRECISION - 1), 4)
    put(at[lpc] + 4, shifts[lpc], 5)
    put(at[lpc][:, None] + 9 + _PRECISION * np.arange(MAX_ORDER), coefficients[lpc] & ((1 << _PRECISION) - 1), _PRECISION)
    at[lpc] += 9 + _PRECISION * MAX_ORDER
    put(at[coded] + 6, rice[coded], 4)  # method 0 and partition order 0 are zero bits
    at = at + 10
    for o, k in sorted(set(zip(order[coded].tolist(), rice[coded].tolist()))):
        own = np.flatnonzero(coded & (order == o) & (rice == k))
        for lin in (False, True):
            mine = own[(choice[own] == 3) == lin]
            if not len(mine):
                continue
            shift = int(shifts[mine[0]])
            u = _fold(_residual(x[mine], coefficients[mine, :o], shift))
            q = u >> k
            wide = q + 1 + k
            stop = at[mine][:, None] + np.cumsum(wide, 1) - wide + q
            line[stop] = 1
            put(stop + 1, u & ((1 << k) - 1), k)
    whole = np.packbits(line)
    raw = bytearray(whole.tobytes())
    for s, h in zip(start.tolist(), heads):
        raw[s : s + len(h)] = h
    checks = crc16(np.frombuffer(bytes(raw), np.uint8), start, length - 2)
    for s, size, c in zip(start.tolist(), length.tolist(), checks.tolist()):
        raw[s + size - 2 : s + size] = c.to_bytes(2, "big")
    return [bytes(raw[s : s + size]) for s, size in zip(start.tolist(), length.tolist())]


def encode_streams(payloads: list[bytes], linear: bool = True) -> list[bytes]:
    """FLAC streams of payloads whose lengths are positive multiples of a block."""
    counts = [len(p) // BLOCK for p in payloads]
    if any(len(p) % BLOCK or not p for p in payloads):
        raise FlacError("payloads are whole blocks")
    samples = (np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16) - 128).reshape(-1, BLOCK)
    frames = encode_frames(samples, [k for c in counts for k in range(c)], linear)
    out, at = [], 0
    for payload, count in zip(payloads, counts):
        own = frames[at : at + count]
        at += count
        sizes = [len(f) for f in own]
        starts = [0]
        for s in sizes:
            starts.append(starts[-1] + s)
        digest = hashlib.md5(bytes(np.frombuffer(payload, np.uint8) ^ 128)).digest()  # noqa: S324  the format asks for MD5
        info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + digest
        seek = b"".join(struct.pack(">QQH", k * BLOCK, starts[k], BLOCK) for k in range(0, count, SEEK_EVERY))
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(own))
    return out


@dataclass(frozen=True)
class Info:
    """What a stream says of itself before its frames."""

    shortest: int  # samples of a block
    longest: int
    rate: int
    channels: int
    bits: int
    samples: int
    md5: bytes
    seek: tuple[tuple[int, int], ...]  # first sample and byte offset in the stream
    frames: int  # where the first frame starts

    @property
    def plain(self) -> bool:
        """One channel of 8 bits in whole blocks of 576: many frames are decoded at once."""
        return (self.shortest, self.longest, self.channels, self.bits) == (BLOCK, BLOCK, 1, 8) and self.samples > 0 and self.samples % BLOCK == 0


def metadata(data: bytes) -> Info:
    if data[:4] != b"fLaC":
        raise FlacError("no stream marker")
    at, last, info, seek = 4, False, None, []
    while not last:
        if at + 4 > len(data):
            raise FlacError("metadata ends early")
        last, kind, size = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0:
            info = body
        elif kind == 3:
            seek = [struct.unpack(">QQH", body[k : k + 18])[:2] for k in range(0, len(body) - 17, 18)]
    if info is None or len(info) != 34:
        raise FlacError("no stream information")
    packed = int.from_bytes(info[10:18], "big")
    points = tuple((s, at + o) for s, o in seek if s != (1 << 64) - 1)
    return Info(*struct.unpack(">HH", info[:4]), packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, info[18:], points, at)


@dataclass(frozen=True)
class Header:
    """A frame's header, its CRC-8 checked."""

    size: int  # bytes
    block: int
    channels: int
    side: int  # 0, or 8, 9 and 10 for left, right and middle with a difference channel
    bits: int  # 0: as the stream says
    variable: bool
    number: int  # of the frame, or with ``variable`` of its first sample


@dataclass
class Stream:
    """A stream read back: its samples and what its frames were."""

    pcm: bytes  # signed little-endian samples, channels in turn
    frame_starts: list[int]  # byte offsets in the stream
    firsts: list[int]  # the frames' first samples
    kinds: list[int]  # types of first subframes
    rice: list[int]  # their first Rice parameters, -1 where none
    seek_points: list[tuple[int, int]]  # first sample and byte offset
    info: Info

    @property
    def payload(self) -> bytes:
        """The bytes that were stored as samples of 8 bits."""
        return bytes(np.frombuffer(self.pcm, np.uint8) ^ 128)


# Samples of a block, and bits of a sample, by their codes.
_BLOCKS = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, **{k: 256 << (k - 8) for k in range(8, 16)}}
_SAMPLE_BITS = {0: 0, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def header_at(data: bytes, at: int) -> Header | None:
    """The header that stands at a byte offset, or None if none does."""
    if at + 6 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        return None
    lead, codes = data[at + 4], data[at + 2]
    more = 0 if lead < 0x80 else f"{lead:08b}0".index("0") - 1
    size = 5 + more + {6: 1, 7: 2}.get(codes >> 4, 0) + {12: 1, 13: 2, 14: 2}.get(codes & 15, 0)
    return None if more > 6 or more == 0 and lead >= 0x80 or at + size >= len(data) else _header(data[at : at + size + 1], more)


@lru_cache(1 << 14)
def _header(head: bytes, more: int) -> Header | None:
    codes, form = head[2], head[3]
    if _crc8(head[:-1]) != head[-1] or any(b >> 6 != 2 for b in head[5 : 5 + more]):
        return None
    number = head[4] if more == 0 else head[4] & (1 << (6 - more)) - 1
    for b in head[5 : 5 + more]:
        number = number << 6 | b & 63
    at, code = 5 + more, codes >> 4
    if code in (6, 7):
        block = int.from_bytes(head[at : at + code - 5], "big") + 1
    else:
        block = _BLOCKS.get(code)
    if block is None or codes & 15 == 15 or form >> 4 > 10 or form & 1 or form >> 1 & 7 not in _SAMPLE_BITS:
        return None
    side = form >> 4 if form >> 4 > 7 else 0
    return Header(len(head), block, 2 if side else (form >> 4) + 1, side, _SAMPLE_BITS[form >> 1 & 7], bool(head[1] & 1), number)


def _is_frame(data: bytes, at: int, number: int) -> Header | None:
    """The header at an offset if it is that of a plain stream's frame of that number."""
    h = header_at(data, at)
    return h if h and (h.block, h.channels, h.side, h.variable, h.number) == (BLOCK, 1, 0, False, number) and h.bits in (0, 8) else None


def _next_frame(data: bytes, after: int, number: int) -> int:
    """The first offset from ``after`` on where a header of that number stands, or -1."""
    at = data.find(b"\xff\xf8", after)
    while at >= 0 and not _is_frame(data, at, number):
        at = data.find(b"\xff\xf8", at + 1)
    return at


def _frame_starts(data: bytes, at: int, frames: int) -> list[int]:
    """Starts of a plain stream's frames and the end: sync codes whose headers are right and hold the next number.

    A span whose footer fails is taken further (``_settled``), as the bytes of
    a right header can stand inside a frame by chance.
    """
    starts = [at]
    if not _is_frame(data, at, 0):
        raise FlacError("no frame where the first one should be")
    for k in range(1, frames):
        at = _next_frame(data, at + 8, k)
        if at < 0:
            raise FlacError(f"frame {k} is missing or its header is damaged")
        starts.append(at)
    return [*starts, len(data)]


def decode_streams(streams: list[bytes]) -> list[Stream]:
    """Payloads and frame facts of streams; a damaged one raises ``FlacError``.

    Plain streams (``Info.plain``) are decoded together, many frames at once;
    any other is decoded frame by frame.
    """
    facts = [metadata(s) for s in streams]
    plain = [i for i, f in enumerate(facts) if f.plain]
    try:
        found = dict(zip(plain, _plain_streams([streams[i] for i in plain], [facts[i] for i in plain])))
    except _Unusual:
        found = {}
    return [found[i] if i in found else decode_any(s) for i, s in enumerate(streams)]


def _plain_streams(streams: list[bytes], facts: list[Info]) -> list[Stream]:
    if not streams:
        return []
    bounds = [_frame_starts(s, f.frames, f.samples // BLOCK) for s, f in zip(streams, facts)]
    offset = np.cumsum([0] + [len(s) for s in streams])
    start = np.array([o + b for o, own in zip(offset, bounds) for b in own[:-1]], np.int64)
    stop = np.array([o + b for o, own in zip(offset, bounds) for b in own[1:]], np.int64)
    data = np.frombuffer(b"".join(streams) + b"\0" * 8, np.uint8)
    wrong = crc16(data, start, stop - start - 2) != data[stop - 2].astype(np.int32) * 256 + data[stop - 1]
    if wrong.any():
        if len(streams) > 1:  # one by one, where chance headers are settled too
            return [s for one, f in zip(streams, facts) for s in _plain_streams([one], [f])]
        bounds = [_settled(streams[0], bounds[0])]
        start, stop = np.array(bounds[0][:-1], np.int64), np.array(bounds[0][1:], np.int64)
    heads = np.array([header_at(s, b).size for s, own in zip(streams, bounds) for b in own[:-1]], np.int64)
    pieces, kinds, rice = [], [], []
    for at in range(0, len(start), AT_ONCE):
        own = slice(at, at + AT_ONCE)
        x, kind, k = _decode(data, start[own] + heads[own], stop[own] - 2)
        pieces.append(x)
        kinds += kind.tolist()
        rice += k.tolist()
    samples = np.concatenate(pieces)
    out, at = [], 0
    for f, own in zip(facts, bounds):
        n = len(own) - 1
        pcm = samples[at : at + n].astype(np.int8).tobytes()
        if hashlib.md5(pcm).digest() != f.md5:  # noqa: S324
            raise FlacError("the samples' MD5 differs")
        out.append(Stream(pcm, own[:-1], [BLOCK * k for k in range(n)], kinds[at : at + n], rice[at : at + n], list(f.seek), f))
        at += n
    return out


def _settled(data: bytes, bounds: list[int]) -> list[int]:
    """Frame starts of one stream, each footer checked before the next header is believed."""
    line = np.frombuffer(data, np.uint8)
    right = lambda a, b: b - a > 8 and int(crc16(line, np.array([a]), np.array([b - a - 2]))[0]) == int.from_bytes(data[b - 2 : b], "big")
    out = [bounds[0]]
    for k in range(1, len(bounds)):
        last = k == len(bounds) - 1
        at = len(data) if last else _next_frame(data, out[-1] + 8, k)
        while at >= 0 and not right(out[-1], at):
            at = -1 if last else _next_frame(data, at + 1, k)
        if at < 0:
            raise FlacError(f"frame {k - 1}: wrong CRC-16")
        out.append(at)
    return out


class _Bits:
    """Bits of a stream from a byte offset on, with the place of the next set bit."""

    def __init__(self, data: bytes) -> None:
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0
        self.ones = np.flatnonzero(self.bits)

    def take(self, n: int) -> int:
        if self.at + n > len(self.bits):
            raise FlacError("a frame ends early")
        out = int("".join(map(str, self.bits[self.at : self.at + n].tolist())) or "0", 2)
        self.at += n
        return out

    def signed(self, n: int) -> int:
        x = self.take(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def unary(self) -> int:
        """Zeros up to the next one."""
        k = int(np.searchsorted(self.ones, self.at))
        if k == len(self.ones):
            raise FlacError("a frame ends early")
        n = int(self.ones[k]) - self.at
        self.at += n + 1
        return n


def _residuals(b: _Bits, block: int, order: int) -> tuple[list[int], int]:
    """A subframe's residuals and its first Rice parameter (-1: not coded)."""
    method, parts = b.take(2), b.take(4)
    if method > 1 or block % (1 << parts) or block >> parts < order:
        raise FlacError("reserved residual coding")
    wide, out, first = 4 + method, [], None
    for p in range(1 << parts):
        n, k = (block >> parts) - (order if p == 0 else 0), b.take(wide)
        escaped = k == (1 << wide) - 1
        first = (-1 if escaped else k) if first is None else first
        if escaped:
            width = b.take(5)
            out += [b.signed(width) for _ in range(n)]
        else:
            folded = (b.unary() << k | b.take(k) for _ in range(n))
            out += [u >> 1 ^ -(u & 1) for u in folded]
    return out, -1 if first is None else first


def _subframe(b: _Bits, block: int, bits: int) -> tuple[list[int], int, int]:
    """Samples, type and Rice parameter of one channel of a frame."""
    if b.take(1):
        raise FlacError("reserved bit")
    kind, wasted, rice = b.take(6), b.take(1), -1
    if wasted:
        wasted = 1 + b.unary()
        bits -= wasted
    if kind == 0:
        x = [b.signed(bits)] * block
    elif kind == 1:
        x = [b.signed(bits) for _ in range(block)]
    elif 8 <= kind <= 8 + MAX_ORDER or kind >= 32:
        order = kind - 31 if kind >= 32 else kind - 8
        if order > block:
            raise FlacError("predictor longer than its block")
        x = [b.signed(bits) for _ in range(order)]
        if kind >= 32:
            width = b.take(4) + 1
            shift = b.signed(5)
            if width == 16 or shift < 0:
                raise FlacError("reserved predictor")
            weights = [b.signed(width) for _ in range(order)]
        else:
            weights, shift = list(FIXED[order]), 0
        rest, rice = _residuals(b, block, order)
        for r in rest:
            x.append(r + (sum(w * x[-1 - j] for j, w in enumerate(weights)) >> shift))
    else:
        raise FlacError("reserved subframe type")
    return ([s << wasted for s in x] if wasted else x), kind, rice


def _frame(data: bytes, at: int, info: Info) -> tuple[np.ndarray, Header, int, int, int]:
    """Samples of the frame at an offset (a column a channel), its header, its end, its first subframe's type and parameter."""
    h = header_at(data, at)
    if h is None:
        raise FlacError("no frame where one should be")
    bits = h.bits or info.bits
    if h.channels != info.channels or bits != info.bits:
        raise FlacError("a frame differs from its stream")
    b = _Bits(data[at + h.size : at + h.size + 64 + h.channels * h.block * (bits + 34) // 8])
    parts = [_subframe(b, h.block, bits + (h.side in (8, 10) and c == 1 or h.side == 9 and c == 0)) for c in range(h.channels)]
    x = np.array([p[0] for p in parts], np.int64)
    if h.side == 8:
        x[1] = x[0] - x[1]
    elif h.side == 9:
        x[0] += x[1]
    elif h.side == 10:
        twice = x[0] * 2 + (x[1] & 1)
        x[0], x[1] = (twice + x[1]) >> 1, (twice - x[1]) >> 1
    end = at + h.size + (b.at + 7) // 8 + 2
    own = np.frombuffer(data, np.uint8)[at:end]
    if end > len(data) or int(crc16(own, np.array([0]), np.array([end - at - 2]))[0]) != int.from_bytes(data[end - 2 : end], "big"):
        raise FlacError("wrong CRC-16")
    return x.T, h, end, parts[0][1], parts[0][2]


def _pcm(x: np.ndarray, bits: int) -> bytes:
    """Samples as the format digests them: signed, little-endian, channels in turn, whole bytes."""
    wide = -(-bits // 8)
    return np.ascontiguousarray(x.astype("<i8")).view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()


def decode_any(data: bytes) -> Stream:
    """Any stream of the format: channels, sample sizes and block sizes as it says, one frame after the other."""
    info = metadata(data)
    at, done, pieces, starts, firsts, kinds, rice = info.frames, 0, [], [], [], [], []
    while at < len(data) and (not info.samples or done < info.samples):
        x, h, end, kind, k = _frame(data, at, info)
        if h.number != (done if h.variable else len(starts)):
            raise FlacError(f"frame {len(starts)} has another number")
        starts.append(at)
        firsts.append(done)
        kinds.append(kind)
        rice.append(k)
        pieces.append(_pcm(x, info.bits))
        at, done = end, done + len(x)
    pcm = b"".join(pieces)
    if info.samples and done != info.samples:
        raise FlacError("samples are missing")
    if any(info.md5) and hashlib.md5(pcm).digest() != info.md5:  # noqa: S324
        raise FlacError("the samples' MD5 differs")
    return Stream(pcm, starts, firsts, kinds, rice, list(info.seek), info)


def read_at(media: list[bytes], offsets: list[int], samples: list[int]) -> list[bytes]:
    """Of each plain stream the block of PCM bytes whose frame starts at a byte offset; ``samples`` say its first sample.

    Nothing else of the streams is decoded: the header at the offset must hold
    the block's number, and the footer must be right.
    """
    heads, ends = [], []
    for data, at, sample in zip(media, offsets, samples):
        h = _is_frame(data, at, sample // BLOCK)
        if h is None:
            raise FlacError(f"no frame of sample {sample} at byte {at}")
        end = _next_frame(data, at + 8, sample // BLOCK + 1)
        heads.append(h.size)
        ends.append(len(data) if end < 0 else end)
    waiting = list(range(len(media)))  # spans whose footers are yet to be held against them, all at once
    while waiting:
        spans = [media[i][offsets[i] : ends[i]] for i in waiting]
        size = np.array([len(x) for x in spans])
        start = np.cumsum(size) - size
        line = np.frombuffer(b"".join(spans), np.uint8)
        wrong = crc16(line, start, size - 2) != line[start + size - 2].astype(np.int32) * 256 + line[start + size - 1]
        waiting = [i for i, w in zip(waiting, wrong.tolist()) if w]
        for i in waiting:  # what looked like the next header stood inside the frame
            if ends[i] == len(media[i]):
                raise FlacError("wrong CRC-16")
            end = _next_frame(media[i], ends[i] + 1, samples[i] // BLOCK + 1)
            ends[i] = len(media[i]) if end < 0 else end
    spans = [data[a:e] for data, a, e in zip(media, offsets, ends)]
    size = np.array([len(s) for s in spans])
    start = np.cumsum(size) - size
    line = np.frombuffer(b"".join(spans) + b"\0" * 8, np.uint8)
    out: list[bytes] = []
    for at in range(0, len(spans), AT_ONCE):
        own = slice(at, at + AT_ONCE)
        x, _, _ = _decode(line, start[own] + np.array(heads[own]), start[own] + size[own] - 2)
        out += [row.tobytes() for row in x.astype(np.int8)]
    return out


def _decode(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples, subframe types and Rice parameters of subframes at byte offsets."""
    low, high = int(begin[0]), int(end[-1])
    bits = np.unpackbits(data[low : high + 8])
    n = len(begin)
    at = (begin - low) * 8

    def get(where: np.ndarray, width: int, signed: bool = False) -> np.ndarray:
        out = np.zeros(where.shape, np.int64)
        for b in range(width):
            out = out << 1 | bits[where + b]
        return np.where(out >> (width - 1) & 1, out - (1 << width), out) if signed else out

    first = get(at, 8)
    kind = first >> 1
    if (first & 128).any():
        raise FlacError("reserved bits")
    if (first & 1).any():
        raise _Unusual("wasted bits")
    at = at + 8
    x = np.zeros((n, BLOCK), np.int64)
    spots = np.arange(BLOCK) * 8
    same, plain = kind == 0, kind == 1
    fixed, lpc = (kind >= 8) & (kind <= 8 + MAX_ORDER), kind >= 32
    if not (same | plain | fixed | lpc).all():
        raise FlacError("reserved subframe type")
    x[same] = get(at[same], 8, True)[:, None]
    x[plain] = get(at[plain][:, None] + spots, 8, True)
    order = np.where(fixed, kind - 8, np.where(lpc, kind - 31, 0))
    deep = max(1, int(order.max()))
    coefficients, shift = np.zeros((n, deep), np.int64), np.zeros(n, np.int64)
    for o in np.unique(order[fixed | lpc]).tolist():
        own = np.flatnonzero((fixed | lpc) & (order == o))
        x[own, :o] = get(at[own][:, None] + spots[:o], 8, True)
        if o <= MAX_ORDER:
            coefficients[own[fixed[own]], :o] = FIXED[o]
    at = at + 8 * order
    if lpc.any():
        width = get(at[lpc], 4) + 1
        shift[lpc] = get(at[lpc] + 4, 5, True)
        if (shift < 0).any() or (width == 16).any():
            raise FlacError("predictor with a negative shift")
        for w in np.unique(width).tolist():
            for o in np.unique(order[lpc][width == w]).tolist():
                own = np.flatnonzero(lpc)[(width == w) & (order[lpc] == o)]
                coefficients[own, :o] = get(at[own][:, None] + 9 + w * np.arange(o), w, True)
                at[own] += 9 + w * o
    rice = np.full(n, -1, np.int64)
    own = np.flatnonzero(fixed | lpc)
    if not len(own):
        return x, kind, rice
    method, parts = get(at[own], 2), get(at[own] + 2, 4)
    at = at + 6
    if (method > 1).any() or (BLOCK % (1 << parts)).any():
        raise FlacError("reserved residual coding")
    # The stop bit of the code that begins at each place.
    place = np.where(bits, np.arange(len(bits), dtype=np.int32), np.int32(len(bits)))
    stop = np.minimum.accumulate(place[::-1])[::-1]
    reach, wide = at[own], np.where(method == 1, 5, 4)
    each, k, raw = BLOCK >> parts, np.zeros(len(own), np.int64), np.zeros(len(own), bool)
    o = order[own]
    u = np.zeros((BLOCK, len(own)), np.int64)
    simple = (parts == 0).all() and (method == 0).all()
    places = np.zeros((BLOCK, len(own)), np.int64)
    for t in range(BLOCK):
        live = t >= o
        opens = (t == o) | (t % each == 0) & live if not simple else t == o
        if opens.any():
            for w in np.unique(wide[opens]).tolist():
                mine = opens & (wide == w)
                k[mine] = get(reach[mine], w)
                raw[mine] = k[mine] == (1 << w) - 1
                reach = np.where(mine, reach + w, reach)
            if raw.any():
                raise _Unusual("residuals that are not coded")
            if (t == o).any():
                rice[own[t == o]] = k[t == o]
        end_of = stop[np.minimum(reach, len(bits) - 1)]
        places[t] = end_of
        u[t] = np.where(live, (end_of - reach) << k, 0)
        reach = np.where(live, end_of + 1 + k, reach)
        if not simple:  # parameters may change within the frame
            u[t] |= np.where(live, _low_bits(bits, end_of + 1, k), 0)
    if simple:
        for value in np.unique(k).tolist():
            mine = np.flatnonzero(k == value)
            if value:
                u[:, mine] |= get(np.minimum(places[:, mine] + 1, len(bits) - 1 - value), value)
        u[np.arange(BLOCK)[:, None] < o] = 0
    if (reach > (end[own] - low) * 8).any():
        raise FlacError("residuals run over their frame")
    r = np.where(u & 1, -(u >> 1) - 1, u >> 1)
    samples = np.ascontiguousarray(x[own].T)
    c, s = np.ascontiguousarray(coefficients[own].T), shift[own]
    for t in range(BLOCK):
        guess = 0
        for j in range(min(deep, t)):
            guess = guess + c[j] * samples[t - 1 - j]
        samples[t] = np.where(t >= o, r[t] + (guess >> s), samples[t]) if t < deep else r[t] + (guess >> s)
    if samples.min() < -128 or samples.max() > 127:
        raise FlacError("samples of over 8 bits")
    x[own] = samples.T
    return x, kind, rice


def _low_bits(bits: np.ndarray, at: np.ndarray, k: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), np.int64)
    for b in range(int(k.max(initial=0))):
        out = np.where(b < k, out << 1 | bits[np.minimum(at + b, len(bits) - 1)], out)
    return out


def feature(payload: bytes, kinds: list[int], rice: list[int]) -> str:
    """What a stream is like: frames, mean square of its samples, changes of sign, subframe types, mean Rice parameter."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    used = [k for k in rice if k >= 0]
    counts = ",".join(f"{k}:{kinds.count(k)}" for k in sorted(set(kinds)))
    return f"frames={len(kinds)};square={int((x * x).sum() // len(x))};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};kinds={counts};rice={sum(used)}/{len(used)}"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: every text as a FLAC stream (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 1, 1 << 20):
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(encode_streams([padded(t) for t in texts]), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string")).transform(map_batches, run, "doc_id bigint, n_bytes bigint, media binary")


_BLOCK_TYPE = pa.struct([("sample_offset", pa.int64()), ("byte_offset", pa.int64()), ("pcm", pa.binary())])
_PCM = "doc_id bigint, n_bytes bigint, media binary, blocks array<struct<sample_offset:bigint,byte_offset:bigint,pcm:binary>>, kinds array<int>, rice array<int>"


def pcm_blocks(media: DataFrame, frames: int = SEEK_EVERY) -> DataFrame:
    """Streams with their decoded ``blocks``, and the subframe ``kinds`` and ``rice`` parameters of their frames.

    A block holds ``frames`` frames' samples as signed little-endian bytes,
    its first sample and the byte of the stream at which its first frame
    starts, so that a reader can start there (``read_at``). Blocks stay with
    their stream, and nothing is shuffled.

    Defined results: a null stream has no blocks; a null id stays null;
    repeated rows give repeated rows; an empty table gives an empty result; a
    damaged stream fails the job with ``FlacError``; further columns are not
    read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 2, 1 << 20):
                stored = part.column(2).to_pylist()
                read = iter(decode_streams([m for m in stored if m is not None]))
                blocks, kinds, rice = [], [], []
                for m in stored:
                    s = next(read) if m is not None else None
                    kinds.append(s.kinds if s else None)
                    rice.append(s.rice if s else None)
                    blocks.append(_blocks(s, frames) if s else [])
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(blocks, pa.list_(_BLOCK_TYPE)), pa.array(kinds, pa.list_(pa.int32())), pa.array(rice, pa.list_(pa.int32()))], ["doc_id", "n_bytes", "media", "blocks", "kinds", "rice"])

    return media.select("doc_id", "n_bytes", "media").transform(map_batches, run, _PCM)


def _blocks(s: Stream, frames: int) -> list[tuple[int, int, bytes]]:
    wide = s.info.channels * -(-s.info.bits // 8)
    marks = [*range(0, len(s.firsts), frames)]
    ends = [*(s.firsts[k] for k in marks[1:]), len(s.pcm) // wide]
    return [(s.firsts[k], s.frame_starts[k], s.pcm[s.firsts[k] * wide : e * wide]) for k, e in zip(marks, ends)]


def features(blocks: DataFrame) -> DataFrame:
    """Of streams with their PCM blocks (``pcm_blocks`` of ``store``): digests and features.

    Payload values come from the blocks. Each stream is also entered at its
    last block's byte offset, and what is decoded from there must agree.

    Defined results: null and empty texts were stored as one block of bytes
    255; equal texts have equal streams and values; a null id stays null;
    repeated rows give repeated rows; an empty table gives an empty result; a
    damaged stream fails the job with ``FlacError``; rows without a stream
    (``store`` makes none) are left out; further columns are not read.
    """
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 2, 1 << 20):
                stored, own = part.column(2).to_pylist(), part.column(3).to_pylist()
                pcm = [b"".join(b["pcm"] for b in x) for x in own]
                ahead = read_at(stored, [x[-1]["byte_offset"] for x in own], [x[-1]["sample_offset"] for x in own])
                if any(a != x[-1]["pcm"][:BLOCK] for a, x in zip(ahead, own)):
                    raise FlacError("a block differs where its offset is entered")
                payloads = [bytes(np.frombuffer(p, np.uint8) ^ 128) for p in pcm]
                said = [feature(*x) for x in zip(payloads, part.column(4).to_pylist(), part.column(5).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(p) for p in payloads], pa.int64()), pa.array([sha(p) for p in payloads]), pa.array([zlib.crc32(p[-32:]) for p in payloads], pa.int64()), pa.array([len(m) for m in stored], pa.int64()), pa.array([sha(m) for m in stored]), pa.array(said)],
                    ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    return blocks.filter("media IS NOT NULL").select("doc_id", "n_bytes", "media", "blocks", "kinds", "rice").transform(map_batches, run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
