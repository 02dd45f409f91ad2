"""Lossless WebP in numpy and plain Python: a full decoder, and an encoder for sample streams and images.

The decoder reads the bit stream of RFC 9649: prefix codes (one group or a meta image of groups), back-references with
the distance map, the colour cache, and undoes predictor, cross-colour, subtract-green and palette transforms with
bundled pixels. Where only the green code of a single group carries bits, the code of every bit position is looked up
at once and a short loop hops from one symbol to the next.

``features`` takes texts as UTF-8, appends bytes 255 up to a positive multiple of 576, writes them as the green samples
of images 576 wide (repeated lines and runs as back-references), reads the stored bytes back and describes what was
read. A payload of more than 16,383 rows goes into several files laid end to end.

Defined cases: a null or empty text is 576 bytes of 255; equal texts give equal values, wherever they stand; repeated
rows give repeated results; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 576
MOST_ROWS = 16_383
#: Fixed values of the format: the order in which code-length code lengths are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Near pixels by distance, then column, right before left.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
CACHE_FACTOR = 0x1E35A7BD
_EIGHT = np.arange(8, dtype=np.uint32)


class Bits:
    """Bits of a byte string, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        k = self.at >> 3
        value = int.from_bytes(self.data[k : k + 5], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        return value


_reversals: dict[int, np.ndarray] = {}


def _reversal(bits: int) -> np.ndarray:
    """Every number of ``bits`` bits with its bits the other way round."""
    if bits not in _reversals:
        x, out = np.arange(1 << bits), np.zeros(1 << bits, np.int64)
        for k in range(bits):
            out |= (x >> k & 1) << (bits - 1 - k)
        _reversals[bits] = out
    return _reversals[bits]


def _reversed_codes(lengths: list[int]) -> list[int]:
    """Canonical codes with their bits in the order in which they are read."""
    count = [0] * 17
    for n in lengths:
        count[n] += 1
    count[0] = 0
    code, first = 0, [0] * 17
    for n in range(1, 16):
        code = (code + count[n - 1]) << 1
        first[n] = code
    out = []
    for n in lengths:
        if n:
            out.append(first[n])
            first[n] += 1
        else:
            out.append(0)
    return (_reversal(15)[out] >> (15 - np.array(lengths))).tolist()


class Code:
    """A prefix code; one that has a single symbol takes no bits."""

    def __init__(self, lengths: list[int]):
        used = [s for s, n in enumerate(lengths) if n]
        self.only = used[0] if len(used) == 1 else (0 if not used else None)
        if self.only is None:
            used.sort(key=lengths.__getitem__)
            symbol, size = np.array(used, np.int32), np.array([lengths[s] for s in used], np.int32)
            bits = int(size[-1])
            inverse = np.repeat(symbol << 4 | size, 1 << (bits - size))
            if len(inverse) != 1 << bits:
                raise ValueError("incomplete prefix code")
            self.table, self.mask = inverse[_reversal(bits)], (1 << bits) - 1
            self._list: list[int] | None = None

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        if self._list is None:
            self._list = self.table.tolist()
        k = bits.at >> 3
        entry = self._list[int.from_bytes(bits.data[k : k + 3], "little") >> (bits.at & 7) & self.mask]
        bits.at += entry & 15
        return entry >> 4


def _read_code(bits: Bits, size: int) -> Code:
    lengths = [0] * size
    if bits.take(1):
        two = bits.take(1)
        first = bits.take(8 if bits.take(1) else 1)
        lengths[first] = 1
        if two:
            lengths[bits.take(8)] = 1
        return Code(lengths)
    of = [0] * 19
    for k in range(4 + bits.take(4)):
        of[LENGTH_ORDER[k]] = bits.take(3)
    inner = Code(of)
    left = 2 + bits.take(2 + 2 * bits.take(3)) if bits.take(1) else size
    at, last = 0, 8
    while at < size and left:
        left -= 1
        s = inner.read(bits)
        if s < 16:
            lengths[at] = s
            last = s or last
            at += 1
            continue
        n, value = (3 + bits.take(2), last) if s == 16 else (3 + bits.take(3), 0) if s == 17 else (11 + bits.take(7), 0)
        lengths[at : at + n] = [value] * n
        at += n
        if at > size:
            raise ValueError("code lengths beyond the alphabet")
    return Code(lengths)


def _extended(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.take(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """The entropy-coded pixels, as 32-bit ARGB."""
    cache_bits = bits.take(4) if bits.take(1) else 0
    groups_of, shift, n_groups = None, 0, 1
    if main and bits.take(1):
        shift = bits.take(3) + 2
        meta = _read_image(bits, -(-width >> shift), -(-height >> shift), False)
        groups_of = (meta >> 8 & 0xFFFF).astype(int).tolist()
        n_groups = max(groups_of) + 1
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    groups = [[_read_code(bits, n) for n in sizes] for _ in range(n_groups)]
    if n_groups == 1 and not cache_bits and all(c.only is not None for c in groups[0][1:4]):
        return _read_green(bits, width, width * height, groups[0])
    total = width * height
    out, cache = [0] * total, [0] * (1 << cache_bits)
    cached = at = 0
    across = -(-width >> shift)
    green, red, blue, alpha, dist = groups[0]
    while at < total:
        if groups_of is not None:
            y, x = divmod(at, width)
            green, red, blue, alpha, dist = groups[groups_of[(y >> shift) * across + (x >> shift)]]
        s = green.read(bits)
        if s < 256:
            r = red.read(bits)
            b = blue.read(bits)
            out[at] = alpha.read(bits) << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < 280:
            n = _extended(bits, s - 256)
            back = _distance(_extended(bits, dist.read(bits)), width)
            if back > at:
                raise ValueError("reference before the image")
            for at in range(at, min(total, at + n)):
                out[at] = out[at - back]
            at += 1
        else:
            while cached < at:
                cache[(CACHE_FACTOR * out[cached] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[cached]
                cached += 1
            out[at] = cache[s - 280]
            at += 1
    return np.array(out, np.uint32)


def _read_green(bits: Bits, width: int, total: int, codes: list[Code]) -> np.ndarray:
    """Pixels of which only green is coded."""
    green, red, blue, alpha, dist = codes
    rest = alpha.only << 24 | red.only << 16 | blue.only
    if green.only is not None and green.only < 256:
        return np.full(total, rest | green.only << 8, np.uint32)
    if green.only is not None:
        raise ValueError("reference before the image")
    first = bits.at >> 3
    raw = np.frombuffer(bits.data[first:] + bytes(4), np.uint8).astype(np.uint32)
    wide = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    hops, symbols = [], []
    for k in range(0, len(wide), 1 << 16):  # what stands at every bit position; 0 bits: no literal
        e = green.table[(wide[k : k + (1 << 16), None] >> _EIGHT & np.uint32(green.mask)).reshape(-1)]
        hops.append(np.where(e < 256 << 4, e & 15, 0).astype(np.uint8))
        symbols.append((e >> 4).astype(np.uint8))
    hop, symbol = np.concatenate([*hops, np.zeros(128, np.uint8)]), np.concatenate(symbols)
    jump = hop.copy()
    for _ in range(3):  # over two, four and eight literals
        jump[:-128] += jump[np.arange(len(jump) - 128) + jump[:-128]]
    jumps = jump.tobytes()
    out = np.empty(total, np.uint8)
    at, p, base = 0, bits.at - 8 * first, 8 * first
    while at < total:
        starts = []
        add = starts.append
        for _ in range((total - at >> 3) + 1):
            add(p)
            n = jumps[p]
            if not n:
                break
            p += n
        line = np.empty((len(starts), 8), np.int64)
        line[:, 0] = starts
        for k in range(7):
            line[:, k + 1] = line[:, k] + hop[line[:, k]]
        line = line.reshape(-1)
        line = line[hop[line] > 0][: total - at]
        out[at : at + len(line)] = symbol[line]
        at += len(line)
        if len(line):
            p = int(line[-1]) + int(hop[line[-1]])
        bits.at = base + p
        if at == total:
            break
        if p >> 3 >= len(wide) - 1:
            raise ValueError("the file ends early")
        length = _extended(bits, green.read(bits) - 256)
        back = _distance(_extended(bits, dist.read(bits)), width)
        p = bits.at - base
        if back > at:
            raise ValueError("reference before the image")
        length = min(length, total - at)
        if back >= length:
            out[at : at + length] = out[at - back : at - back + length]
        else:
            out[at : at + length] = np.resize(out[at - back : at], length)
        at += length
        bits.at = base + p
    return out.astype(np.uint32) << 8 | rest


def _channels(pixels: np.ndarray) -> np.ndarray:
    return np.stack([pixels >> s & 0xFF for s in (24, 16, 8, 0)], -1).astype(np.int32)


def _pixels(channels: np.ndarray) -> np.ndarray:
    c = channels.astype(np.uint32) & 0xFF
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _predict(mode: int, left, top, corner, right):
    """The prediction of a pixel, as four channel values."""
    half = lambda a, b: [(p + q) >> 1 for p, q in zip(a, b, strict=True)]
    clip = lambda v: 0 if v < 0 else 255 if v > 255 else v
    if mode in (0, 14, 15):
        return [255, 0, 0, 0]
    if mode < 5:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return half(half(left, right), top)
    if mode < 11:
        return half(*((left, corner), (left, top), (corner, top), (top, right), (half(left, corner), half(top, right)))[mode - 6])
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [clip(x + t - c) for x, t, c in zip(left, top, corner, strict=True)]
    mean = half(left, top)
    return [clip(m + int((m - c) / 2)) for m, c in zip(mean, corner, strict=True)]


def _walk_predictor(image: np.ndarray, modes: np.ndarray, size: int, forward: bool) -> np.ndarray:
    """Add predictions to residuals (height x width x 4), or with ``forward`` take them off pixels."""
    height, width, _ = image.shape
    src = image.tolist()
    out = [[None] * width for _ in range(height)]
    known = src if forward else out
    for y in range(height):
        for x in range(width):
            if not y:
                p = known[0][x - 1] if x else [255, 0, 0, 0]
            elif not x:
                p = known[y - 1][0]
            else:
                above = known[y - 1]
                right = above[x + 1] if x + 1 < width else known[y][0]
                p = _predict(int(modes[y >> size, x >> size]), known[y][x - 1], above[x], above[x - 1], right)
            out[y][x] = [(a - b if forward else a + b) & 255 for a, b in zip(src[y][x], p, strict=True)]
    return np.array(out, np.int32).reshape(height, width, 4)


def _signed(x: np.ndarray) -> np.ndarray:
    return ((x & 0xFF) ^ 0x80) - 0x80


def _walk_cross(image: np.ndarray, element: np.ndarray, size: int, forward: bool) -> np.ndarray:
    """Add the cross-colour deltas (or take them off). element: to red, to blue, red to blue for each block."""
    height, width, _ = image.shape
    e = np.repeat(np.repeat(element, 1 << size, 0), 1 << size, 1)[:height, :width]
    sign = -1 if forward else 1
    green, red, blue = image[..., 2], image[..., 1], image[..., 3]
    new_red = red + sign * (_signed(e[..., 0]) * _signed(green) >> 5) & 255
    by = red if forward else new_red
    new_blue = blue + sign * ((_signed(e[..., 1]) * _signed(green) >> 5) + (_signed(e[..., 2]) * _signed(by) >> 5)) & 255
    return np.stack([image[..., 0], new_red, green, new_blue], -1)


def _bundle(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode(data: bytes) -> np.ndarray:
    """Pixels of a lossless WebP file, height x width, 32-bit ARGB as stored."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    bits = Bits(data[20 : 20 + int.from_bytes(data[16:20], "little")])
    if bits.take(8) != 0x2F:
        raise ValueError("bad signature")
    width, height = bits.take(14) + 1, bits.take(14) + 1
    bits.take(1)
    if bits.take(3):
        raise ValueError("unknown version")
    todo: list[tuple] = []
    now = width
    while bits.take(1):
        kind = bits.take(2)
        if kind in (0, 1):
            size = bits.take(3) + 2
            sub = _read_image(bits, -(-now >> size), -(-height >> size), False).reshape(-(-height >> size), -1)
            todo.append((kind, size, sub, now))
        elif kind == 2:
            todo.append((2, 0, None, now))
        else:
            n = bits.take(8) + 1
            table = _channels(_read_image(bits, n, 1, False)).cumsum(axis=0) & 255
            todo.append((3, _bundle(n), _pixels(table), now))
            now = -(-now >> _bundle(n))
    image = _read_image(bits, now, height, True).reshape(height, now)
    for kind, size, sub, across in reversed(todo):
        if kind == 0:
            image = _pixels(_walk_predictor(_channels(image), sub >> 8 & 0xF, size, False))
        elif kind == 1:
            c = _channels(sub)
            image = _pixels(_walk_cross(_channels(image), c[..., [3, 2, 1]], size, False))
        elif kind == 2:
            green = image >> 8 & 0xFF
            image = image & 0xFF00FF00 | (image & 0x00FF00FF) + (green << 16 | green) & 0x00FF00FF
        else:
            index, wide = image >> 8 & 0xFF, 8 >> size
            if size:
                index = (index[..., None] >> (np.arange(1 << size, dtype=np.uint32) * wide) & ((1 << wide) - 1)).reshape(height, -1)[:, :across]
            image = np.append(sub, np.zeros(256, np.uint32))[index]
    return image


# Writing


class BitWriter:
    """Values with their widths, least significant bit first; long runs as arrays."""

    def __init__(self):
        self.values: list[np.ndarray] = []
        self.widths: list[np.ndarray] = []
        self._v: list[int] = []
        self._w: list[int] = []

    def put(self, value: int, width: int) -> None:
        self._v.append(value)
        self._w.append(width)

    def _flush(self) -> None:
        if self._v:
            self.values.append(np.array(self._v, np.int64))
            self.widths.append(np.array(self._w, np.int64))
            self._v, self._w = [], []

    def put_all(self, values: np.ndarray, widths: np.ndarray) -> None:
        self._flush()
        self.values.append(values.astype(np.int64))
        self.widths.append(widths.astype(np.int64))

    def bytes(self) -> bytes:
        self._flush()
        v, w = np.concatenate(self.values), np.concatenate(self.widths)
        ends = w.cumsum()
        inside = np.arange(int(ends[-1])) - np.repeat(ends - w, w)
        return np.packbits((np.repeat(v, w) >> inside & 1).astype(np.uint8), bitorder="little").tobytes()


def code_lengths(counts: list[int], most: int = 15) -> list[int]:
    """Huffman code lengths of at most ``most`` bits; a lone symbol gets 1."""
    used = [s for s, n in enumerate(counts) if n]
    out = [0] * len(counts)
    if len(used) < 2:
        for s in used:
            out[s] = 1
        return out
    least = 1
    while True:
        heap = [(max(counts[s], least), k, (s,)) for k, s in enumerate(used)]
        heapq.heapify(heap)
        depth = dict.fromkeys(used, 0)
        tick = len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            tick += 1
            heapq.heappush(heap, (a[0] + b[0], tick, a[2] + b[2]))
        if max(depth.values()) <= most:
            break
        least = least * 2  # flatter counts give shorter codes
    for s, n in depth.items():
        out[s] = n
    return out


def _write_code(w: BitWriter, lengths: list[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        first = used[0] if used else 0
        w.put(1, 1)
        w.put(int(len(used) == 2), 1)
        w.put(int(first > 1), 1)
        w.put(first, 8 if first > 1 else 1)
        if len(used) == 2:
            w.put(used[1], 8)
        return
    ops: list[tuple[int, int, int]] = []
    k, last = 0, 8
    size = max(used) + 1
    while k < size:
        n = lengths[k]
        run = 1
        while k + run < size and lengths[k + run] == n:
            run += 1
        k += run
        while run:
            if n == 0 and run >= 3:
                take = min(run, 138)
                ops.append((18, take - 11, 7) if take >= 11 else (17, take - 3, 3))
            elif n and n == last and run >= 3:
                take = min(run, 6)
                ops.append((16, take - 3, 2))
            else:
                take = 1
                ops.append((n, 0, 0))
                last = n or last
            run -= take
    counts = [0] * 19
    for s, _, _ in ops:
        counts[s] += 1
    inner = code_lengths(counts, 7)
    codes = _reversed_codes(inner)
    alone = sum(1 for n in inner if n) == 1
    w.put(0, 1)
    top = max(4, max(k + 1 for k, s in enumerate(LENGTH_ORDER) if inner[s]))
    w.put(top - 4, 4)
    for s in LENGTH_ORDER[:top]:
        w.put(inner[s], 3)
    w.put(1, 1)
    width = max(2, (max(0, len(ops) - 2)).bit_length())
    width += width & 1
    w.put((width - 2) // 2, 3)
    w.put(len(ops) - 2, width)
    for s, extra, n in ops:
        if not alone:
            w.put(codes[s], inner[s])
        if n:
            w.put(extra, n)


def _prefix(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra value and its width of a length or distance code."""
    if value < 5:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    half = v >> (top - 1) & 1
    return 2 * top + half, v - ((2 + half) << (top - 1)), top - 1


def _header(w: BitWriter, width: int, height: int, alpha: bool) -> None:
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (int(alpha), 1), (0, 3)):
        w.put(value, n)


def _file(w: BitWriter) -> bytes:
    body = w.bytes()
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def copies_of(data: bytes) -> list[tuple[int, int, int]]:
    """Back-references for lines seen before and runs of one byte: (start, length, distance), in order."""
    out: list[tuple[int, int, int]] = []
    seen: dict[bytes, int] = {}
    at = 0
    text = data.rstrip(b"\xff")
    if text.count(b"\n"):
        for line in text.splitlines(keepends=True):
            if len(line) >= 24:
                if line in seen:
                    out += [(k, min(4096, at + len(line) - k), at - seen[line]) for k in range(at, at + len(line), 4096)]
                seen[line] = at
            at += len(line)
    tail = len(data) - len(text)
    if tail > 4:
        out += [(k, min(4096, len(data) - k), 1) for k in range(len(text) + 1, len(data), 4096)]
    return out


def encode_samples(data: bytes, width: int = WIDTH) -> bytes:
    """A file with the bytes as green samples of rows of ``width``; their number must be a multiple of it."""
    samples = np.frombuffer(data, np.uint8)
    literal = np.ones(len(samples), bool)
    copies = copies_of(data)
    for start, n, _ in copies:
        literal[start : start + n] = False
    place = np.flatnonzero(literal)
    symbols = samples[place].astype(np.int64)
    extra = []
    for start, n, back in copies:
        code = 2 if back == 1 else back + 120
        extra.append((int(np.searchsorted(place, start)), *_prefix(n), *_prefix(code)))
    counts = np.bincount(symbols, minlength=280).tolist()
    far = [0] * 40
    for _, s, _, _, d, _, _ in extra:
        counts[256 + s] += 1
        far[d] += 1
    green, dist = code_lengths(counts), code_lengths(far)
    w = BitWriter()
    _header(w, width, len(samples) // width, False)
    for value, n in ((0, 1), (0, 1), (0, 1)):  # no transform, no cache, one group
        w.put(value, n)
    _write_code(w, green)
    for _ in range(3):
        _write_code(w, [1] + [0] * 255)
    _write_code(w, dist)
    code, size = np.array(_reversed_codes(green)), np.array(green)
    if sum(1 for n in green if n) == 1:
        size = size * 0
    far_code, far_size = _reversed_codes(dist), dist if sum(1 for n in dist if n) > 1 else [0] * 40
    done = 0
    for upto, s, x, n, d, y, m in extra:
        if upto > done:
            w.put_all(code[symbols[done:upto]], size[symbols[done:upto]])
            done = upto
        w.put(int(code[256 + s]), int(size[256 + s]))
        w.put(x, n)
        w.put(far_code[d], far_size[d])
        w.put(y, m)
    if done < len(symbols):
        w.put_all(code[symbols[done:]], size[symbols[done:]])
    return _file(w)


def _write_image(w: BitWriter, pixels: np.ndarray, main: bool, cache_bits: int = 0) -> None:
    """Literal pixels, or colour-cache hits, in one group."""
    flat = pixels.reshape(-1).tolist()
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)
    cache, symbols = [0] * (1 << cache_bits), []
    for v in flat:
        k = (CACHE_FACTOR * v & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if cache_bits and cache[k] == v:
            symbols.append((280 + k,))
        else:
            symbols.append((v >> 8 & 255, v >> 16 & 255, v & 255, v >> 24))
        cache[k] = v
    lengths = []
    for c, n in enumerate((280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)):
        counts = [0] * n
        for s in symbols:
            if c < len(s):
                counts[s[c]] += 1
        lengths.append(code_lengths(counts))
        _write_code(w, lengths[-1])
    codes = [_reversed_codes(n) for n in lengths]
    free = [sum(1 for n in x if n) < 2 for x in lengths]
    for s in symbols:
        for c, v in enumerate(s):
            if not free[c]:
                w.put(codes[c][v], lengths[c][v])


def encode_argb(image: np.ndarray, palette: bool = False, predictor: np.ndarray | None = None, cross: np.ndarray | None = None, subtract_green: bool = False, size: int = 2, cache_bits: int = 0) -> bytes:
    """A file with an image, height x width of 32-bit ARGB. predictor: the mode of each block of 2 ** size pixels;
    cross: its three cross-colour multipliers. Transforms are applied in the order palette, or predictor,
    cross-colour, subtract-green."""
    w = BitWriter()
    height, width = image.shape
    _header(w, width, height, True)
    if palette:
        table, index = np.unique(image, return_inverse=True)
        if len(table) > 256:
            raise ValueError("over 256 colours")
        index = index.reshape(height, width)
        w.put(1, 1)
        w.put(3, 2)
        w.put(len(table) - 1, 8)
        _write_image(w, _pixels(np.diff(_channels(table), axis=0, prepend=0)), False)
        bundle = _bundle(len(table))
        wide = 8 >> bundle
        padded = np.zeros((height, -(-width >> bundle) << bundle), np.uint32)
        padded[:, :width] = index
        image = (padded.reshape(height, -1, 1 << bundle) << (np.arange(1 << bundle, dtype=np.uint32) * wide)).sum(-1).astype(np.uint32) << 8 | 0xFF000000
    if predictor is not None:
        w.put(1, 1)
        w.put(0, 2)
        w.put(size - 2, 3)
        _write_image(w, predictor.astype(np.uint32) << 8 | 0xFF000000, False)
        image = _pixels(_walk_predictor(_channels(image), predictor, size, True))
    if cross is not None:
        w.put(1, 1)
        w.put(1, 2)
        w.put(size - 2, 3)
        c = cross.astype(np.int32) & 255
        _write_image(w, _pixels(np.stack([np.full(c.shape[:2], 255), c[..., 2], c[..., 1], c[..., 0]], -1)), False)
        image = _pixels(_walk_cross(_channels(image), c, size, True))
    if subtract_green:
        w.put(1, 1)
        w.put(2, 2)
        c = _channels(image)
        image = _pixels(np.stack([c[..., 0], c[..., 1] - c[..., 2], c[..., 2], c[..., 3] - c[..., 2]], -1))
    w.put(0, 1)
    _write_image(w, image, True, cache_bits)
    return _file(w)


# Texts as media


def padded(text: str) -> bytes:
    raw = text.encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))


def store(payload: bytes) -> bytes:
    most = MOST_ROWS * WIDTH
    return b"".join(encode_samples(payload[k : k + most]) for k in range(0, len(payload), most))


def load(media: bytes) -> bytes:
    """The payload of one or more files laid end to end."""
    out, at = [], 0
    while at < len(media):
        n = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append((decode(media[at : at + n]) >> 8 & 0xFF).astype(np.uint8).tobytes())
        at += n
    return b"".join(out)


def described(payload: bytes) -> str:
    """Rows, distinct values, mean sample and mean difference of neighbours, of what was read back."""
    x = np.frombuffer(payload, np.uint8)
    return f"{len(x) // WIDTH}x{WIDTH};values={int((np.bincount(x, minlength=256) > 0).sum())};mean={x.mean():.4f};step={np.abs(np.diff(x.astype(np.int16))).mean():.4f}"


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                media = store(padded(text))
                payload = load(media)
                rows.append((doc_id, len(text.encode()), len(payload), sha(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), sha(media).hexdigest(), described(payload)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(of, schema)
