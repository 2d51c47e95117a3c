"""Lossless WebP: a decoder for the whole of VP8L, and an encoder for grey images.

Decoder: RIFF container, canonical prefix codes (simple and normal, with meta codes), LZ77
back-references with the two-dimensional distance map, the colour cache, meta prefix images, and
the inverse of the predictor, cross-colour, subtract-green and colour-indexing transforms
(palettes with packed pixels included). The result is an array of ARGB pixels.

The serial part of decoding is finding where each code begins. For stretches where only green
varies (the other channels' codes have one symbol), all bit positions are looked up at once and
only the walk from code to code is a loop; elsewhere pixels are decoded one by one.

The encoder stores bytes as a grey image: subtract-green leaves red and blue 0, alpha is 255, so
each byte is one green symbol; at most 16 different bytes become a palette with several pixels in a
byte. Repeated stretches and the run at the end are back-references. Payloads of more than
``TILE_ROWS`` rows become several files, one after another. A colour cache, a predictor or
cross-colour would only cost here; the decoder has them, and tests write them.
"""

from __future__ import annotations

import heapq
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

WIDTH = 576  #: of stored images, in pixels
TILE_ROWS = 4096  #: rows of a stored image at most; the format allows 16,384
#: The order in which code length code lengths are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Fixed values: (x, y) of the short distance codes 1 to 120.
DISTANCE_MAP = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
LEAST_MATCH = 32  #: bytes of a repeated stretch from which on the encoder refers back to it
MOST_DISTANCE = (1 << 20) - 120  #: what the 40 distance symbols reach


class Damaged(ValueError):
    """The stream is not valid lossless WebP."""


# -- bits and prefix codes


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)
        self.padded = data + bytes(8)

    def peek(self) -> int:
        """At least 32 bits from the present position on."""
        at = self.at >> 3
        return int.from_bytes(self.padded[at : at + 6], "little") >> (self.at & 7)

    def read(self, n: int) -> int:
        if self.at + n > self.end:
            raise Damaged("the data end too early")
        out = self.peek() & ((1 << n) - 1)
        self.at += n
        return out


class Prefix:
    """A canonical prefix code: ``symbol`` and ``length`` by the next ``width`` bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if not len(used):
            raise Damaged("a code without symbols")
        self.only = int(used[0]) if len(used) == 1 else None
        self.width = 0 if self.only is not None else int(lengths.max())
        if self.only is not None:
            self.symbol, self.length = np.array([self.only], np.int32), np.zeros(1, np.int32)
        else:
            order = used[np.lexsort((used, lengths[used]))]
            if int((1 << (self.width - lengths[order].astype(np.int64))).sum()) != 1 << self.width:
                raise Damaged("a code that is not complete")
            self.symbol, self.length = np.zeros(1 << self.width, np.int32), np.zeros(1 << self.width, np.int32)
            code, last = 0, int(lengths[order[0]])
            for s in order.tolist():
                n = int(lengths[s])
                code <<= n - last
                last = n
                start = int(f"{code:0{n}b}"[::-1], 2)
                self.symbol[start :: 1 << n] = s
                self.length[start :: 1 << n] = n
                code += 1
        self.mask = (1 << self.width) - 1
        small = self.width <= 8  # larger tables are mostly read many at a time
        self.symbols, self.lengths = (self.symbol.tolist(), self.length.tolist()) if small else (self.symbol, self.length)
        self.jump = np.where(self.symbol < 256, self.length, 0).astype(np.int32)  # 0 at what isn't a literal

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        at = bits.peek() & self.mask
        bits.at += int(self.lengths[at])
        if bits.at > bits.end:
            raise Damaged("the data end too early")
        return int(self.symbols[at])


def read_code(bits: Bits, size: int) -> Prefix:
    lengths = np.zeros(size, np.int64)
    if bits.read(1):  # simple: one or two symbols
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        symbols = [first, bits.read(8)] if two else [first]
        if max(symbols) >= size:
            raise Damaged("a symbol outside the alphabet")
        lengths[symbols] = 1
        return Prefix(lengths)
    of_lengths = np.zeros(19, np.int64)
    for i in range(4 + bits.read(4)):
        of_lengths[LENGTH_ORDER[i]] = bits.read(3)
    code = Prefix(of_lengths)
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    if most > size:
        raise Damaged("too many code lengths")
    at, before = 0, 8
    while at < size and most:
        most -= 1
        n = code.read(bits)
        if n < 16:
            lengths[at] = n
            before = n or before
            at += 1
            continue
        value, times = (before, 3 + bits.read(2)) if n == 16 else (0, 3 + bits.read(3)) if n == 17 else (0, 11 + bits.read(7))
        if at + times > size:
            raise Damaged("code lengths beyond the alphabet")
        lengths[at : at + times] = value
        at += times
    return Prefix(lengths)


def _extra(symbol: int, bits: Bits) -> int:
    """The value of a length or distance prefix symbol with its extra bits."""
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + bits.read(n) + 1


# -- entropy-coded images


def _walk(bits: Bits, code: Prefix, most: int, window: int) -> np.ndarray:
    """Green literals from here on, at most ``most``, up to the first symbol of 256 or more, which is
    left unread. All bit positions of a window, larger each time, are looked up together; the walk takes four codes at
    a step, and what lies between is filled in afterwards."""
    out: list[np.ndarray] = []
    while most:
        n = min(bits.end - bits.at, window, most * code.width)
        window = min(window << 1, 1 << 18)
        if n <= 0:
            break
        first = bits.at >> 3
        raw = np.frombuffer(bits.padded, np.uint8, count=min(len(bits.padded) - first, n // 8 + 5), offset=first).astype(np.uint32)
        wide = raw[:-2] | raw[1:-1] << 8
        wide[:-1] |= raw[2:-1] << 16
        ahead = ((wide[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32(code.mask)).ravel()[bits.at & 7 :][:n]
        n = len(ahead)
        one = np.arange(n + 16, dtype=np.int32)  # places from n on lead to themselves
        one[:n] += code.jump[ahead]
        two = one[one]
        four = two[two]
        step, p, places = memoryview(four), 0, []
        add = places.append
        while True:
            add(p)
            q = step[p]
            if q == p or q >= n:
                break
            p = q
        at = np.array(places, np.int32)
        every = np.empty((len(at), 4), np.int32)
        every[:, 0], every[:, 1], every[:, 2] = at, one[at], two[at]
        every[:, 3] = one[every[:, 2]]
        every = every.ravel()
        every = every[(every < n) & (one[every] != every)][:most]
        if not len(every):
            break
        end = int(one[every[-1]])
        if bits.at + end > bits.end:
            raise Damaged("the data end too early")
        out.append(code.symbol[ahead[every]])
        most -= len(every)
        bits.at += end
        if end < n:  # a symbol that is no literal, or enough
            break
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def _image(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """An entropy-coded image as uint32 ARGB, ``top`` allowing a meta prefix image."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise Damaged("a colour cache that is too large")
    groups, meta, meta_bits = 1, None, 0
    if top and bits.read(1):
        meta_bits = bits.read(3) + 2
        tiles = _image(bits, (width + (1 << meta_bits) - 1) >> meta_bits, (height + (1 << meta_bits) - 1) >> meta_bits, False)
        meta = ((tiles >> 8) & 0xFFFF).astype(np.int64)
        groups = int(meta.max()) + 1
    sizes = (256 + 24 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    codes = [[read_code(bits, n) for n in sizes] for _ in range(groups)]
    total, at = width * height, 0
    out = np.zeros(total, np.uint32)
    cache = np.zeros(1 << cache_bits, np.uint32) if cache_bits else None
    cached = 0  # pixels before this place are in the cache

    def fill(upto: int) -> None:
        nonlocal cached
        if cached < upto:
            some = out[cached:upto]
            cache[(some * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)] = some  # the last of equal places stays
            cached = upto

    while at < total:
        if meta is not None:
            y, x = divmod(at, width)
            green, red, blue, alpha, distance = codes[meta[y >> meta_bits, x >> meta_bits]]
            stop = min(total, at - x + min(width, ((x >> meta_bits) + 1) << meta_bits))  # the group may change there
        else:
            green, red, blue, alpha, distance = codes[0]
            stop = total
        if red.only is not None and blue.only is not None and alpha.only is not None:
            if green.only is not None and green.only < 256:
                literals = np.full(stop - at, green.only, np.int32)
            else:
                # where back-references of several distances are about, the next one may be near
                literals = _walk(bits, green, stop - at, 1 << 18 if distance.only is not None else 1 << 12) if green.only is None else np.zeros(0, np.int32)
            if len(literals):
                out[at : at + len(literals)] = np.uint32(alpha.only << 24 | red.only << 16 | blue.only) | literals.astype(np.uint32) << np.uint32(8)
                at += len(literals)
                continue
        s = green.read(bits)
        if s < 256:
            r = red.read(bits)
            b = blue.read(bits)
            out[at] = alpha.read(bits) << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < 280:
            n = _extra(s - 256, bits)
            d = _extra(distance.read(bits), bits)
            if d > 120:
                d -= 120
            else:
                dx, dy = DISTANCE_MAP[d - 1]
                d = max(1, dx + dy * width)
            if d > at or at + n > total:
                raise Damaged("a back-reference outside the image")
            if d >= n:
                out[at : at + n] = out[at - d : at - d + n]
            else:
                out[at : at + n] = np.resize(out[at - d : at], n)
            at += n
        else:
            fill(at)
            out[at] = cache[s - 280]
            at += 1
        if bits.at > bits.end:
            raise Damaged("the data end too early")
    return out.reshape(height, width)


# -- inverse transforms


def _channels(argb: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(argb, dtype="<u4").view(np.uint8).reshape(*argb.shape, 4)  # b, g, r, a


def _packed(bgra: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(bgra, np.uint8).view("<u4").reshape(bgra.shape[:-1])


def _add_green(argb: np.ndarray) -> np.ndarray:
    c = _channels(argb).copy()
    c[..., 0] += c[..., 1]
    c[..., 2] += c[..., 1]
    return _packed(c)


def _cross_colour(argb: np.ndarray, data: np.ndarray, size_bits: int) -> np.ndarray:
    h, w = argb.shape
    c = _channels(argb).copy()
    e = _channels(data).view(np.int8).astype(np.int32)[(np.arange(h) >> size_bits)[:, None], (np.arange(w) >> size_bits)[None, :]]
    green = c[..., 1].view(np.int8).astype(np.int32)
    red = (c[..., 2].astype(np.int32) + ((e[..., 0] * green) >> 5)) & 255
    signed = red.astype(np.uint8).view(np.int8).astype(np.int32)
    blue = (c[..., 0].astype(np.int32) + ((e[..., 1] * green) >> 5) + ((e[..., 2] * signed) >> 5)) & 255
    c[..., 2], c[..., 0] = red, blue
    return _packed(c)


def _predictor(argb: np.ndarray, data: np.ndarray, size_bits: int) -> np.ndarray:
    """Row by row. Modes that look only at the row above work on whole stretches; those that need the
    pixel to the left go pixel by pixel."""
    h, w = argb.shape
    out = _channels(argb).astype(np.int32).copy()
    modes = ((data >> 8) & 0xFF).astype(np.int64)
    if int(modes.max(initial=0)) > 13:
        modes = np.where(modes > 13, 0, modes)
    out[0, 0, 3] = (out[0, 0, 3] + 255) & 255
    if w > 1:
        out[0] = np.cumsum(out[0], axis=0) & 255
    for y in range(1, h):
        up, row = out[y - 1], out[y]
        row[0] = (row[0] + up[0]) & 255
        # the pixel above and to the right of the last one is the first of this row
        right = np.concatenate([up[1:], row[:1]])
        for tile in range((w + (1 << size_bits) - 1) >> size_bits):
            a, b = max(1, tile << size_bits), min(w, (tile + 1) << size_bits)
            if a >= b:
                continue
            mode = int(modes[y >> size_bits, tile])
            t, tr, tl = up[a:b], right[a:b], up[a - 1 : b - 1]
            if mode == 0:
                row[a:b, 3] = (row[a:b, 3] + 255) & 255
            elif mode in (2, 3, 4, 8, 9):
                row[a:b] = (row[a:b] + (t if mode == 2 else tr if mode == 3 else tl if mode == 4 else (tl + t) >> 1 if mode == 8 else (t + tr) >> 1)) & 255
            elif mode == 1:
                row[a:b] = (row[a - 1] + np.cumsum(row[a:b], axis=0)) & 255
            else:
                _serial(row, up, right, a, b, mode)
    return _packed(out.astype(np.uint8))


def _serial(row: np.ndarray, up: np.ndarray, right: np.ndarray, a: int, b: int, mode: int) -> None:
    left = row[a - 1]
    for x in range(a, b):
        t, tr, tl = up[x], right[x], up[x - 1]
        if mode == 5:
            p = (((left + tr) >> 1) + t) >> 1
        elif mode == 6:
            p = (left + tl) >> 1
        elif mode == 7:
            p = (left + t) >> 1
        elif mode == 10:
            p = (((left + tl) >> 1) + ((t + tr) >> 1)) >> 1
        elif mode == 11:  # whichever is nearer to left + top - top left
            p = left if int(np.abs(t - tl).sum()) < int(np.abs(left - tl).sum()) else t
        elif mode == 12:
            p = np.clip(left + t - tl, 0, 255)
        else:
            mean = (left + t) >> 1
            p = np.clip(mean + np.trunc((mean - tl) / 2).astype(np.int32), 0, 255)
        left = row[x] = (row[x] + p) & 255


def _palette(argb: np.ndarray, table: np.ndarray, width: int, width_bits: int) -> np.ndarray:
    """Indexes, 1 to 8 of them in a pixel's green, to colours; indexes beyond the table are clear."""
    index = ((argb >> 8) & 0xFF).astype(np.int64)
    if width_bits:
        per, size = 1 << width_bits, 8 >> width_bits
        index = ((index[:, :, None] >> (np.arange(per) * size)) & ((1 << size) - 1)).reshape(len(index), -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(table)] = table
    return full[index]


def decode(data: bytes) -> np.ndarray:
    """The ARGB pixels (uint32, height x width) of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise Damaged("not WebP")
    at, body = 12, None
    while at + 8 <= len(data) and body is None:
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"VP8L":
            body = data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if not body or body[0] != 0x2F:
        raise Damaged("no lossless image")
    bits = Bits(body)
    bits.at = 8
    width, height = bits.read(14) + 1, bits.read(14) + 1
    alpha, version = bits.read(1), bits.read(3)
    if version:
        raise Damaged("an unknown version")
    undo, seen, now = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise Damaged("a transform twice")
        seen.add(kind)
        if kind in (0, 1):
            size_bits = bits.read(3) + 2
            tiles = _image(bits, (now + (1 << size_bits) - 1) >> size_bits, (height + (1 << size_bits) - 1) >> size_bits, False)
            undo.append(lambda x, f=(_predictor, _cross_colour)[kind], t=tiles, s=size_bits: f(x, t, s))
        elif kind == 2:
            undo.append(_add_green)
        else:
            n = bits.read(8) + 1
            table = _packed(np.cumsum(_channels(_image(bits, n, 1, False))[0], axis=0, dtype=np.uint8)[None])[0]
            width_bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append(lambda x, t=table, w=now, b=width_bits: _palette(x, t, w, b))
            now = (now + (1 << width_bits) - 1) >> width_bits
    pixels = _image(bits, now, height, True)
    for f in reversed(undo):
        pixels = f(pixels)
    return pixels if alpha else pixels | np.uint32(0xFF000000)


def files(data: bytes) -> list[bytes]:
    """Concatenated RIFF files, one by one."""
    out, at = [], 0
    while at < len(data):
        size = struct.unpack_from("<I", data, at + 4)[0] + 8
        out.append(data[at : at + size + (size & 1)])
        at += size + (size & 1)
    return out


# -- the encoder


def code_lengths(counts: np.ndarray, most: int = 12) -> np.ndarray:
    """Huffman code lengths of at most ``most`` bits: rare symbols are taken as less rare until the
    code fits."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    floor = 1
    while True:
        heap = [(max(int(counts[s]), floor), i, s) for i, s in enumerate(used.tolist())]
        heapq.heapify(heap)
        parent: dict[int, int] = {}
        n = len(counts)
        tick = len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            parent[a[2]] = parent[b[2]] = n
            heapq.heappush(heap, (a[0] + b[0], tick, n))
            n += 1
            tick += 1
        depth = {heap[0][2]: 0}
        for node in sorted(parent, reverse=True):
            depth[node] = depth[parent[node]] + 1
        lengths[used] = [depth[s] for s in used.tolist()]
        if lengths.max() <= most:
            return lengths
        floor = floor * 2 if floor > 1 else max(2, int(counts.sum()) >> 14)


def codewords(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes with their bits in the order of the stream."""
    out, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    used = np.flatnonzero(lengths)
    for s in used[np.lexsort((used, lengths[used]))].tolist():
        n = int(lengths[s])
        code <<= n - last
        last = n
        out[s] = int(f"{code:0{n}b}"[::-1], 2)
        code += 1
    return out


class Writer:
    def __init__(self):
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.single: list[int] = []  # values and sizes in turn that wait to become arrays

    def put(self, value: int, n: int) -> None:
        self.single += (value, n)

    def all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        if self.single:
            pairs = np.array(self.single, np.int64).reshape(-1, 2)
            self.values.append(pairs[:, 0].astype(np.uint64))
            self.sizes.append(pairs[:, 1])
            self.single = []
        self.values.append(values)
        self.sizes.append(sizes)

    def data(self) -> bytes:
        self.all(np.zeros(0, np.uint64), np.zeros(0, np.int64))
        values, sizes = np.concatenate(self.values), np.concatenate(self.sizes)
        values, sizes = values[sizes > 0], sizes[sizes > 0]
        ends = np.cumsum(sizes)
        at = ends - sizes
        words = np.zeros(int(ends[-1]) // 32 + 2, np.uint64)
        shifted = values << (at & 31).astype(np.uint64)  # 32 bits and 31 more at most
        first = at >> 5
        heads = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
        low, high = np.bitwise_or.reduceat(shifted & np.uint64(0xFFFFFFFF), heads), np.bitwise_or.reduceat(shifted >> np.uint64(32), heads)
        words[first[heads]] |= low
        words[first[heads] + 1] |= high
        return words.astype("<u4").tobytes()[: (int(ends[-1]) + 7) // 8]


def _put_code(out: Writer, lengths: np.ndarray) -> None:
    """A normal prefix code; code lengths by a fixed code of four bits, without repeats, but for
    zeros, which are run-length coded."""
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (len(used) == 0 or used.max() < 256):
        symbols = used.tolist() or [0]
        out.put(1, 1)
        out.put(len(symbols) - 1, 1)
        out.put(1, 1)
        for s in symbols:
            out.put(s, 8)
        return
    items: list[tuple[int, int, int]] = []  # symbol, extra, extra bits
    i, plain = 0, lengths.tolist()
    while i < len(plain):
        n = plain[i]
        run = 1
        while n == 0 and run < 138 and i + run < len(plain) and plain[i + run] == 0:
            run += 1
        if n == 0 and run >= 11:
            items.append((18, run - 11, 7))
        elif n == 0 and run >= 3:
            items.append((17, run - 3, 3))
        else:
            items += [(n, 0, 0)] * run
        i += run
    own = code_lengths(np.bincount([x[0] for x in items], minlength=19), 7)
    words, own = codewords(own).tolist(), own.tolist()
    out.put(0, 1)
    last = max(i for i, s in enumerate(LENGTH_ORDER) if own[s])
    n = max(4, last + 1)
    out.put(n - 4, 4)
    for s in LENGTH_ORDER[:n]:
        out.put(own[s], 3)
    out.put(0, 1)
    single = sum(x > 0 for x in own) == 1  # a code of one symbol has no bits
    for s, extra, size in items:
        if not single:
            out.put(words[s], own[s])
        if size:
            out.put(extra, size)


def _length_symbol(n: int) -> tuple[int, int, int]:
    """The prefix symbol of a length or distance with its extra bits."""
    n -= 1
    if n < 4:
        return n, 0, 0
    high = n.bit_length() - 1
    second = (n >> (high - 1)) & 1
    return 2 * high + second, n & ((1 << (high - 1)) - 1), high - 1


def repeats(flat: np.ndarray, least: int = LEAST_MATCH) -> list[tuple[int, int, int]]:
    """(start, length, distance) of stretches that stand before, in order and apart; the run at the end
    is always one. Of the windows of 16 bytes those are compared whose hash ends in zeros, one in eight or so,
    whichever text they stand in; what two equal ones begin is then followed byte by byte to both sides."""
    n = len(flat)
    changes = np.flatnonzero(flat != flat[-1])
    tail = int(changes[-1]) + 2 if len(changes) else 1
    out: list[tuple[int, int, int]] = []
    if tail > 2 * least:
        data = flat[:tail].tobytes()
        eight = np.ndarray((tail - 7,), "<u8", data, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
        key = eight[:-8] ^ (eight[8:] >> np.uint64(7))
        some = np.flatnonzero((key >> np.uint64(40)) & np.uint64(7) == 0)
        own = key[some]
        order = np.argsort(own, kind="stable")
        same = own[order[1:]] == own[order[:-1]]
        if same.any():
            at, before = some[order[1:][same]], some[order[:-1][same]]
            by = np.argsort(at)
            end = 0
            for p, q in zip(at[by].tolist(), before[by].tolist(), strict=True):
                d = p - q
                if p + 16 <= end or d > MOST_DISTANCE:
                    continue
                start = max(p, end)
                stop = start + _alike(flat, start, start - d, tail - start)
                start -= _alike(flat[::-1], n - start, n - start + d, start - max(end, d))
                if stop - start >= least:
                    out.append((start, stop - start, d))
                    end = stop
    if tail < n:
        out.append((tail, n - tail, 1))
    return out


def _alike(flat: np.ndarray, a: int, b: int, most: int) -> int:
    """How many values from a and from b on are equal, at most ``most``."""
    done, size = 0, 64
    while done < most:
        size = min(size, most - done)
        differ = flat[a + done : a + done + size] != flat[b + done : b + done + size]
        if differ.any():
            return done + int(differ.argmax())
        done += size
        size *= 4
    return done


def _put_single(out: Writer, symbol: int) -> None:
    one = np.zeros(256, np.int64)
    one[symbol] = 1
    _put_code(out, one)


def _put_pixels(out: Writer, flat: np.ndarray, alpha: int) -> None:
    """The entropy-coded image whose greens are ``flat`` and whose reds and blues are 0."""
    literals, told, at = [], [], 0
    for start, length, d in repeats(flat):
        literals.append(flat[at:start].astype(np.int64))
        code = _length_symbol(2 if d == 1 else d + 120)  # the second short code is the pixel to the left
        parts = [(_length_symbol(min(4096, length - i)), code) for i in range(0, length, 4096)]
        told.append(parts)
        at = start + length
    rest = flat[at:].astype(np.int64)
    of_lengths = [256 + x[0] for parts in told for x, _ in parts]
    green = code_lengths(np.bincount(np.concatenate([*literals, rest, np.array(of_lengths, np.int64)]), minlength=280))
    distances = [d[0] for parts in told for _, d in parts]
    far = code_lengths(np.bincount(np.array(distances or [1], np.int64), minlength=40))
    _put_code(out, green)
    for only in (0, 0, alpha):
        _put_single(out, only)
    _put_code(out, far)
    green_words, far_words = codewords(green), codewords(far)
    # a code of one symbol has no bits
    green_sizes = green * int((green > 0).sum() > 1)
    far_sizes = far * int((far > 0).sum() > 1)
    for own, parts in zip(literals, told, strict=True):
        if len(own):
            out.all(green_words[own], green_sizes[own])
        for (s, extra, bits), (d, far_extra, far_bits) in parts:
            out.put(int(green_words[256 + s]), int(green_sizes[256 + s]))
            out.put(extra, bits)
            out.put(int(far_words[d]), int(far_sizes[d]))
            out.put(far_extra, far_bits)
    if len(rest):
        out.all(green_words[rest], green_sizes[rest])


def _put_palette(out: Writer, colours: np.ndarray) -> None:
    """The colour-indexing transform with grey colours, as differences."""
    out.put(1, 1)
    out.put(3, 2)
    out.put(len(colours) - 1, 8)
    out.put(0, 1)  # no colour cache
    grey = np.diff(colours.astype(np.int64), prepend=0) % 256
    alpha = np.array([255] + [0] * (len(colours) - 1))
    codes = []
    for values, size in ((grey, 280), (grey, 256), (grey, 256), (alpha, 256)):
        lengths = code_lengths(np.bincount(values, minlength=size))
        _put_code(out, lengths)
        codes.append((codewords(lengths), lengths * int((lengths > 0).sum() > 1), values))
    _put_single(out, 0)
    for i in range(len(colours)):
        for words, sizes, values in codes:
            out.put(int(words[values[i]]), int(sizes[values[i]]))


def encode_grey(samples: np.ndarray) -> bytes:
    """A WebP file with the rows of ``samples`` (uint8, height x width) as a grey image: by a palette of
    packed pixels where there are at most 16 values, else by subtract-green; stretches that stand before
    are back-references."""
    height, width = samples.shape
    out = Writer()
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(0, 1)
    out.put(0, 3)
    colours = np.flatnonzero(np.bincount(samples.ravel(), minlength=256))
    if len(colours) <= 16:
        _put_palette(out, colours)
        per = 8 if len(colours) <= 2 else 4 if len(colours) <= 4 else 2
        index = np.searchsorted(colours, samples)
        padded = np.zeros((height, -(-width // per) * per), np.int64)
        padded[:, :width] = index
        flat = (padded.reshape(height, -1, per) << (np.arange(per) * (8 // per))).sum(2).astype(np.uint8).ravel()
    else:
        out.put(1, 1)
        out.put(2, 2)  # subtract green
        flat = samples.ravel()
    out.put(0, 1)  # no more transforms
    out.put(0, 1)  # no colour cache
    out.put(0, 1)  # no meta prefix codes
    _put_pixels(out, flat, 255)
    body = b"\x2f" + out.data()
    body += bytes(len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body


# -- texts as images


def store(payload: bytes) -> bytes:
    """The payload, a multiple of WIDTH bytes, as one file or several."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return b"".join(encode_grey(rows[i : i + TILE_ROWS]) for i in range(0, len(rows), TILE_ROWS))


def load(media: bytes) -> np.ndarray:
    """Grey values of the stored files, row after row."""
    return np.concatenate([((decode(f) >> 8) & 0xFF).astype(np.uint8) for f in files(media)])


def pad(text: bytes) -> bytes:
    size = max(1, -(-len(text) // WIDTH)) * WIDTH
    return text + b"\xff" * (size - len(text))


def features(pixels: np.ndarray) -> str:
    """Size, mean, deviation and entropy of the grey values, and the share of pixels that differ from
    the one before."""
    counts = np.bincount(pixels.ravel(), minlength=256)
    n = pixels.size
    p = counts[counts > 0] / n
    values = np.arange(256)
    mean = float((counts * values).sum() / n)
    deviation = float(np.sqrt((counts * (values - mean) ** 2).sum() / n))
    changed = float((np.diff(pixels.ravel()) != 0).mean())
    return f"{pixels.shape[1]}x{pixels.shape[0]} mean={mean:.4f} dev={deviation:.4f} entropy={-(p * np.log2(p)).sum() + 0.0:.4f} changed={changed:.4f}"


def image_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the stored files) for each row of ``docs`` (doc_id, text).

    Cases: a null or empty text is one row of bytes 255; equal texts give equal media; the length
    has no limit but memory; an empty table gives no rows; other columns are not read."""

    def write(batches):
        for b in batches:
            for at in range(0, b.num_rows, 128):
                some = b.slice(at, 128)
                texts = [(t or "").encode() for t in some.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(list(map(len, texts)), pa.int64()), pa.array([store(pad(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(write, f"doc_id {kind}, n_bytes bigint, media binary")


def pixel_facts(media: DataFrame) -> DataFrame:
    """Decodes ``media`` and returns checksums of what was read, and features."""
    import hashlib

    def read(batches):
        for b in batches:
            out = []
            for n, m in zip(b.column("n_bytes").to_pylist(), b.column("media").to_pylist(), strict=True):
                pixels = load(m)
                p = pixels.tobytes()
                out.append((n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), features(pixels)))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *names])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.mapInArrow(read, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def op8_webp_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.common import cut, documents

    return pixel_facts(cut(image_columns(documents(spark, sf_dir))))
