"""The WebP decoder against images written here with each transform, and round trips."""

import hashlib
import zlib

import numpy as np
import pytest

from tessera.llm import webp as W


def put_image(out: W.Writer, argb: np.ndarray, top: bool, cache_bits: int = 0, codes: list | None = None):
    """An entropy-coded image: five codes over literals, with colour cache hits if asked for."""
    flat = argb.ravel().tolist()
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if top:
        out.put(0, 1)
    cache, items = {}, []
    for c in flat:
        slot = ((c * W.CACHE_FACTOR) & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
        if cache_bits and cache.get(slot, 0) == c:
            items.append((280 + slot,))
        else:
            items.append((c >> 8 & 255, c >> 16 & 255, c & 255, c >> 24))
        cache[slot] = c
    sizes = (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    lengths, words = [], []
    for k, n in enumerate(sizes):
        counts = np.bincount([i[k] for i in items if len(i) > k] or [0], minlength=n)
        lengths.append(W.code_lengths(counts))
        words.append(W.codewords(lengths[-1]))
        W._put_code(out, lengths[-1])
    for i in items:
        for k, s in enumerate(i):
            if (lengths[k] > 0).sum() > 1:
                out.put(int(words[k][s]), int(lengths[k][s]))


def file_of(width: int, height: int, write) -> bytes:
    import struct

    out = W.Writer()
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    write(out)
    body = b"\x2f" + out.data()
    body += bytes(len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body


@pytest.fixture
def pixels():
    draw = np.random.default_rng(2)
    return draw.choice(draw.integers(0, 1 << 32, 40, dtype=np.uint32), (13, 21))


@pytest.mark.parametrize("cache_bits", [0, 1, 4, 11])
def test_plain_and_cache(pixels, cache_bits):
    def write(out):
        out.put(0, 1)
        put_image(out, pixels, True, cache_bits)

    assert (W.decode(file_of(21, 13, write)) == pixels).all()


@pytest.mark.parametrize("colours", [1, 2, 4, 9, 16, 40])
def test_palette(colours):
    draw = np.random.default_rng(colours)
    table = draw.integers(0, 1 << 32, colours, dtype=np.uint32)
    index = draw.integers(0, colours, (7, 19))
    bits = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    per, size = 1 << bits, 8 >> bits
    packed = np.zeros((7, -(-19 // per)), np.uint32)
    for y in range(7):
        for x in range(19):
            packed[y, x // per] |= np.uint32(int(index[y, x]) << (8 + size * (x % per)))
    deltas = W._channels(table).copy()
    deltas[1:] -= W._channels(table)[:-1]

    def write(out):
        out.put(1, 1)
        out.put(3, 2)
        out.put(colours - 1, 8)
        put_image(out, W._packed(deltas)[None], False)
        out.put(0, 1)
        put_image(out, packed | np.uint32(0xFF000000), True)

    assert (W.decode(file_of(19, 7, write)) == table[index]).all()


def predicted(p, y, x, mode):
    """The prediction for one pixel, by channel, as the format words it."""
    h = lambda a, b: [(i + j) // 2 for i, j in zip(a, b, strict=True)]
    at = lambda yy, xx: [int(v) for v in p[yy, xx]]
    if y == 0 and x == 0:
        return [0, 0, 0, 255]
    if y == 0:
        return at(0, x - 1)
    if x == 0:
        return at(y - 1, 0)
    left, top, corner = at(y, x - 1), at(y - 1, x), at(y - 1, x - 1)
    right = at(y - 1, x + 1) if x + 1 < p.shape[1] else at(y, 0)
    clip = lambda v: max(0, min(255, v))
    if mode == 11:
        guess = [a + b - c for a, b, c in zip(left, top, corner, strict=True)]
        near = lambda q: sum(abs(g - v) for g, v in zip(guess, q, strict=True))
        return left if near(left) < near(top) else top
    if mode == 13:
        return [clip(m + int((m - c) / 2)) for m, c in zip(h(left, top), corner, strict=True)]
    return {
        0: [0, 0, 0, 255], 1: left, 2: top, 3: right, 4: corner, 5: h(h(left, right), top), 6: h(left, corner), 7: h(left, top), 8: h(corner, top), 9: h(top, right),
        10: h(h(left, corner), h(top, right)), 12: [clip(a + b - c) for a, b, c in zip(left, top, corner, strict=True)],
    }[mode]


@pytest.mark.parametrize("mode", range(14))
def test_predictors(pixels, mode):
    p = W._channels(pixels)
    residual = np.zeros_like(p)
    for y in range(13):
        for x in range(21):
            residual[y, x] = [(int(a) - b) & 255 for a, b in zip(p[y, x], predicted(p, y, x, mode), strict=True)]

    def write(out):
        out.put(1, 1)
        out.put(0, 2)
        out.put(1, 3)  # tiles of 8
        put_image(out, np.full((2, 3), mode << 8 | 0xFF000000, np.uint32), False)
        out.put(0, 1)
        put_image(out, W._packed(residual), True)

    assert (W.decode(file_of(21, 13, write)) == pixels).all()


def test_cross_colour_and_green(pixels):
    c = W._channels(pixels).astype(int)
    signed = lambda v: v - 256 if v > 127 else v
    g2r, g2b, r2b = 200, 17, 131
    out_ = c.copy()
    for y in range(13):
        for x in range(21):
            b, g, r, _ = c[y, x]
            out_[y, x, 2] = (r - ((signed(g2r) * signed(g)) >> 5)) & 255
            out_[y, x, 0] = (b - ((signed(g2b) * signed(g)) >> 5) - ((signed(r2b) * signed(r)) >> 5)) & 255
    stored = out_.copy()
    stored[..., 0] = (stored[..., 0] - stored[..., 1]) & 255
    stored[..., 2] = (stored[..., 2] - stored[..., 1]) & 255

    def write(out):
        out.put(1, 1)
        out.put(1, 2)
        out.put(0, 3)
        put_image(out, np.full((4, 6), 0xFF << 24 | r2b << 16 | g2b << 8 | g2r, np.uint32), False)
        out.put(1, 1)
        out.put(2, 2)
        out.put(0, 1)
        put_image(out, W._packed(stored.astype(np.uint8)), True)

    assert (W.decode(file_of(21, 13, write)) == pixels).all()


def test_back_references_and_meta_codes():
    """Two groups of codes by tile, copies from the left and from the row above."""
    width, height = 8, 8
    expected = np.zeros((height, width), np.uint32)

    def write(out):
        out.put(0, 1)
        out.put(0, 1)
        out.put(1, 1)  # a meta image with tiles of 4
        out.put(0, 3)
        put_image(out, np.array([[0, 1 << 8], [0, 1 << 8]], np.uint32) | np.uint32(0xFF000000), False)
        greens = []
        for group in range(2):
            counts = np.zeros(280, np.int64)
            counts[[10 + group, 20 + group, 256 + 3, 256 + 5]] = 1
            green = W.code_lengths(counts)
            greens.append((green, W.codewords(green)))
            W._put_code(out, green)
            for only in (7, 9, 255):
                one = np.zeros(256, np.int64)
                one[only] = 1
                W._put_code(out, one)
            distance = np.zeros(40, np.int64)
            distance[[0, 1]] = 1
            W._put_code(out, distance)
        colour = lambda g: 0xFF << 24 | 7 << 16 | g << 8 | 9
        flat = expected.ravel()
        at = 0
        while at < width * height:
            y, x = divmod(at, width)
            green, words = greens[(x // 4) % 2]
            group = (x // 4) % 2
            if y == 0 or (x < 4 and y % 3 == 0):
                g = (10 if (x + y) % 2 else 20) + group
                out.put(int(words[g]), int(green[g]))
                flat[at] = colour(g)
                at += 1
            else:
                n = min(4, width * height - at)
                if n < 4:
                    g = 10 + group
                    out.put(int(words[g]), int(green[g]))
                    flat[at] = colour(g)
                    at += 1
                    continue
                out.put(int(words[256 + 3]), int(green[256 + 3]))  # a length of 4
                up = y % 2
                out.put(0 if up else 1, 1)  # code 1 is the row above, code 2 the pixel to the left
                for _ in range(4):
                    flat[at] = flat[at - (width if up else 1)]
                    at += 1

    data = file_of(width, height, write)
    assert (W.decode(data) == expected).all()


@pytest.mark.parametrize("payload", [b"", b"a", b"\xff" * 576, b"ab" * 1000, bytes(range(256)) * 100, "日本語 é".encode() * 99])
def test_round_trips(payload):
    padded = W.pad(payload)
    assert len(padded) % 576 == 0 and len(padded) > 0
    assert W.load(W.store(padded)).tobytes() == padded


def test_many_tiles():
    payload = np.random.default_rng(1).integers(0, 256, 576 * 9000, dtype=np.uint8).tobytes()
    media = W.store(payload)
    assert len(W.files(media)) == 3 and W.load(media).tobytes() == payload


@pytest.mark.parametrize("bad", [b"", b"RIFF", b"RIFF\x00\x00\x00\x00WEBPVP8 \x00\x00\x00\x00"])
def test_damaged(bad):
    with pytest.raises(W.Damaged):
        W.decode(bad)


def test_damaged_bits():
    data = bytearray(W.store(W.pad(b"some text to damage" * 50)))
    for at in range(20, len(data), 7):
        some = bytearray(data)
        some[at] ^= 0x55
        try:
            W.load(bytes(some))
        except (W.Damaged, ValueError):
            pass


def test_columns(odd, empty):
    rows = W.pixel_facts(W.image_columns(odd)).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in odd.collect()}
    for r in rows:
        padded = W.pad(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"]) == (len(texts[r["doc_id"]]), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-32:])
    assert len({(r["media_sha256"], r["feature"]) for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert W.pixel_facts(W.image_columns(empty)).count() == 0


def test_repeats():
    """Every stretch stands before, they lie apart and in order, and long copies are found."""
    draw = np.random.default_rng(2)
    own = draw.integers(0, 256, 700, dtype=np.uint8)
    for flat in (np.tile(own, 4), np.concatenate([own, own[100:400], own[::-1], own[50:90]]), np.tile(own[:33], 60), np.full(5000, 7, np.uint8), draw.integers(0, 2, 3000, dtype=np.uint8)):
        found, end = W.repeats(flat), 0
        for start, length, d in found:
            assert start >= max(end, d) and d > 0 and (flat[start : start + length] == flat[start - d : start - d + length]).all()
            end = start + length
        assert end <= len(flat)
    assert sum(n for _, n, _ in W.repeats(np.tile(own, 4))) == 2100
    assert W.repeats(draw.permutation(256).astype(np.uint8)) == []


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 16, 17, 200])
def test_alphabets(size):
    """Palettes of every width of packed pixels, and none beyond 16 colours."""
    draw = np.random.default_rng(size)
    payload = draw.choice(draw.permutation(256)[:size], 576 * 5).astype(np.uint8)
    payload[:size] = np.unique(payload)[0] if size == 1 else payload[:size]
    media = W.store(payload.tobytes())
    assert W.load(media).tobytes() == payload.tobytes()
    bits = W.Bits(media[21:])
    bits.at = 32
    assert (bits.read(1), bits.read(2)) == (1, 3 if len(np.unique(payload)) <= 16 else 2)


def test_repeated_text_is_small():
    line = b"a line that stands in this document again and again, word for word\n"
    once, often = W.store(W.pad(line * 9)), W.store(W.pad(line * 900))
    assert len(often) < len(once) + 200 and W.load(often).tobytes() == W.pad(line * 900)
