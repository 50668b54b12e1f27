import struct
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from lumenshelf.llm import webp


@pytest.mark.parametrize("shape", [(1, 1), (1, 7), (3, 5), (40, 144), (300, 144)])
@pytest.mark.parametrize("top", [1, 2, 5, 256])
def test_round_trip(shape, top):
    samples = np.random.default_rng(top).integers(0, top, (*shape, 4)).astype(np.uint8)
    samples[shape[0] // 2 :] = 255
    assert (webp.decode(webp.encode(samples)) == samples).all()


class Stream(webp.Writer):
    """Writes streams by hand, feature by feature."""

    def start(self, width, height, alpha=1):
        for value, bits in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (alpha, 1), (0, 3)):
            self.write(value, bits)
        return self

    def flat_codes(self, green=256 + 24):
        """Codes of eight bits for literals (green's others are unused), and distance code 2."""
        for size in (green, 256, 256, 256):
            lengths = np.zeros(size, np.int64)
            lengths[:256] = 8
            webp.write_code(self, lengths)
        one = np.zeros(40, np.int64)
        one[1] = 1
        webp.write_code(self, one)
        return self

    def pixels(self, argb):
        for p in argb:
            for shift in (8, 16, 0, 24):
                self.write(int(webp.reversed_bits(8)[p >> shift & 255]), 8)
        return self

    def image(self, argb):
        """A nested image: no colour cache."""
        self.write(0, 1)
        return self.flat_codes().pixels(argb)

    def file(self):
        data = self.value.to_bytes((self.at + 7) // 8 + 1, "little")
        chunk = b"VP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
        return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def rgba(argb, width):
    a = np.array(argb, np.int64)
    return np.stack([a >> 16 & 255, a >> 8 & 255, a & 255, a >> 24 & 255], -1).astype(np.uint8).reshape(-1, width, 4)


def some_pixels(n, seed=0):
    return [int(x) for x in np.random.default_rng(seed).integers(0, 1 << 32, n)]


def end_of_transforms(stream):
    for bit in (0, 0, 0):  # no more transforms, no colour cache, one group of codes
        stream.write(bit, 1)
    return stream


def test_subtract_green():
    pixels = some_pixels(12)
    coded = [webp.join(*(np.array([c]) for c in (p >> 24, (p >> 16) - (p >> 8), p >> 8, p - (p >> 8))))[0] for p in pixels]
    stream = Stream().start(4, 3)
    stream.write(0b101, 3)  # one transform, of kind 2
    assert (webp.decode(end_of_transforms(stream).flat_codes().pixels(coded).file()) == rgba(pixels, 4)).all()


@pytest.mark.parametrize("mode", range(14))
def test_prediction(mode):
    width, height = 7, 6
    pixels = some_pixels(width * height, mode)
    rest = []
    for at, p in enumerate(pixels):
        guess = webp.predicted(pixels[:at] + [0], at, width, mode)
        rest.append(sum(((p >> s) - (guess >> s) & 255) << s for s in (0, 8, 16, 24)))
    stream = Stream().start(width, height)
    stream.write(0b001, 3)
    stream.write(0, 3)  # tiles of 4 x 4
    stream.image([mode << 8] * 4)
    assert (webp.decode(end_of_transforms(stream).flat_codes().pixels(rest).file()) == rgba(pixels, width)).all()


def test_predictors_by_hand():
    left, top, right, corner = 0x10203040, 0x50607080, 0x01020304, 0x0F0F0F0F
    p = [f(left, top, right, corner) for f in webp.PREDICTORS]
    assert p[:5] == [0xFF000000, left, top, right, corner]
    assert p[7] == 0x30405060 and p[12] == 0x517191B1 and p[11] == top
    assert p[13] == 0x30405060 + (0x30405060 - 0x0F0F0F0F >> 1 & 0x7F7F7F7F)


def test_cross_colour():
    pixels, width = some_pixels(20, 3), 5
    to_red, to_blue, red_to_blue = 0x25, 0xF3, 0x81
    times = lambda t, c: (t - 256 * (t >= 128)) * (c - 256 * (c >= 128)) >> 5
    coded = []
    for p in pixels:
        a, r, g, b = p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255
        coded.append(a << 24 | (r - times(to_red, g) & 255) << 16 | g << 8 | (b - times(to_blue, g) - times(red_to_blue, r) & 255))
    stream = Stream().start(width, 4)
    stream.write(0b011, 3)
    stream.write(1, 3)  # tiles of 8 x 8
    stream.image([0xFF000000 | red_to_blue << 16 | to_blue << 8 | to_red])
    assert (webp.decode(end_of_transforms(stream).flat_codes().pixels(coded).file()) == rgba(pixels, width)).all()


@pytest.mark.parametrize("colours", [2, 3, 16, 20])
def test_palette(colours):
    width, height = 9, 3
    palette = some_pixels(colours, colours)
    index = np.random.default_rng(1).integers(0, colours, (height, width))
    steps = [palette[0]] + [sum(((y >> s) - (x >> s) & 255) << s for s in (0, 8, 16, 24)) for x, y in zip(palette, palette[1:])]
    bits = webp.palette_bits(colours)
    per, depth = 1 << bits, 8 >> bits
    packed = [sum(int(v) << (k * depth) for k, v in enumerate(row[x : x + per])) << 8 for row in index for x in range(0, width, per)]
    stream = Stream().start(width, height)
    stream.write(0b111, 3)
    stream.write(colours - 1, 8)
    stream.image(steps)
    got = webp.decode(end_of_transforms(stream).flat_codes().pixels(packed).file())
    assert (got == rgba([palette[i] for i in index.ravel()], width)).all()


def test_colour_cache_back_references_and_tiles():
    """Two groups of codes by tile, a cache of two bits, and a reference that reaches into itself."""
    width, height = 8, 4
    a, b = 0xFF112233, 0x80445566
    slot = lambda p: (0x1E35A7BD * p & 0xFFFFFFFF) >> 30
    assert slot(a) != slot(b)
    stream = Stream().start(width, height)
    stream.write(0, 1)
    stream.write(1, 1)
    stream.write(2, 4)  # cache of four colours
    stream.write(1, 1)  # several groups
    stream.write(0, 3)  # tiles of 4 x 4
    stream.image([0, 1 << 8])
    greens = np.zeros(256 + 24 + 4, np.int64)
    for s in (0x22, 0x55, 256 + 3, 280 + slot(a)):
        greens[s] = 2
    codes = webp.codes_of(greens)
    for _ in range(2):
        webp.write_code(stream, greens)
        for channel in (16, 0, 24):
            lengths = np.zeros(256, np.int64)
            lengths[a >> channel & 255] = lengths[b >> channel & 255] = 1
            webp.write_code(stream, lengths)
        one = np.zeros(40, np.int64)
        one[1] = 1  # distance code 2: the pixel to the left
        webp.write_code(stream, one)

    def green(symbol):
        stream.write(int(codes[symbol]), 2)

    def literal(p):
        green(p >> 8 & 255)
        for channel in (16, 0, 24):
            stream.write(int((p >> channel & 255) == max(a >> channel & 255, b >> channel & 255)), 1)

    want, literals = [], 0
    while len(want) < width * height:
        literal(a)
        literal(b)
        green(280 + slot(a))
        green(256 + 3)  # four more of the pixel before
        want += [a, b, a, a, a, a, a]
        literals += 1
        if len(want) + 7 > width * height:
            while len(want) < width * height:
                literal(b)
                want.append(b)
    assert (webp.decode(stream.file()) == rgba(want, width)).all()


def test_simple_codes_and_opaque_images():
    stream = Stream().start(3, 1, alpha=0)
    end_of_transforms(stream)
    stream.write(0b0_1_1_1, 4)  # green: simple, two symbols, the first of eight bits ...
    stream.value &= ~(1 << (stream.at - 1))
    stream.at -= 1
    stream.write(7, 8)
    stream.write(9, 8)
    for value in (1, 2, 3):
        stream.write(0b101, 3)
        stream.write(value, 8)
    stream.write(0b001, 3)  # distance: simple, one symbol of one bit
    stream.write(0, 1)
    stream.write(0b101, 3)
    assert webp.decode(stream.file())[0].tolist() == [[1, 9, 2, 255], [1, 7, 2, 255], [1, 9, 2, 255]]


@pytest.mark.parametrize("broken", [b"", b"RIFF", b"RIFF1234WEBPVP8 1234", b"RIFF1234WEBPVP8L\x05\0\0\0\x2f\0\0\0\xe0"])
def test_broken_files(broken):
    with pytest.raises((ValueError, struct.error)):
        webp.decode(broken)


def test_lengths_and_prefixes():
    for value in (1, 2, 4, 5, 6, 7, 100, 4095, 4096):
        prefix, extra, rest = webp.prefix_of(value)
        reader = webp.Reader((rest).to_bytes(4, "little"))
        assert reader.number(prefix) == value and reader.at == extra
    counts = np.array([2**k for k in range(20)] + [0])
    lengths = webp.code_lengths(counts, 8)
    assert lengths.max() <= 8 and sum(2.0**-x for x in lengths[:20]) == 1


def test_rows(make_docs, odd_rows):
    got = {str(r["doc_id"]) + r["payload_sha256"]: r for r in webp.digests(make_docs(odd_rows)).collect()}
    for i, text, _, _ in odd_rows:
        data = (text or "").encode()
        payload = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        r = got[str(i) + sha256(payload).hexdigest()]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(data), len(payload), crc32(payload[-32:]))
    media = {r["doc_id"]: r["media"] for r in webp.media_column(make_docs(odd_rows)).collect()}
    assert webp.read_back(media[9])[0].startswith(b"one\xff") and len(media[9]) == got["9" + sha256(webp.padded(b"one")).hexdigest()]["media_bytes"]
    assert got["6" + sha256(webp.padded(odd_rows[8][1].encode())).hexdigest()]["feature"] == got["7" + sha256(webp.padded(odd_rows[8][1].encode())).hexdigest()]["feature"]
    assert webp.digests(make_docs([])).collect() == []


def texts_by_way():
    """Texts of which each is smallest under another way of writing it."""
    rnd = np.random.default_rng(5)
    as_text = lambda pixels: np.array(pixels, np.uint8).tobytes().decode("ascii")
    green, noise = rnd.integers(40, 120, 3000), rnd.integers(40, 120, 3000)
    steps, rows = np.arange(3000), rnd.integers(40, 80, (1, 576)) + np.arange(30)[:, None]
    words = rnd.integers(97, 123, (600, 4))
    return {
        (webp.PREDICTION, 1): as_text(np.stack([40 + steps % 60, 41 + steps % 61, 50 + steps % 67, 60 + steps % 59], -1)),
        (webp.PREDICTION, 2): as_text(rows),
        (webp.CROSS_COLOUR, None): as_text(np.stack([30 + green // 2, green, 100 - green // 4, noise], -1)),
        (webp.SUBTRACT_GREEN, None): as_text(np.stack([green + 1, green, green + 2, noise], -1)),
        (webp.PALETTE, None): as_text(words[rnd.integers(0, 12, 2000)]),
        ("cache", None): as_text(words[rnd.integers(0, 600, 6000)]),
        (None, None): as_text(rnd.integers(97, 123, 3000)),
    }


def way_of(media):
    """Kind of the transform, and the mode of a prediction; whether there is a cache where there is no transform."""
    reader = webp.Reader(media[20:])
    reader.read(40)
    if not reader.read(1):
        return "cache" if reader.read(1) else None, None
    kind = reader.read(2)
    if kind > 1:
        return kind, None
    reader.read(3)
    return kind, int(reader.image(1, 1)[0]) >> 8 & 255 if kind == webp.PREDICTION else None


def test_each_transform_occurs_in_the_stored_files(make_docs):
    texts = texts_by_way()
    docs = make_docs([(k, t, "en", "s") for k, t in enumerate(texts.values())])
    media = {r["doc_id"]: bytes(r["media"]) for r in webp.media_column(docs).collect()}
    assert [way_of(media[k]) for k in range(len(texts))] == list(texts)
    got = {r["doc_id"]: r for r in webp.digests(docs).collect()}
    for k, t in enumerate(texts.values()):
        assert got[k]["payload_sha256"] == sha256(webp.padded(t.encode())).hexdigest() and got[k]["media_bytes"] == len(media[k])


@pytest.mark.parametrize("seed", range(6))
def test_cached_pixels_and_references_against_the_plain_loop(seed):
    """Both readers agree on caches of few places, whose entries are overwritten all the time."""
    rnd = np.random.default_rng(seed)
    samples = rnd.integers(0, 256, (40, 4)).astype(np.uint8)[rnd.integers(0, 40, (30, 50))]
    samples[20:] = samples[0, 0]
    out = webp.Writer()
    webp.CACHE_BITS, held = 1 + seed, webp.CACHE_BITS
    try:
        webp.write_image(out, samples[..., [1, 0, 2, 3]], True, True)
    finally:
        webp.CACHE_BITS = held
    data = out.value.to_bytes((out.at + 7) // 8, "little")
    fast = webp.Reader(data).image(50, 30, top=True)
    slow = webp.Reader(data)
    slow.plain_pixels = lambda *_: None
    assert (fast == slow.image(50, 30, top=True)).all()
    assert (np.stack(webp.split(fast), -1)[:, [1, 2, 3, 0]].reshape(30, 50, 4) == samples).all()


def test_a_cache_read_before_it_is_written_is_left_to_the_plain_loop():
    assert not webp.ColourCache(3).fill(np.array([5, 0]), np.array([-1, 4 if webp.cache_keys(np.array([5]), 3)[0] != 4 else 3]))


def test_payloads_beyond_the_largest_image_are_several_files():
    payload = webp.padded("".join(map(str, range(3000))).encode())
    media = webp.store(payload, 4 * webp.UNIT)
    back, images = webp.read_back(media)
    assert back == payload and len(images) == -(-len(payload) // (4 * webp.UNIT)) > 2
    assert webp.store(payload) == webp.store(payload, len(payload))
