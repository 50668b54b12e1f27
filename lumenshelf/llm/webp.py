"""Lossless WebP for media columns: a decoder of the whole format, and an encoder that chooses transforms and
colour cache by size, file by file."""

from __future__ import annotations

import struct
from functools import lru_cache
from hashlib import sha256
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame

from lumenshelf.llm.common import map_rows

# Fixed values of the format: order of code length codes, and the neighbours (dx, dy) that the first
# 120 distance codes stand for.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEIGHBOURS = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
LITERALS, LENGTHS, DISTANCES, MAX_CODE = 256, 24, 40, 15
SIDE = 1 << 14  # greatest width and height


@lru_cache(maxsize=MAX_CODE + 1)
def reversed_bits(width: int) -> np.ndarray:
    """For each number of ``width`` bits, that with its bits in reverse order."""
    out = np.zeros(1, np.int64)
    for _ in range(width):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


class PrefixCode:
    """Decoding table of a canonical prefix code, indexed by the next ``bits`` bits of the stream."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) <= 1:  # a lone symbol takes no bits
            self.bits, self.symbol, self.length = 0, np.array([used[0] if len(used) else 0], np.int64), np.zeros(1, np.int64)
        else:
            order = used[np.lexsort((used, lengths[used]))]
            each = lengths[order]
            self.bits = int(each[-1])
            spans = 1 << (self.bits - each)
            if spans.sum() != 1 << self.bits:
                raise ValueError("prefix code is not complete")
            back = reversed_bits(self.bits)
            self.symbol, self.length = np.repeat(order, spans)[back], np.repeat(each, spans)[back]
        self.greatest = int(used[-1]) if len(used) else 0


class Reader:
    """Bits of a byte string, least significant first; beyond its end they read as zero."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.codes: dict[int, tuple[int, int, PrefixCode]] = {}

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return int.from_bytes(self.data[byte : byte + (n >> 3) + 2], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        return value

    def symbol(self, code: PrefixCode) -> int:
        if not code.bits:
            return int(code.symbol[0])
        value = self.peek(code.bits)
        self.at += int(code.length[value])
        return int(code.symbol[value])

    def code(self, size: int) -> PrefixCode:
        """The next prefix code of an alphabet; one written like the last of its size is not built again."""
        if (last := self.codes.get(size)) and self.peek(last[0]) == last[1]:
            self.at += last[0]
            return last[2]
        start = self.at
        code = PrefixCode(self.lengths(size))
        bits, self.at = self.at - start, start
        self.codes[size] = (bits, self.read(bits), code)
        return code

    def lengths(self, size: int) -> np.ndarray:
        lengths = np.zeros(max(size, LITERALS), np.int64)
        if self.read(1):  # one or two symbols written out
            two = self.read(1)
            lengths[self.read(8 if self.read(1) else 1)] = 1
            if two:
                lengths[self.read(8)] = 1
            return lengths[:size] if not lengths[size:].any() else fail("symbol outside of its alphabet")
        first = np.zeros(19, np.int64)
        for k in LENGTH_ORDER[: 4 + self.read(4)]:
            first[k] = self.read(3)
        table = PrefixCode(first)
        left = 2 + self.read(2 + 2 * self.read(3)) if self.read(1) else size
        # A symbol and its extra bits take 14 bits at most: the whole list is looked at as one number.
        window, spent, mask = self.peek(14 * size), 0, (1 << table.bits) - 1
        symbols, widths = table.symbol.tolist(), table.length.tolist()
        at, previous = 0, 8
        while at < size and left:
            left -= 1
            k = window >> spent & mask
            symbol = symbols[k]
            spent += widths[k]
            if symbol < 16:
                if symbol:
                    lengths[at] = previous = symbol
                at += 1
                continue
            value, extra, least = ((previous, 2, 3), (0, 3, 3), (0, 7, 11))[symbol - 16]
            n = least + (window >> spent & ((1 << extra) - 1))
            spent += extra
            if at + n > size:
                fail("code lengths run over")
            if value:
                lengths[at : at + n] = value
            at += n
        self.at += spent
        return lengths[:size]

    def number(self, prefix: int) -> int:
        """A length or distance from its prefix symbol and the extra bits that follow."""
        if prefix < 4:
            return prefix + 1
        extra = (prefix - 2) >> 1
        return ((2 + (prefix & 1)) << extra) + self.read(extra) + 1

    def image(self, width: int, height: int, top: bool = False) -> np.ndarray:
        """An entropy-coded image as ARGB numbers; the top one may have several groups of codes."""
        cache_bits = self.read(4) if self.read(1) else 0
        groups, tile_bits, per_tile = 1, 0, None
        if top and self.read(1):
            tile_bits = self.read(3) + 2
            per_tile = (self.image(-(-width >> tile_bits), -(-height >> tile_bits)) >> 8) & 0xFFFF
            groups = int(per_tile.max()) + 1
        sizes = (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), LITERALS, LITERALS, LITERALS, DISTANCES)
        codes = [[self.code(size) for size in sizes] for _ in range(groups)]
        if groups == 1:
            start = self.at
            found = self.plain_pixels(width, height, codes[0], cache_bits)
            if found is not None:
                return found
            self.at = start
        return self.pixels(width, height, codes, cache_bits, tile_bits, per_tile)

    def distance(self, width: int, code: PrefixCode) -> int:
        value = self.number(self.symbol(code))
        if value > len(NEIGHBOURS):
            return value - len(NEIGHBOURS)
        dx, dy = NEIGHBOURS[value - 1]
        return max(1, dx + dy * width)

    def copy(self, out: np.ndarray, at: int, prefix: int, width: int, code: PrefixCode) -> int:
        """Carry out a back-reference; the place after it."""
        n = self.number(prefix)
        distance = self.distance(width, code)
        if distance > at or at + n > len(out):
            fail("back-reference outside of the image")
        for start in range(at, at + n, distance):  # a reference may reach into what it writes
            end = min(start + distance, at + n)
            out[start:end] = out[start - distance : end - distance]
        return at + n

    def pixels(self, width, height, codes, cache_bits, tile_bits, per_tile) -> np.ndarray:
        """Symbol by symbol: literals, back-references and colour cache, with codes by tile."""
        out = np.zeros(width * height, np.int64)
        cache, cached, at = [0] * (1 << cache_bits), 0, 0
        tiles = -(-width >> tile_bits) if per_tile is not None else 0
        while at < len(out):
            group = codes[int(per_tile[(at // width >> tile_bits) * tiles + (at % width >> tile_bits)]) if tiles else 0]
            green = self.symbol(group[0])
            if green < LITERALS:
                red, blue, alpha = (self.symbol(code) for code in group[1:4])
                out[at] = alpha << 24 | red << 16 | green << 8 | blue
                at += 1
            elif green < LITERALS + LENGTHS:
                at = self.copy(out, at, green - LITERALS, width, group[4])
            else:
                out[at] = cache[green - LITERALS - LENGTHS]
                at += 1
            if cache_bits:
                for argb in out[cached:at].tolist():
                    cache[(0x1E35A7BD * argb & 0xFFFFFFFF) >> (32 - cache_bits)] = argb
                cached = at
        return out

    def plain_pixels(self, width: int, height: int, codes: list[PrefixCode], cache_bits: int = 0) -> np.ndarray | None:
        """With one group of codes: where a pixel would end if it began at each bit is looked up for all
        bits at once, and the pixels are those on the chain from the first bit. None if a pixel is read
        from the colour cache before any pixel was put there, which only ``pixels`` follows exactly."""
        n = width * height
        out, at = np.zeros(n, np.int64), 0
        green, red, blue, alpha, distances = codes
        cache = ColourCache(cache_bits) if cache_bits else None
        if not any(c.bits for c in codes[:4]):
            if green.symbol[0] >= LITERALS:
                return None if cache else fail("back-reference outside of the image")
            out[:] = alpha.symbol[0] << 24 | red.symbol[0] << 16 | green.symbol[0] << 8 | blue.symbol[0]
            return out
        while at < n:
            first = self.at
            limit = min(1 << 17, max(1, 8 * len(self.data) - first))
            size = (limit >> 3) + 16  # bytes looked at: a whole pixel must fit behind the last bit
            octets = np.frombuffer(self.data[first >> 3 : (first >> 3) + size].ljust(size, b"\0"), np.uint8).astype(np.int64)
            window = octets[:-2] | octets[1:-1] << 8 | octets[2:] << 16
            window = (window[:, None] >> np.arange(8)).ravel()[first & 7 :]
            place = np.arange(len(window))
            steps = {id(c): place + c.length[window & ((1 << c.bits) - 1)] if c.bits else place for c in codes[:4]}
            # Where each channel's symbol begins, and where the pixel ends, if green begins at each bit.
            red_at = steps[id(green)][:limit]
            blue_at = steps[id(red)][red_at]
            alpha_at = steps[id(blue)][blue_at]
            ends = steps[id(alpha)][alpha_at]
            if cache and green.greatest >= LITERALS + LENGTHS:  # a cached pixel ends with its symbol
                ends = np.where(green.symbol[window[:limit] & ((1 << green.bits) - 1)] >= LITERALS + LENGTHS, red_at, ends)
            chain, spot, following, room = [], 0, memoryview(ends), n - at
            append = chain.append
            while room and spot < limit:
                append(spot)
                spot = following[spot]
                room -= 1
            starts = np.array(chain, np.int64)
            look = lambda code, where: code.symbol[window[where] & ((1 << code.bits) - 1)]
            greens = look(green, starts)
            # The chain holds up to its first back-reference.
            references = np.flatnonzero((greens >= LITERALS) & (greens < LITERALS + LENGTHS)) if green.greatest >= LITERALS else ()
            if len(references):
                spot = chain[references[0]]
                starts, greens = starts[: references[0]], greens[: references[0]]
            argb = look(alpha, alpha_at[starts]) << 24 | look(red, red_at[starts]) << 16 | greens << 8 | look(blue, blue_at[starts])
            if cache and len(starts) and not cache.fill(argb, greens - (LITERALS + LENGTHS)):
                return None
            out[at : at + len(starts)] = argb
            at, self.at = at + len(starts), first + spot
            if len(references):
                before = at
                at = self.copy(out, at, self.symbol(green) - LITERALS, width, distances)
                if cache:
                    cache.put(out[before:at])
            elif not len(starts):
                fail("the stream ends early")
        return out


def cache_keys(argb: np.ndarray, bits: int) -> np.ndarray:
    """Places of pixels in a colour cache."""
    return (argb.astype(np.uint32) * np.uint32(0x1E35A7BD) >> np.uint32(32 - bits)).astype(np.int64)


class ColourCache:
    """The last pixel of each hash, read and written for many pixels at once."""

    def __init__(self, bits: int):
        self.bits, self.held, self.known = bits, np.zeros(1 << bits, np.int64), np.zeros(1 << bits, bool)

    def put(self, argb: np.ndarray) -> None:
        keys = cache_keys(argb, self.bits)
        self.held[keys] = argb  # of pixels with one key the last is kept
        self.known[keys] = True

    def fill(self, argb: np.ndarray, places: np.ndarray) -> bool:
        """Replace pixels with a place (0 or more) by what the cache holds there at that moment. All others
        are put into it on the way. False if a place is read that nothing was put in."""
        cached = places >= 0
        keys = np.where(cached, places, cache_keys(argb, self.bits))
        if cached.any():
            # In order of key and time, a cached pixel equals the last one of its key that is not.
            order = np.argsort(keys.astype(np.uint16), kind="stable")
            sorted_keys, n = keys[order], np.arange(len(order))
            last = np.maximum.accumulate(np.where(cached[order], -1, n))
            heads = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1]))
            here = last >= np.repeat(heads, np.diff(np.append(heads, len(order))))
            if not (here | self.known[sorted_keys]).all():
                return False
            argb[order] = np.where(here, argb[order[np.maximum(last, 0)]], self.held[sorted_keys])
        self.held[keys] = argb
        self.known[keys] = True
        return True


def fail(what: str):
    raise ValueError(f"not a lossless WebP stream: {what}")


def split(argb: np.ndarray) -> list[np.ndarray]:
    return [argb >> s & 255 for s in (24, 16, 8, 0)]


def join(a, r, g, b) -> np.ndarray:
    return (a & 255) << 24 | (r & 255) << 16 | (g & 255) << 8 | b & 255


def add(x: int, y: int) -> int:
    """Sum of two pixels, channel by channel."""
    return (x & 0xFF00FF00) + (y & 0xFF00FF00) & 0xFF00FF00 | (x & 0x00FF00FF) + (y & 0x00FF00FF) & 0x00FF00FF


def mean(x: int, y: int) -> int:
    return ((x ^ y) & 0xFEFEFEFE) // 2 + (x & y)


def channels(x: int) -> tuple[int, int, int, int]:
    return x >> 24, x >> 16 & 255, x >> 8 & 255, x & 255


def clamp(v: int) -> int:
    return 0 if v < 0 else 255 if v > 255 else v


def pack(values) -> int:
    a, r, g, b = values
    return a << 24 | r << 16 | g << 8 | b


def select(left: int, top: int, corner: int) -> int:
    to_left = to_top = 0
    for p, q, c in zip(channels(left), channels(top), channels(corner)):
        to_left += abs(q - c)  # the estimate left + top - corner, less left
        to_top += abs(p - c)
    return left if to_left < to_top else top


def full_gradient(left: int, top: int, corner: int) -> int:
    return pack(clamp(p + q - c) for p, q, c in zip(channels(left), channels(top), channels(corner)))


def half_gradient(left: int, top: int, corner: int) -> int:
    return pack(clamp(m + int((m - c) / 2)) for m, c in zip(channels(mean(left, top)), channels(corner)))


#: Predictors by mode, from the left, top, top right and top left pixels.
PREDICTORS = (
    lambda l, t, tr, tl: 0xFF000000,
    lambda l, t, tr, tl: l,
    lambda l, t, tr, tl: t,
    lambda l, t, tr, tl: tr,
    lambda l, t, tr, tl: tl,
    lambda l, t, tr, tl: mean(mean(l, tr), t),
    lambda l, t, tr, tl: mean(l, tl),
    lambda l, t, tr, tl: mean(l, t),
    lambda l, t, tr, tl: mean(tl, t),
    lambda l, t, tr, tl: mean(t, tr),
    lambda l, t, tr, tl: mean(mean(l, tl), mean(t, tr)),
    lambda l, t, tr, tl: select(l, t, tl),
    lambda l, t, tr, tl: full_gradient(l, t, tl),
    lambda l, t, tr, tl: half_gradient(l, t, tl),
)


LEFT, TOP = 1, 2


def predicted(out: list[int], at: int, width: int, mode: int) -> int:
    """The prediction for a pixel from those before it."""
    x, y = at % width, at // width
    if not y:
        return out[at - 1] if x else 0xFF000000
    if not x:
        return out[at - width]
    # Right of the last column stands the first pixel of the row itself.
    return PREDICTORS[mode](out[at - 1], out[at - width], out[at - width + 1], out[at - width - 1])


def undo_prediction(argb: np.ndarray, width: int, bits: int, modes: np.ndarray) -> np.ndarray:
    tiles = -(-width >> bits)
    mode = (modes >> 8 & 15).tolist()
    if set(mode) in ({LEFT}, {TOP}):  # sums along rows or columns
        rest = np.stack(split(argb), -1).astype(np.uint8).reshape(-1, width, 4)
        rest[0, 0, :1] += 255  # the first pixel's prediction is opaque black
        if mode[0] == LEFT:
            rest[:, 0] = np.cumsum(rest[:, 0], axis=0, dtype=np.uint8)
        else:
            rest[0] = np.cumsum(rest[0], axis=0, dtype=np.uint8)
        return join(*np.moveaxis(np.cumsum(rest, axis=1 if mode[0] == LEFT else 0, dtype=np.uint8).astype(np.int64).reshape(-1, 4), 1, 0))
    out: list[int] = []
    for at, rest in enumerate(argb.tolist()):
        m = mode[(at // width >> bits) * tiles + (at % width >> bits)]
        out.append(add(rest, predicted(out, at, width, min(m, 13) if m < 14 else 0)))
    return np.array(out, np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return x - (x >= 128) * 256


def tile_values(values: np.ndarray, width: int, n: int, bits: int) -> np.ndarray:
    """The value of its tile for each pixel."""
    at = np.arange(n)
    return values[(at // width >> bits) * (-(-width >> bits)) + (at % width >> bits)]


def undo_cross_colour(argb: np.ndarray, width: int, bits: int, factors: np.ndarray) -> np.ndarray:
    _, red_to_blue, green_to_blue, green_to_red = split(tile_values(factors, width, len(argb), bits))
    a, r, g, b = split(argb)
    times = lambda t, c: signed(t) * signed(c) >> 5
    r = (r + times(green_to_red, g)) & 255
    return join(a, r, g, b + times(green_to_blue, g) + times(red_to_blue, r))


def undo_subtract_green(argb: np.ndarray) -> np.ndarray:
    a, r, g, b = split(argb)
    return join(a, r + g, g, b + g)


def palette_bits(colours: int) -> int:
    """How many pixels one index byte holds, as a power of two."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def undo_palette(argb: np.ndarray, width: int, bits: int, palette: np.ndarray) -> np.ndarray:
    packed = (argb >> 8 & 255).reshape(-1, -(-width >> bits))
    depth = 8 >> bits
    index = (packed[:, :, None] >> np.arange(0, 8, depth) & ((1 << depth) - 1)).reshape(len(packed), -1)[:, :width]
    colours = np.concatenate([palette, np.zeros(256, np.int64)])  # indices beyond the palette are transparent black
    return colours[index.ravel()]


def decode(data: bytes) -> np.ndarray:
    """A lossless WebP file as an array of height x width x (R, G, B, A) samples."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        fail("no header")
    at = 12
    while data[at : at + 4] != b"VP8L":
        at += 8 + (struct.unpack_from("<I", data, at + 4)[0] + 1 & ~1) if at + 8 <= len(data) else fail("no image chunk")
    size = struct.unpack_from("<I", data, at + 4)[0]
    reader = Reader(data[at + 8 : at + 8 + size])
    if reader.read(8) != 0x2F:
        fail("no signature")
    width, height = reader.read(14) + 1, reader.read(14) + 1
    has_alpha = reader.read(1)
    if reader.read(3):
        fail("unknown version")
    undo, wide = [], width
    while reader.read(1):
        kind = reader.read(2)
        if kind < 2:
            bits = reader.read(3) + 2
            tiles = reader.image(-(-wide >> bits), -(-height >> bits))
            undo.append((undo_prediction if kind == 0 else undo_cross_colour, wide, bits, tiles))
        elif kind == 2:
            undo.append((lambda argb, *_: undo_subtract_green(argb), wide, 0, None))
        else:
            steps = reader.image(reader.read(8) + 1, 1)
            palette = join(*[np.cumsum(c) for c in split(steps)])
            bits = palette_bits(len(palette))
            undo.append((undo_palette, wide, bits, palette))
            wide = -(-wide >> bits)
    argb = reader.image(wide, height, top=True)
    for step, at_width, bits, values in reversed(undo):
        argb = step(argb, at_width, bits, values)
    a, r, g, b = split(argb)
    return np.stack([r, g, b, a if has_alpha else np.full_like(a, 255)], axis=-1).astype(np.uint8).reshape(height, width, 4)


class Writer:
    """Bits, least significant first."""

    def __init__(self):
        self.value, self.at = 0, 0

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.at
        self.at += n


def code_lengths(counts: np.ndarray, greatest: int = 12) -> np.ndarray:
    """Huffman code lengths of the counted symbols, none above ``greatest``."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    while True:
        order = used[np.argsort(counts[used], kind="stable")]
        weights = counts[order].tolist()
        n = len(weights)
        parent, joined, leaf, node = [0] * (2 * n - 1), [], 0, 0
        for k in range(n, 2 * n - 1):  # the two lightest of leaves and joined nodes, both in order
            total = 0
            for _ in range(2):
                if node >= len(joined) or leaf < n and weights[leaf] <= joined[node]:
                    total += weights[leaf]
                    parent[leaf] = k
                    leaf += 1
                else:
                    total += joined[node]
                    parent[n + node] = k
                    node += 1
            joined.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= greatest:
            lengths[order] = depth[:n]
            return lengths
        counts = (counts + 1) // 2  # flatter counts make shallower trees


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes with their bits in stream order."""
    used = np.flatnonzero(lengths)
    codes = np.zeros(len(lengths), np.int64)
    if len(used) > 1:
        order = used[np.lexsort((used, lengths[used]))]
        widest = int(lengths[order[-1]])
        spans = 1 << (widest - lengths[order])
        starts = np.cumsum(spans) - spans
        codes[order] = reversed_bits(widest)[starts]
    return codes


#: Lengths of the code length code that ``write_code`` uses: a complete code for all 19 symbols.
PLAIN_LENGTHS = np.array([4] * 13 + [5] * 6)
PLAIN_TOKENS = (codes_of(PLAIN_LENGTHS) | PLAIN_LENGTHS << 16).tolist()


@lru_cache(maxsize=1)
def plain_head() -> tuple[int, int]:
    """What precedes the code lengths: not a simple code, all 19 lengths of their own code, all symbols follow."""
    out = Writer()
    out.write(0, 1)
    out.write(15, 4)
    for k in LENGTH_ORDER:
        out.write(int(PLAIN_LENGTHS[k]), 3)
    out.write(0, 1)
    return out.value, out.at


def write_code(out: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 1 and (not used or used[0] < LITERALS):
        out.write(0b101, 3)  # simple, one symbol, of eight bits
        out.write(used[0] if used else 0, 8)
        return
    out.write(*plain_head())
    # Tokens and their extra bits, as value and bits in one number: the gap ahead of each run of used symbols, then the run.
    parts: list[int] = []
    each, some = lengths.tolist(), np.zeros(len(lengths) + 2, bool)
    some[1:-1] = lengths
    edges = np.flatnonzero(some[1:] != some[:-1]).tolist() + [len(each)] * 2
    at = 0
    for first, after in zip(edges[::2], edges[1::2]):
        while (gap := first - at) > 0:
            if gap < 3:
                parts.append(PLAIN_TOKENS[0])
                at += 1
            elif gap < 11:
                parts += (PLAIN_TOKENS[17], gap - 3 | 3 << 16)
                at = first
            else:
                run = min(gap, 138)
                parts += (PLAIN_TOKENS[18], run - 11 | 7 << 16)
                at += run
        parts += map(PLAIN_TOKENS.__getitem__, each[first:after])
        at = after
    values = np.array(parts, np.int64)
    out.write(*pack_bits(values & 0xFFFF, values >> 16))


def prefix_of(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and their value of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    value -= 1
    extra = value.bit_length() - 2
    return 2 * extra + 2 + (value >> extra & 1), extra, value & ((1 << extra) - 1)


def pack_bits(codes: np.ndarray, lengths: np.ndarray) -> tuple[int, int]:
    """Codes one after the other as a number, and its bits."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    word, shift = starts >> 5, starts & 31
    values = codes << shift  # a code of 15 bits at most, in a 32-bit word and the next
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words = np.zeros(int(word[-1]) + 2, np.int64)
    at = word[first]
    words[at] = np.add.reduceat(values & 0xFFFFFFFF, first)
    words[at + 1] += np.add.reduceat(values >> 32, first)
    return int.from_bytes(words.astype("<u4").tobytes(), "little"), int(ends[-1])


PREDICTION, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)  # fixed values: kinds of transforms
#: Bits of the tile sides that one mode or one set of factors serves: the largest.
TILE_BITS = 9
#: Most bits of a colour cache, the share of an image's bits that it must save to be worth reading, and
#: what a symbol's code costs in the file, about, in bits.
CACHE_BITS, CACHE_SHARE, SYMBOL_COST = 10, 1 / 12, 5
SAMPLED_ROWS = 4


def lag(planes: np.ndarray, mode: int) -> np.ndarray:
    """height x width x (G, R, B, A) less the pixel to the left or above, as the predictors take them."""
    out = planes.copy()
    out[:, 1:] -= planes[:, :-1]
    out[1:, 0] -= planes[:-1, 0]
    if mode == TOP:
        out[1:] = planes[1:] - planes[:-1]
    out[0, 0, 3:] -= 255
    return out


def cross_factors(flat: np.ndarray) -> tuple[int, int]:
    """Factors, in 32nds, of green for red and blue, of rows (G, R, B, A): least squares about the means."""
    values = flat[:, :3].view(np.int8).astype(np.float64)
    sums = values.sum(axis=0)
    weight, red, blue = ((values[:, :1] * values).sum(axis=0) - sums[0] * sums / len(flat)).tolist()
    return tuple(max(-128, min(127, round(32 * x / weight))) for x in (red, blue)) if weight > 0 else (0, 0)


def cross_coloured(planes: np.ndarray, to_red: int, to_blue: int) -> np.ndarray:
    green = signed(planes[..., 0].astype(np.int64))
    out = planes.copy()
    out[..., 1] -= (to_red * green >> 5).astype(np.uint8)
    out[..., 2] -= (to_blue * green >> 5).astype(np.uint8)
    return out


def entropy_bits(counts: np.ndarray) -> np.ndarray:
    """Bits, about, of symbols with these counts (last axis) under a Huffman code, and of the code."""
    total = counts.sum(axis=-1)
    return total * np.log2(np.maximum(total, 1)) - (counts * np.log2(np.maximum(counts, 1)) - SYMBOL_COST * (counts > 0)).sum(axis=-1)


def distinct(flat: np.ndarray) -> int:
    """How many of the rows of four bytes differ."""
    values = np.sort(np.ascontiguousarray(flat).view("<u4").ravel())
    return 1 + int(np.count_nonzero(values[1:] != values[:-1]))


def transformed_costs(planes: np.ndarray, factors: tuple[int, int]) -> np.ndarray:
    """Bits, about, of an image as it is, with green subtracted, less the left and the upper pixels (all
    by plain offsets, whatever the borders) and cross-coloured. The transforms' own images cost about 60.
    Of a tall image the first SAMPLED_ROWS rows are judged: the choice decides on size, never on content."""
    width, flat = planes.shape[1], planes[:SAMPLED_ROWS].reshape(-1, 4)
    stack = np.repeat(flat[None], 5, axis=0)
    stack[1, :, 1:3] -= flat[:, :1]
    stack[2, 1:] -= flat[:-1]
    stack[3, width:] -= flat[:-width]
    stack[4, :, 1:3] -= (flat[:, :1].view(np.int8) * np.array(factors, np.int16) >> 5).astype(np.uint8)
    return plane_costs(stack) + np.array([0, 0, 60, 60, 60])


def plane_costs(stack: np.ndarray) -> np.ndarray:
    """Bits, about, of each of the stacked images of rows (G, R, B, A): green has a code of its own."""
    offsets = np.arange(0, 512 * len(stack), 512, dtype=np.int64)[:, None, None] + np.array([0, 256, 256, 256])
    return entropy_bits(np.bincount((stack + offsets).ravel(), minlength=512 * len(stack)).reshape(-1, 2, 256)).sum(axis=1)


def best_cache(flat: np.ndarray) -> tuple[int, np.ndarray | None, np.ndarray | None]:
    """Bits of the colour cache that makes the image smaller (0: none), the pixels to be read from it, their places."""
    n = len(flat)
    bits = min(CACHE_BITS, n.bit_length() - 3)
    # What recurs bounds what a cache can serve, and a pixel from it saves a third of its bits, about.
    if bits < 1 or n - distinct(flat) < 3 * CACHE_SHARE * n:
        return 0, None, None
    argb = np.ascontiguousarray(flat[:, [2, 0, 1, 3]]).view("<u4").ravel()
    keys = cache_keys(argb, bits)
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    hits = np.zeros(n, bool)
    hits[order[1:]] = (keys[order[1:]] == keys[order[:-1]]) & (argb[order[1:]] == argb[order[:-1]])
    places = np.bincount(keys[hits], minlength=1 << bits)
    before = plane_costs(flat[None])[0]
    fewer = flat[~hits]
    after = entropy_bits(np.concatenate([np.bincount(fewer[:, 0], minlength=256), places])) + entropy_bits(np.bincount(fewer[:, 1:].ravel(), minlength=256))
    return (bits, hits, keys) if after < (1 - CACHE_SHARE) * before else (0, None, None)


def write_image(out: Writer, planes: np.ndarray, top: bool, cached: bool = False) -> None:
    """An entropy-coded image of height x width x (G, R, B, A): literals and cached pixels under Huffman
    codes, the run of equal pixels at the end as back-references."""
    flat = planes.reshape(-1, 4)
    n = len(flat)
    other = np.flatnonzero((flat != flat[-1]).any(axis=1))
    literals = min(n, int(other[-1]) + 2 if len(other) else 1)
    left, runs = n - literals, []
    while left:
        runs.append(prefix_of(min(left, 4096)))
        left -= min(left, 4096)
    flat = flat[:literals]
    bits, hits, keys = best_cache(flat) if cached else (0, None, None)
    written = flat[~hits] if bits else flat
    shared = np.bincount(written[:, 1:].ravel(), minlength=LITERALS)
    green = np.bincount(written[:, 0], minlength=LITERALS + LENGTHS + (1 << bits if bits else 0))
    if bits:
        green += np.bincount(keys[hits] + LITERALS + LENGTHS, minlength=len(green))
    for prefix, _, _ in runs:
        green[LITERALS + prefix] += 1
    green_lengths, lengths = code_lengths(green), code_lengths(shared)
    out.write(1 if bits else 0, 1)
    if bits:
        out.write(bits, 4)
    if top:
        out.write(0, 1)  # one group of codes
    write_code(out, green_lengths)
    once = Writer()
    write_code(once, lengths)
    for _ in range(3):
        out.write(once.value, once.at)
    out.write(*left_distance())
    green_codes, codes = codes_of(green_lengths), codes_of(lengths)
    if np.count_nonzero(green_lengths) == 1:
        green_lengths = np.zeros_like(green_lengths)
    if np.count_nonzero(lengths) == 1:
        lengths = np.zeros_like(lengths)
    all_codes, all_lengths = codes[flat], lengths[flat]
    symbols = np.where(hits, keys + LITERALS + LENGTHS, flat[:, 0]) if bits else flat[:, 0]
    all_codes[:, 0], all_lengths[:, 0] = green_codes[symbols], green_lengths[symbols]
    if bits:
        all_codes[hits, 1:], all_lengths[hits, 1:] = 0, 0
    value, size = pack_bits(all_codes.ravel(), all_lengths.ravel())
    out.write(value, size)
    for prefix, extra, rest in runs:
        out.write(int(green_codes[LITERALS + prefix]), int(green_lengths[LITERALS + prefix]))
        out.write(rest, extra)


@lru_cache(maxsize=1)
def left_distance() -> tuple[int, int]:
    """The written code of distances whose only symbol is distance code 2: the pixel to the left."""
    out, lengths = Writer(), np.zeros(DISTANCES, np.int64)
    lengths[prefix_of(2)[0]] = 1
    write_code(out, lengths)
    return out.value, out.at


def argb_planes(argb: np.ndarray) -> np.ndarray:
    """1 x n x (G, R, B, A) of ARGB numbers."""
    a, r, g, b = split(argb)
    return np.stack([g, r, b, a], -1).astype(np.uint8)[None]


def palette_of(planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The colours of an image that has 256 or fewer, as coded steps, and the image of indices, in green."""
    height, width, _ = planes.shape
    argb = np.ascontiguousarray(planes[..., [2, 0, 1, 3]]).view("<u4").reshape(-1)
    colours, index = np.unique(argb, return_inverse=True)
    steps = argb_planes(colours.astype(np.int64))
    steps[:, 1:] -= steps[:, :-1].copy()
    bits = palette_bits(len(colours))
    each = 1 << bits
    rows = np.zeros((height, -(-width // each) * each), np.int64)
    rows[:, :width] = index.reshape(height, width)
    packed = (rows.reshape(height, -1, each) << np.arange(0, 8, 8 >> bits)[:each]).sum(axis=-1)
    found = np.full((*packed.shape, 4), (0, 0, 0, 255), np.uint8)
    found[..., 0] = packed
    return steps, found


def encode(samples: np.ndarray) -> bytes:
    """A lossless WebP file of height x width x (R, G, B, A) samples.

    Of no transform, green subtracted, prediction from the left or from above, cross-colour and, if the
    colours are few, a palette, the one with the least entropy is used; then the colour cache where it
    saves a good part of the bits.
    """
    height, width, _ = samples.shape
    planes = samples[..., [1, 0, 2, 3]]
    factors = cross_factors(planes[:SAMPLED_ROWS].reshape(-1, 4))
    costs = transformed_costs(planes, factors)
    way = (None, SUBTRACT_GREEN, (PREDICTION, LEFT), (PREDICTION, TOP), CROSS_COLOUR)[int(costs.argmin())]
    # With few colours that recur, the pixels' places in a palette may be smaller.
    if 2 * (colours := distinct(samples.reshape(-1, 4))) <= height * width and colours <= 256:
        palette = palette_of(planes)
        if sum(float(plane_costs(x.reshape(1, -1, 4))[0]) for x in palette) < costs.min() * max(1, height / SAMPLED_ROWS):
            way = PALETTE
    image = planes
    if way == PALETTE:
        image = palette[1]
    elif isinstance(way, tuple):
        image = lag(planes, way[1])
    elif way is not None:
        image = cross_coloured(planes, *((32, 32) if way == SUBTRACT_GREEN else factors))

    out = Writer()
    for value, bits in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.write(value, bits)
    if way is not None:
        kind = way[0] if isinstance(way, tuple) else way
        out.write(1, 1)
        out.write(kind, 2)
        if kind == PALETTE:
            out.write(palette[0].shape[1] - 1, 8)
            write_image(out, palette[0], False)
        elif kind != SUBTRACT_GREEN:
            value = way[1] << 8 if kind == PREDICTION else (factors[1] & 255) << 8 | factors[0] & 255
            out.write(TILE_BITS - 2, 3)
            write_image(out, argb_planes(np.full((-(-height >> TILE_BITS)) * (-(-width >> TILE_BITS)), 255 << 24 | value, np.int64)), False)
    out.write(0, 1)
    write_image(out, image, True, way != PALETTE)
    data = out.value.to_bytes((out.at + 7) // 8, "little")
    chunk = b"VP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


UNIT, FILL = 576, b"\xff"
#: Bytes of the largest image whose rows are whole units.
LARGEST = 4 * SIDE // UNIT * UNIT * SIDE


def padded(data: bytes) -> bytes:
    """data followed by bytes 255 up to a positive multiple of UNIT."""
    return data + FILL * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def store(payload: bytes, most: int = LARGEST) -> bytes:
    """A payload as an image of 144 pixels or a multiple in width, rows below it filled with 255. A payload
    of over ``most`` bytes, the largest image, is stored as several files, one after the other."""
    files = []
    for at in range(0, len(payload), most):
        part = payload[at : at + most]
        row = UNIT * min(-(-len(part) // (UNIT * SIDE)), 4 * SIDE // UNIT)
        height = -(-len(part) // row)
        files.append(encode(np.frombuffer(part + FILL * (height * row - len(part)), np.uint8).reshape(height, row // 4, 4)))
    return b"".join(files)


def features(samples: np.ndarray) -> str:
    """Width, height, channel means and a 64-bit brightness hash of an image, all from whole numbers."""
    height, width, _ = samples.shape
    sums = samples.reshape(-1, 4).sum(axis=0, dtype=np.int64)
    light = samples[:, :, :3].sum(axis=2, dtype=np.int64).ravel()
    edges = np.arange(8 * 9 + 1) * len(light) // 72
    total = np.concatenate([[0], np.cumsum(light)])
    cells = ((total[edges[1:]] - total[edges[:-1]]) * 1000 // np.maximum(1, np.diff(edges))).reshape(8, 9)
    bits = np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()
    return f"{width}x{height}:{','.join(str(x) for x in (sums * 100 // (width * height)).tolist())}:{bits}"


def read_back(media: bytes) -> tuple[bytes, list[np.ndarray]]:
    """The payload of stored images, and their samples. UTF-8 has no byte 255, so the fill tells itself."""
    images, at = [], 0
    while at < len(media):
        size = 8 + struct.unpack_from("<I", media, at + 4)[0]
        images.append(decode(media[at : at + size]))
        at += size
    return padded(b"".join(i.tobytes().rstrip(FILL) for i in images)), images


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a stored image: id, media (WebP bytes). Null counts as empty; repeats stay."""
    return map_rows(docs, lambda: lambda doc, text: (doc, store(padded((text or "").encode()))), f"{id_col} long, media binary", [id_col, text_col])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each whole text as lossless WebP, decode the stored bytes and describe both.

    One row per row, repeats included; equal texts have equal values. Null texts count as empty, and an
    empty text is one unit of bytes 255. The features of a text stored as several images are joined by ``|``.
    """

    def start():
        def one(doc, text):
            data = (text or "").encode()
            media = store(padded(data))
            payload, images = read_back(media)
            return doc, len(data), len(payload), sha256(payload).hexdigest(), crc32(payload[-32:]), len(media), sha256(media).hexdigest(), "|".join(map(features, images))

        return one

    return map_rows(docs, start, f"{id_col} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", [id_col, text_col])
