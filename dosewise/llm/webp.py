"""Lossless WebP: a decoder for all of the format, an encoder for byte payloads, and media columns built on them.

Decoder. Prefix codes are turned into lookup tables. For an image with one group of codes the lengths of all codes are
looked up at every bit position at once, which leaves a chain of positions to walk, one step per pixel or copy; symbols,
back-references and colour-cache hits are then resolved for all pixels together: every pixel that is no literal points to
an earlier one (the copied pixel, or the last one with the same cache slot), and pointers are followed by doubling. Images
with several groups of codes (an entropy image) are read symbol by symbol. Predictor, cross-colour, subtract-green and
palette transforms are inverted in reverse order.

Encoder. A payload becomes rows of 64 RGB pixels (192 bytes). Repetitions become back-references, other pixels hits of a
colour cache or literals; few colours become a palette. Other images have a predictor and a cross-colour element for each
tile, green subtracted, both, or neither, whichever leaves the least information (``transformed``); ``encode`` takes any
transforms by parameter. Payloads of more than 16,383 rows become several images in a row. The stored form depends on the payload only.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

#: Pixels in a row of the images made at once.
WIDTH = 64
#: Longest prefix code that the encoder makes (the format allows 15), and shortest repetition, in pixels.
LONGEST, REPETITION = 12, 6
#: Tiles of ``2**TILE`` pixels have a predictor and an element each; factors of 1/32 that elements are chosen from.
TILE, ELEMENTS = 5, (0, 8, 16, 32, -16)
#: Share of the pixels' information up to which residuals get elements.
REACH = 1.1
#: Bits that an image of tiles takes by its codes, and those that a tile takes in both.
_TILE_IMAGE, _TILE = 64, 12
_NEVER = 1 << 60

# Fixed values of the format.
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
_CACHE_FACTOR = 0x1E35A7BD
_LENGTHS, _DISTANCES = 24, 40
_OPAQUE = 0xFF000000


@lru_cache(maxsize=1)
def near_distances() -> list[tuple[int, int]]:
    """The 120 places before a pixel that have a distance code of their own, nearest first."""
    places = [(x, y) for y in range(8) for x in range(-7, 9) if y > 0 or x > 0]
    return sorted(places, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


@lru_cache(maxsize=64)
def _back(width: int) -> tuple[np.ndarray, dict[int, int]]:
    """Distance in pixels of each near distance code, and the code of such distances."""
    back = [max(1, x + y * width) for x, y in near_distances()]
    return np.array([0, *back]), {d: k + 1 for k, d in reversed(list(enumerate(back)))}


@lru_cache(maxsize=16)
def _reversed_bits(n: int) -> np.ndarray:
    out = np.zeros(1, np.int64)
    for k in range(n):
        out = np.concatenate([out * 2, out * 2 + 1]) if k else np.array([0, 1])
    return out


# ---------------------------------------------------------------------------------------------------------- decoding


class Bits:
    """Bits of a byte string, the lowest of each byte first."""

    PADDING = 24

    def __init__(self, data: bytes):
        self.at, self.size = 0, 8 * len(data)
        d = np.frombuffer(data + bytes(self.PADDING), np.uint8).astype(np.int32)
        self.data = d
        three = d[:-2] | d[1:-1] << 8 | d[2:] << 16
        #: The next 17 bits or more at every bit position.
        self.ahead = (three[:, None] >> np.arange(8, dtype=np.int32)).ravel()
        self.view = memoryview(self.ahead)

    def read(self, n: int) -> int:
        if self.at + n > self.size:
            raise ValueError("the image data end too early")
        value = self.view[self.at] & ((1 << min(n, 16)) - 1)
        if n > 16:
            value |= (self.view[self.at + 16] & ((1 << (n - 16)) - 1)) << 16
        self.at += n
        return value

    def many(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Values of up to 24 bits at many positions."""
        low = at >> 3
        d = self.data
        word = d[low].astype(np.int64) | d[low + 1].astype(np.int64) << 8
        word |= d[low + 2].astype(np.int64) << 16 | d[low + 3].astype(np.int64) << 24
        return word >> (at & 7) & ((np.int64(1) << n) - 1)


class Code:
    """A prefix code: for each possible value of the next ``width`` bits, 16 times the symbol plus its length."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) <= 1:
            self.width, self.table = 0, (used if len(used) else np.zeros(1, np.int64)).astype(np.int32) << 4
            return
        size = lengths[used]
        order = np.argsort(size, kind="stable")
        used, size = used[order], size[order]
        self.width = int(size[-1])
        counts = np.int64(1) << (self.width - size)
        if counts.sum() != 1 << self.width:
            raise ValueError("the prefix code is not complete")
        self.table = np.repeat((used << 4 | size).astype(np.int32), counts)[_reversed_bits(self.width)]

    @property
    def mask(self) -> int:
        return (1 << self.width) - 1

    def read(self, bits: Bits) -> int:
        entry = int(self.table[bits.view[bits.at] & self.mask])
        bits.at += entry & 15
        if bits.at > bits.size:
            raise ValueError("the image data end too early")
        return entry >> 4


def _read_code(bits: Bits, alphabet: int) -> Code:
    lengths = np.zeros(alphabet, np.int64)
    if bits.read(1):
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    first = np.zeros(19, np.int64)
    for k in range(4 + bits.read(4)):
        first[_LENGTH_ORDER[k]] = bits.read(3)
    tokens = alphabet
    if bits.read(1):
        tokens = 2 + bits.read(2 + 2 * bits.read(3))
    code = Code(first)
    table, mask = code.table.tolist(), code.mask
    view, at = bits.view, bits.at
    out: list[int] = []
    add, last = out.append, 8
    while len(out) < alphabet and tokens > 0:
        tokens -= 1
        ahead = view[at]
        entry = table[ahead & mask]
        size = entry & 15
        at += size
        if entry < 256:
            add(entry >> 4)
            if entry > 15:
                last = entry >> 4
        elif entry < 272:
            out += [last] * (3 + (ahead >> size & 3))
            at += 2
        elif entry < 288:
            out += [0] * (3 + (ahead >> size & 7))
            at += 3
        else:
            out += [0] * (11 + (ahead >> size & 127))
            at += 7
        if at > bits.size:
            raise ValueError("the code lengths are damaged")
    bits.at = at
    if len(out) > alphabet:
        raise ValueError("the code lengths are damaged")
    lengths[: len(out)] = out
    return Code(lengths)


def _value(prefix: int, bits: Bits) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = near_distances()[code - 1]
    return max(1, x + y * width)


def _slots(pixels: np.ndarray, cache_bits: int) -> np.ndarray:
    return (pixels * np.uint32(_CACHE_FACTOR)) >> np.uint32(32 - cache_bits)


def _read_pixels(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """An entropy-coded image as ARGB numbers; only the top one may have an entropy image."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups, tile, of_tile = 1, 0, None
    if top and bits.read(1):
        tile = bits.read(3) + 2
        across = (width + (1 << tile) - 1) >> tile
        down = (height + (1 << tile) - 1) >> tile
        of_tile = (_read_pixels(bits, across, down, False) >> np.uint32(8) & np.uint32(0xFFFF)).reshape(down, across)
        groups = int(of_tile.max()) + 1
    sizes = (256 + _LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, _DISTANCES)
    codes = [[_read_code(bits, n) for n in sizes] for _ in range(groups)]
    if groups == 1:
        pixels = _read_at_once(bits, width, width * height, cache_bits, codes[0])
        if pixels is not None:
            return pixels
    return _read_by_symbol(bits, width, height, cache_bits, codes, of_tile, tile)


def _read_by_symbol(bits, width, height, cache_bits, codes, of_tile, tile) -> np.ndarray:
    out: list[int] = []
    cache = [0] * (1 << cache_bits)
    seen = 0
    n = width * height
    while len(out) < n:
        y, x = divmod(len(out), width)
        green, red, blue, alpha, distance = codes[int(of_tile[y >> tile, x >> tile]) if tile else 0]
        symbol = green.read(bits)
        if symbol < 256:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            out.append(a << 24 | r << 16 | symbol << 8 | b)
        elif symbol < 256 + _LENGTHS:
            length = _value(symbol - 256, bits)
            back = _distance(_value(distance.read(bits), bits), width)
            if back > len(out) or len(out) + length > n:
                raise ValueError("a back-reference leaves the image")
            for _ in range(length):
                out.append(out[-back])
        else:
            while seen < len(out):  # the cache is brought up to date only when it is read
                cache[(out[seen] * _CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)] = out[seen]
                seen += 1
            out.append(cache[symbol - 256 - _LENGTHS])
    return np.array(out, np.uint32)


def _read_at_once(bits: Bits, width: int, n: int, cache_bits: int, codes: list[Code]) -> np.ndarray | None:
    """All pixels of an image with one group of codes; None if a symbol can take no bits, so that there is no chain."""
    green, red, blue, alpha, distance = codes
    if not any(c.width for c in codes[:4]) and green.table[0] < 256 << 4:
        parts = (alpha.table[0] >> 4, red.table[0] >> 4, green.table[0] >> 4, blue.table[0] >> 4)
        return np.full(n, int.from_bytes(bytes(map(int, parts)), "big"), np.uint32)
    if not green.width and (green.table[0] >= 256 << 4 or not any(c.width for c in codes[1:4])):
        return None
    low = bits.at
    ahead = bits.ahead[low:]
    end = bits.size - low  # codes that begin before the end can reach less than the padding beyond it
    here = green.table[ahead[:end] & green.mask]
    symbol = here >> 4
    after_green = np.arange(end, dtype=np.int32) + (here & 15)
    after = after_green
    for code in (red, blue, alpha):
        if code.width:
            after = after + (code.table[ahead[after] & code.mask] & 15)
    others = np.flatnonzero(here >= 256 << 4)
    if len(others):
        after = after.copy() if after is after_green else after
        after[others] = after_green[others]
    copies = others[symbol[others] < 256 + _LENGTHS]
    if len(copies):
        p = after_green[copies] + np.maximum(0, (symbol[copies] - 258) >> 1)
        d = distance.table[ahead[np.minimum(p, len(ahead) - 1)] & distance.mask]
        after[copies] = p + (d & 15) + np.maximum(0, ((d >> 4) - 2) >> 1)

    # The chain is walked four symbols at a time.
    chain = np.full(len(ahead), end, np.int32)
    np.minimum(after, end, out=chain[:end])
    twice = chain[chain]
    places: list[int] = []
    add, far, place = places.append, memoryview(twice[twice]), 0
    while place < end:
        add(place)
        place = far[place]
    at = np.array(places, np.int64)
    at = np.stack([at, chain[at], twice[at], chain[twice[at]]], axis=1).ravel()
    at = at[at < end]
    kind = symbol[at]
    copied = (kind >= 256) & (kind < 256 + _LENGTHS)
    size = np.ones(len(at), np.int64)
    if copied.any():
        size[copied], after_length = _values(bits, kind[copied] - 256, after_green[at[copied]] + low)
    # What is decoded from the bits after the last pixel does not count.
    used = int(np.searchsorted(np.cumsum(size), n)) + 1
    if used > len(at) or (stop := int(after[at[used - 1]])) > end:
        raise ValueError("the image data end too early")
    bits.at = low + stop
    at, kind, copied, size = at[:used], kind[:used], copied[:used], size[:used]
    if not copied.any() and not cache_bits:
        return _literals(at, kind, after_green, ahead, red, blue, alpha)
    back = np.zeros(used, np.int64)
    if copied.any():
        p = after_length[: int(copied.sum())]
        d = distance.table[ahead[p - low] & distance.mask]
        code, _ = _values(bits, d >> 4, p + (d & 15))
        near, _ = _back(width)
        back[copied] = np.where(code > 120, code - 120, near[np.minimum(code, 120)])
    first = np.cumsum(size) - size
    if first[-1] + size[-1] != n or (back[copied] > first[copied]).any():
        raise ValueError("a back-reference leaves the image")
    value = np.zeros(n + 1, np.uint32)  # the last stands for an empty slot of the cache
    source = np.arange(n + 1)
    plain = kind < 256
    value[first[plain]] = _literals(at[plain], kind[plain], after_green, ahead, red, blue, alpha)
    if copied.any():
        repeated = np.repeat(np.flatnonzero(copied), size[copied])
        inside = np.arange(len(repeated)) - np.repeat(np.cumsum(size[copied]) - size[copied], size[copied])
        target = first[repeated] + inside
        source[target] = target - back[repeated]
    hits = kind >= 256 + _LENGTHS
    if hits.any():
        # Slots of all pixels are known without their values: a copy has the slot of what it copies.
        slot = np.zeros(n + 1, np.uint16)
        slot[first[plain]] = _slots(value[first[plain]], cache_bits)
        slot[first[hits]] = kind[hits] - 256 - _LENGTHS
        root = _roots(source)
        slot = slot[root][:n]
        order = np.argsort(slot, kind="stable")
        before = np.full(n, n)
        slot = slot[order]
        before[order[1:]] = np.where(slot[1:] == slot[:-1], order[:-1], n)
        source[first[hits]] = before[first[hits]]
    return value[_roots(source)][:n]


def _values(bits: Bits, prefix: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of prefixes whose extra bits are at the positions, and the positions after them."""
    extra = np.maximum(0, (prefix - 2) >> 1)
    offset = np.where(prefix < 4, prefix, (2 + (prefix & 1)) << extra)
    return offset + bits.many(at, extra) + 1, at + extra


def _roots(source: np.ndarray) -> np.ndarray:
    while True:
        further = source[source]
        if (further == source).all():
            return source
        source = further


def _literals(at, green, after_green, ahead, red, blue, alpha) -> np.ndarray:
    place = after_green[at]
    out = green.astype(np.uint32) << np.uint32(8)
    for code, shift in ((red, 16), (blue, 0), (alpha, 24)):
        if code.width:
            entry = code.table[ahead[place] & code.mask]
            place = place + (entry & 15)
            out |= (entry >> 4).astype(np.uint32) << np.uint32(shift)
        else:
            out |= np.uint32(int(code.table[0] >> 4) << shift)
    return out


def _channels(pixels: np.ndarray) -> np.ndarray:
    """Bytes blue, green, red, alpha of pixels, as a view."""
    return np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(*pixels.shape, 4)


def _numbers(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels, np.uint8).view("<u4")[..., 0]


def _half(a, b):
    return (a + b) >> 1


def predicted(mode: int, left, top, top_right, top_left):
    """The prediction from neighbours, integer arrays of channels."""
    if mode == 11:
        by_left = np.abs(top - top_left).sum(axis=-1, keepdims=True)  # distance of the estimate left + top - top_left to left
        by_top = np.abs(left - top_left).sum(axis=-1, keepdims=True)
        return np.where(by_left < by_top, left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        mean = _half(left, top)
        difference = mean - top_left
        return np.clip(mean + np.where(difference < 0, -(-difference >> 1), difference >> 1), 0, 255)
    return {
        0: lambda: np.zeros_like(left) + np.array([0, 0, 0, 255]),
        1: lambda: left,
        2: lambda: top,
        3: lambda: top_right,
        4: lambda: top_left,
        5: lambda: _half(_half(left, top_right), top),
        6: lambda: _half(left, top_left),
        7: lambda: _half(left, top),
        8: lambda: _half(top_left, top),
        9: lambda: _half(top, top_right),
        10: lambda: _half(_half(left, top_left), _half(top, top_right)),
    }.get(mode, lambda: np.zeros_like(left) + np.array([0, 0, 0, 255]))()


def _unpredict(pixels: np.ndarray, modes: np.ndarray, tile: int) -> np.ndarray:
    height, width = pixels.shape
    res = _channels(pixels).astype(np.int16)
    of_pixel = _tiles(modes, height, width, tile)
    out = res + np.array([0, 0, 0, 255], np.int16)  # what is predicted as opaque black, as the first pixel is
    out[0, 1:] = out[0, :1] + np.cumsum(res[0, 1:], axis=0)
    out[1:, 0] = out[:1, 0] + np.cumsum(res[1:, 0], axis=0)
    out = (out & 255).reshape(-1, 4)
    res = res.reshape(-1, 4)
    # Pixels of equal x + 2 y need only those before; the last one's upper right is its row's first.
    y, x = np.nonzero((of_pixel[1:, 1:] > 0) & (of_pixel[1:, 1:] < 14))
    mode = of_pixel[y + 1, x + 1].astype(np.int64)
    key = (x + 2 * y) * 16 + mode
    order = np.argsort(key, kind="stable")
    at = ((y + 1) * width + x + 1)[order]
    cuts = np.flatnonzero(np.diff(key[order], prepend=-1, append=-1)) if len(at) else [0]
    for low, high in zip(cuts[:-1], cuts[1:]):
        i = at[low:high]
        p = predicted(int(mode[order[low]]), out[i - 1], out[i - width], out[i - width + 1], out[i - width - 1])
        out[i] = (res[i] + p) & 255
    return _numbers(out.astype(np.uint8).reshape(height, width, 4))


def _tiles(image: np.ndarray, height: int, width: int, tile: int) -> np.ndarray:
    """A tile image brought to the size of the pixels."""
    return np.repeat(np.repeat(image, 1 << tile, axis=0)[:height], 1 << tile, axis=1)[:, :width]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).view(np.int8).astype(np.int64)


def cross_coloured(pixels: np.ndarray, elements: np.ndarray, tile: int, inverse: bool) -> np.ndarray:
    c = _channels(pixels).astype(np.int64)
    e = _channels(_tiles(elements, *pixels.shape, tile))
    green = _signed(c[..., 1])
    sign = 1 if inverse else -1
    red = c[..., 2] + sign * (_signed(e[..., 0]) * green >> 5)
    by_red = _signed((red if inverse else c[..., 2]) & 255)
    blue = c[..., 0] + sign * ((_signed(e[..., 1]) * green >> 5) + (_signed(e[..., 2]) * by_red >> 5))
    c[..., 2], c[..., 0] = red & 255, blue & 255
    return _numbers(c.astype(np.uint8))


def _add_green(pixels: np.ndarray, sign: int) -> np.ndarray:
    c = _channels(pixels).copy()
    c[..., 0] += np.uint8(sign & 255) * c[..., 1]
    c[..., 2] += np.uint8(sign & 255) * c[..., 1]
    return _numbers(c)


def _palette_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _from_palette(pixels: np.ndarray, colours: np.ndarray, width: int) -> np.ndarray:
    packed = _palette_bits(len(colours))
    index = pixels >> np.uint32(8) & np.uint32(255)
    if packed:
        size = 8 >> packed
        parts = index[:, :, None] >> (np.arange(1 << packed, dtype=np.uint32) * np.uint32(size)) & np.uint32((1 << size) - 1)
        index = parts.reshape(len(pixels), -1)[:, :width]
    known = np.concatenate([colours, np.zeros(256, np.uint32)])  # an index beyond the palette is transparent black
    return known[index]


def stream_of(data: bytes) -> tuple[bytes, int]:
    """The lossless stream of the first file in ``data``, and the number of bytes that the file takes."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    end = 8 + struct.unpack("<I", data[4:8])[0]
    at = 12
    while at + 8 <= min(end, len(data)) and data[at : at + 4] != b"VP8L":
        size = struct.unpack("<I", data[at + 4 : at + 8])[0]
        at += 8 + size + (size & 1)
    if data[at : at + 4] != b"VP8L":
        raise ValueError("no lossless image in the file")
    size = struct.unpack("<I", data[at + 4 : at + 8])[0]
    return data[at + 8 : at + 8 + size], end


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """Pixels (height x width ARGB numbers) of the first image in ``data``, and the number of bytes it takes."""
    stream, end = stream_of(data)
    return decode_stream(stream), end


def decode_stream(data: bytes) -> np.ndarray:
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("the signature is missing")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    transforms, current = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in {t[0] for t in transforms}:
            raise ValueError("a transform occurs twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            tile = bits.read(3) + 2
            across, down = (current + (1 << tile) - 1) >> tile, (height + (1 << tile) - 1) >> tile
            transforms.append((kind, _read_pixels(bits, across, down, False).reshape(down, across), tile, current))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            steps = _channels(_read_pixels(bits, n, 1, False))
            colours = _numbers(np.cumsum(steps, axis=0, dtype=np.uint8))
            transforms.append((kind, colours, 0, current))
            packed = _palette_bits(n)
            current = (current + (1 << packed) - 1) >> packed
        else:
            transforms.append((kind, None, 0, current))
    pixels = _read_pixels(bits, current, height, True).reshape(height, current)
    for kind, image, tile, before in reversed(transforms):
        if kind == PREDICTOR:
            pixels = _unpredict(pixels, image >> np.uint32(8) & np.uint32(15), tile)
        elif kind == CROSS_COLOUR:
            pixels = cross_coloured(pixels, image, tile, inverse=True)
        elif kind == SUBTRACT_GREEN:
            pixels = _add_green(pixels, 1)
        else:
            pixels = _from_palette(pixels, image, before)
    return pixels


# ---------------------------------------------------------------------------------------------------------- encoding


class Writer:
    """Values with their numbers of bits, joined to bytes at the end, the lowest bit first."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.values: list[int] = []
        self.sizes: list[int] = []

    def put(self, value: int, size: int) -> None:
        self.values.append(value)
        self.sizes.append(size)

    def _flush(self) -> None:
        if self.values:
            self.parts.append((np.array(self.values, np.uint64), np.array(self.sizes, np.int64)))
            self.values, self.sizes = [], []

    def many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self._flush()
        self.parts.append((values.astype(np.uint64), sizes.astype(np.int64)))

    def bytes(self) -> bytes:
        self._flush()
        values = np.concatenate([p[0] for p in self.parts])
        sizes = np.concatenate([p[1] for p in self.parts])
        ends = np.cumsum(sizes)
        at = ends - sizes
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        out = np.zeros((int(ends[-1]) >> 6) + 2, np.uint64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] = np.bitwise_or.reduceat(values << shift, first)
        over = np.flatnonzero((at & 63) + sizes > 64)  # at most one value reaches over each word's end
        out[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
        return out.astype("<u8").tobytes()[: (int(ends[-1]) + 7) // 8]


def _settled(sizes: list[int], ideal: list[float], room: int, longest: int) -> list[int]:
    """Sizes of a complete code: longer where there is too little room for them, shorter where some is left."""
    while room < 0:  # the least frequent of the shorter ones get longer
        k = max((i for i in range(len(sizes)) if sizes[i] < longest), key=lambda i: (sizes[i], ideal[i]))
        room += 1 << (longest - sizes[k] - 1)
        sizes[k] += 1
    order = sorted(range(len(sizes)), key=[i - s for i, s in zip(ideal, sizes)].__getitem__) if room else []
    while room > 0:
        for k in order:
            cost = 1 << (longest - sizes[k])
            if cost <= room and sizes[k] > 1:
                sizes[k] -= 1
                room -= cost
    return sizes


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Lengths of a complete prefix code for each row of counts: rounded-up information, shortened where there is room."""
    lengths = np.zeros(counts.shape, np.int64)
    row, symbol = np.nonzero(counts)
    used = np.bincount(row, minlength=len(counts))
    ideal = np.log2(counts.sum(axis=1)[row] / counts[row, symbol])
    size = np.clip(np.ceil(ideal - 1e-9), 1, longest).astype(np.int64)
    room = (1 << longest) - np.bincount(row, np.int64(1) << (longest - size), len(counts)).astype(np.int64)
    room[used < 2] = 0
    # First those whose length is the most above the ideal, as many as there is room for.
    order = np.lexsort((ideal - size, row))
    order = order[size[order] > 1]
    of, cost = row[order], np.int64(1) << (longest - size[order])
    total = np.concatenate([[0], np.cumsum(cost)])
    taken = total[1:] - total[np.searchsorted(of, np.arange(len(counts)))][of] <= room[of]
    size[order[taken]] -= 1
    room -= np.bincount(of[taken], cost[taken], len(counts)).astype(np.int64)
    ends = np.cumsum(used)
    for k in np.flatnonzero(room).tolist():
        own = slice(ends[k] - used[k], ends[k])
        size[own] = _settled(size[own].tolist(), ideal[own].tolist(), int(room[k]), longest)
    lengths[row, symbol] = size
    return lengths


def canonical(lengths: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Code of each symbol as it is written, and its number of bits (0 for an only symbol), row by row."""
    values, sizes = np.zeros(lengths.shape, np.uint64), lengths.copy()
    row, symbol = np.nonzero(lengths)
    size = lengths[row, symbol]
    order = np.lexsort((size, row))
    span = np.int64(1) << (longest - size[order])
    starts = np.concatenate([[0], np.cumsum(span)])  # codes of ``longest`` bits, the first bit highest
    starts = starts[:-1] - starts[np.searchsorted(row, np.arange(len(lengths)))][row]
    values[row, symbol[order]] = _reversed_bits(longest)[starts]
    sizes[np.count_nonzero(lengths, axis=1) < 2] = 0
    return values, sizes


def written(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How the code of each row is stored: rows, values and their numbers of bits, in order.

    A code of one symbol, which must be below 256, or of none takes the short form.
    """
    n = len(lengths)
    row, symbol = np.nonzero(lengths)
    used = np.bincount(row, minlength=n)
    only = np.zeros(n, np.int64)
    only[row] = symbol
    short, long = np.flatnonzero(used < 2), np.flatnonzero(used > 1)
    symbol, row = symbol[used[row] > 1], row[used[row] > 1]
    gap = np.diff(symbol, prepend=0) - 1
    gap[np.searchsorted(row, long)] = symbol[np.searchsorted(row, long)]
    # A gap is written as runs of 138 zeros and one of the rest, or as one or two plain zeros.
    full, rest = np.divmod(gap, 138)
    tokens = full + np.where(rest < 3, rest, 1) + 1
    owner = np.repeat(np.arange(len(row)), tokens)
    ends = np.cumsum(tokens)
    place = np.arange(len(owner)) - (ends - tokens)[owner]
    of, rest = row[owner], rest[owner]
    kind = np.where(place < full[owner], 18, np.where(rest > 10, 18, np.where(rest > 2, 17, 0)))
    extra = np.where(place < full[owner], 127, np.where(rest > 10, rest - 11, np.where(rest > 2, rest - 3, 0)))
    kind[ends - 1], extra[ends - 1] = lengths[row, symbol], 0
    own = code_lengths(np.bincount(of * 19 + kind, minlength=n * 19).reshape(n, 19), 7)
    lone = np.flatnonzero(np.count_nonzero(own, axis=1) == 1)
    own[lone, np.where(own[lone, 0], 1, 0)] = 1  # this code must have two symbols to be written
    values, sizes = canonical(own, 7)
    wanted = own[long][:, _LENGTH_ORDER]
    first = np.maximum(4, 19 - np.argmax(wanted[:, ::-1] > 0, axis=1))
    of_lengths = (wanted << (3 * np.arange(19))).sum(axis=1)
    number = np.bincount(of, minlength=n)[long] - 2
    half = np.maximum(0, (np.frexp(number)[1] - 1) // 2)
    cut = only[long] + 1 < lengths.shape[1]  # the rest is 0
    size = sizes[of, kind]
    parts = [
        (short, 0b101 | only[short] << 3, np.full(len(short), 11)),
        (long, first - 4 << 1, np.full(len(long), 5)),
        (long, of_lengths, 3 * first),
        (long, np.where(cut, 1 | half << 1 | number << 4, 0), np.where(cut, 6 + 2 * half, 1)),
        (of, values[of, kind].astype(np.int64) | extra << size, size + np.where(kind == 18, 7, np.where(kind == 17, 3, 0))),
    ]
    rows, value, size = (np.concatenate(p) for p in zip(*parts))
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    return rows[order], value[order], size[order]


def _write_single(out: Writer, symbol: int) -> None:
    """The code of a single symbol below 256, which takes no bits."""
    out.put(0b101, 3)
    out.put(symbol, 8)


def _prefixed(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix, extra bits and their number of values from 1."""
    x = np.asarray(value, np.int64) - 1
    high = np.where(x > 3, np.floor(np.log2(np.maximum(x, 1) + 0.5)).astype(np.int64), 1)
    prefix = np.where(x < 4, x, 2 * high + (x >> np.maximum(high - 1, 0) & 1))
    n = np.where(x < 4, 0, high - 1)
    return prefix, x & ((np.int64(1) << n) - 1), n


def repetitions(pixels: np.ndarray, ends: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """``(at, length, distance)`` of repetitions, without overlap: runs of pixels whose next four occurred before.

    ``ends`` are those of up to 65,536 images one after the other; repetitions lie inside one image.
    """
    n = len(pixels)
    if n < REPETITION + 1:
        return []
    wide = pixels.astype(np.uint64)
    key = (wide[:-3] * np.uint64(0x9E3779B97F4A7C15)) ^ (wide[1:-2] * np.uint64(0xC2B2AE3D27D4EB4F))
    key ^= (wide[2:-1] * np.uint64(0x165667B19E3779F9)) ^ (wide[3:] * np.uint64(0x27D4EB2F165667C5))
    key = (key >> np.uint64(48)).astype(np.uint16)  # short keys sort faster; repetitions are compared below
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    same = sorted_key[1:] == sorted_key[:-1]
    if ends is not None:
        image = np.repeat(np.arange(len(ends), dtype=np.uint16), np.diff(ends, prepend=0))
        order = order[image[order] == image[order + 3]]  # four pixels of one image
        order = order[np.argsort(image[order], kind="stable")]
        same = (key[order[1:]] == key[order[:-1]]) & (image[order[1:]] == image[order[:-1]])
    if not same.any():
        return []
    back = np.zeros(n - 3, np.int64)
    back[order[1:]] = np.where(same, order[1:] - order[:-1], 0)
    cuts = np.flatnonzero(np.diff(back)) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [n - 3]])
    keep = (back[starts] > 0) & (ends - starts + 3 >= REPETITION)
    out, free = [], 0
    for start, end in zip(starts[keep].tolist(), ends[keep].tolist()):
        d = int(back[start])
        low, high = max(start, free), end + 3
        if high - low < REPETITION or (pixels[low:high] != pixels[low - d : high - d]).any():
            continue
        while high - low >= REPETITION:
            size = min(4096, high - low)
            out.append((low, size, d))
            low += size
        free = low
    return out


def _write_pixels(out: Writer, pixels: np.ndarray, width: int, cache_bits: int, copies, groups: np.ndarray | None = None, tile: int = 0) -> None:
    """An entropy-coded image (flat ARGB numbers); ``groups`` numbers the code group of each tile of a top image."""
    n = len(pixels)
    size = np.ones(n, np.int64)
    distance = np.zeros(n, np.int64)
    start = np.ones(n, bool)
    for at, length, d in copies:
        size[at], distance[at] = length, d
        start[at + 1 : at + length] = False
    at = np.flatnonzero(start)
    size, distance, value = size[at], distance[at], pixels[at]
    channels = _channels(value)
    green = channels[:, 1].astype(np.int64)
    copied = distance > 0
    if cache_bits:
        slot = _slots(pixels, cache_bits).astype(np.uint16)
        order = np.argsort(slot, kind="stable")
        known = np.zeros(n, bool)
        by_slot = pixels[order]  # equal pixels have the same slot
        known[order[1:]] = by_slot[1:] == by_slot[:-1]
        slot = slot.astype(np.int64)
        cached = known[at] & ~copied
        green = np.where(cached, 256 + _LENGTHS + slot[at], green)
    else:
        cached = np.zeros(len(at), bool)
    literal = ~copied & ~cached
    prefix, extra, extra_bits = _prefixed(size)
    green = np.where(copied, 256 + prefix, green)
    _, numbers = _back(width)
    codes = np.array([numbers.get(d, d + 120) for d in distance[copied].tolist()], np.int64)
    far, far_extra, far_bits = _prefixed(codes) if len(codes) else (codes, codes, codes)

    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    group = np.zeros(len(at), np.int64)
    if tile:
        out.put(1 if groups is not None else 0, 1)
    if groups is not None:
        out.put(tile - 2, 3)
        _write_pixels(out, (groups.astype(np.uint32) << np.uint32(8)).ravel(), groups.shape[1], 0, [])
        group = groups[at // width >> tile, at % width >> tile]
    alphabet = 256 + _LENGTHS + (1 << cache_bits if cache_bits else 0)
    values, sizes = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64)

    def append(where: np.ndarray, value: np.ndarray, n: np.ndarray) -> None:
        values[where] |= value.astype(np.uint64) << sizes[where].astype(np.uint64)
        sizes[where] += n

    for g in range(int(groups.max()) + 1 if groups is not None else 1):
        own = group == g
        symbols = [
            (own, green[own], alphabet),
            (own & literal, channels[own & literal, 2].astype(np.int64), 256),
            (own & literal, channels[own & literal, 0].astype(np.int64), 256),
            (own & literal, channels[own & literal, 3].astype(np.int64), 256),
            (own & copied, far[own[copied]], _DISTANCES),
        ]
        for k, (where, symbol, n_symbols) in enumerate(symbols):
            if k and (not len(symbol) or symbol.min() == symbol.max()):
                _write_single(out, int(symbol[0]) if len(symbol) else 0)
                if k == 4 and len(symbol):
                    append(np.flatnonzero(where), far_extra[own[copied]], far_bits[own[copied]])
                continue
            lengths = code_lengths(np.bincount(symbol, minlength=n_symbols)[None], LONGEST)
            if k == 0 and (lengths > 0).sum() == 1 and lengths.argmax() >= 256:
                lengths[0, lengths.argmax() - 1] = 1  # the short form cannot name it
            out.many(*written(lengths)[1:])
            code, code_size = canonical(lengths, LONGEST)
            append(np.flatnonzero(where), code[0, symbol], code_size[0, symbol])
            if k == 0:
                length = np.flatnonzero(own & copied)
                append(length, extra[length], extra_bits[length])
            elif k == 4:
                append(np.flatnonzero(where), far_extra[own[copied]], far_bits[own[copied]])
    out.many(values, sizes)


def encode(
    pixels: np.ndarray,
    transforms: tuple = (),
    cache_bits: int = 0,
    copies: bool = True,
    groups: np.ndarray | None = None,
    tile: int = 4,
) -> bytes:
    """A WebP file of ARGB numbers (height x width).

    ``transforms`` are applied in order: ``(PREDICTOR, modes)`` and ``(CROSS_COLOUR, elements)`` with an image of tiles of
    ``2**tile`` pixels, ``(SUBTRACT_GREEN,)`` and ``(PALETTE,)``.
    """
    height, width = pixels.shape
    out = Writer()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(int((pixels >> np.uint32(24) != 255).any()), 1)
    out.put(0, 3)
    for kind, *image in transforms:
        out.put(1, 1)
        out.put(kind, 2)
        if kind == PALETTE:
            colours, index = np.unique(pixels, return_inverse=True)
            out.put(len(colours) - 1, 8)
            steps = np.diff(_channels(colours).astype(np.int64), axis=0, prepend=0).astype(np.uint8)
            _write_pixels(out, _numbers(steps), len(colours), 0, [])
            packed = _palette_bits(len(colours))
            index = np.pad(index.reshape(pixels.shape), ((0, 0), (0, -pixels.shape[1] % (1 << packed))))
            parts = index.reshape(height, -1, 1 << packed) << (np.arange(1 << packed) * (8 >> packed))
            pixels = (parts.sum(axis=2).astype(np.uint32) << np.uint32(8)) | np.uint32(_OPAQUE)
        elif kind == SUBTRACT_GREEN:
            pixels = _add_green(pixels, -1)
        else:
            out.put(tile - 2, 3)
            numbers = image[0].astype(np.uint32) << np.uint32(8) if kind == PREDICTOR else image[0]
            _write_pixels(out, numbers.astype(np.uint32).ravel(), image[0].shape[1], 0, [])
            if kind == PREDICTOR:
                pixels = _residuals(pixels, image[0], tile)
            else:
                pixels = cross_coloured(pixels, image[0], tile, inverse=False)
    out.put(0, 1)
    flat = pixels.ravel()
    _write_pixels(out, flat, pixels.shape[1], cache_bits, repetitions(flat) if copies else [], groups, tile)
    return _file(out.bytes())


def _file(stream: bytes) -> bytes:
    body = b"VP8L" + struct.pack("<I", len(stream)) + stream + bytes(len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


Parts = list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _coded(images: list[np.ndarray], widths: np.ndarray, cache_bits: int, top: bool) -> Parts:
    """How entropy-coded images (flat ARGB numbers) are written: parts of image numbers, values and their numbers of bits.

    Top images may have repetitions; they have one group of codes.
    """
    n = len(images)
    counts = np.fromiter(map(len, images), np.int64, n)
    pixels = np.concatenate(images)
    image = np.repeat(np.arange(n), counts)
    size, distance = np.ones(len(pixels), np.int64), np.zeros(len(pixels), np.int64)
    start = np.ones(len(pixels), bool)
    for at, length, d in repetitions(pixels, np.cumsum(counts)) if top else ():
        size[at], distance[at] = length, d
        start[at + 1 : at + length] = False
    cached = np.zeros(len(pixels), bool)
    slot = np.zeros(len(pixels), np.int64)
    if cache_bits:  # a pixel is a hit if the one before it in its slot is equal
        slot = _slots(pixels, cache_bits).astype(np.int64)
        place = (image << cache_bits | slot).astype(np.uint16)
        order = np.argsort(place, kind="stable")
        by_slot, place = pixels[order], place[order]
        cached[order[1:]] = (by_slot[1:] == by_slot[:-1]) & (place[1:] == place[:-1])

    at = np.flatnonzero(start)
    image, distance, cached = image[at], distance[at], cached[at]
    copied = distance > 0
    cached &= ~copied
    channels = _channels(pixels[at])
    green = np.where(cached, 256 + _LENGTHS + slot[at], channels[:, 1])
    copies, literals = np.flatnonzero(copied), np.flatnonzero(~copied & ~cached)
    prefix, extra, extra_bits = _prefixed(size[at[copies]])
    green[copies] = 256 + prefix
    back = zip(distance[copies].tolist(), widths[image[copies]].tolist())
    far, far_extra, far_bits = _prefixed(np.array([_back(w)[1].get(d, d + 120) for d, w in back], np.int64))

    flags, n_flags = (1 | cache_bits << 1, 5) if cache_bits else (0, 1)
    every = np.arange(n)
    parts = [(every, np.full(n, flags), np.full(n, n_flags + top))]  # a top image has no entropy image: another 0
    values, sizes = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)

    def append(where: np.ndarray, value: np.ndarray, bits: np.ndarray) -> None:
        values[where] |= value.astype(np.int64) << sizes[where]
        sizes[where] += bits

    for k, (where, symbol, alphabet) in enumerate(
        [
            (np.arange(len(at)), green, 256 + _LENGTHS + (1 << cache_bits if cache_bits else 0)),
            (literals, channels[literals, 2].astype(np.int64), 256),
            (literals, channels[literals, 0].astype(np.int64), 256),
            (literals, channels[literals, 3].astype(np.int64), 256),
            (copies, far, _DISTANCES),
        ]
    ):
        counts = np.bincount(image[where] * alphabet + symbol, minlength=n * alphabet).reshape(n, alphabet)
        lengths = code_lengths(counts, LONGEST)
        parts.append(written(lengths))
        code, code_size = canonical(lengths, LONGEST)
        append(where, code[image[where], symbol], code_size[image[where], symbol])
        if k == 0:
            append(copies, extra, extra_bits)
    append(copies, far_extra, far_bits)
    return [*parts, (image, values, sizes)]


@lru_cache(maxsize=1)
def _weights() -> np.ndarray:
    return _weight(np.arange(1 + (1 << 2 * TILE)))


def _weight(counts: np.ndarray) -> np.ndarray:
    return np.rint(1024 * counts * np.log2(np.maximum(counts, 1))).astype(np.int64)


def _bits(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Information of the bytes of each of ``n`` images, in whole 1024ths of a bit, so that sums are the same in any
    order; ``of`` has 256 times their number."""
    counts = np.bincount((of + values).ravel(), minlength=n * 256).reshape(n, 256)
    small = counts.max(initial=0) < len(_weights())
    return _weight(counts.sum(axis=1)) - (_weights()[counts] if small else _weight(counts)).sum(axis=1)


def _best(candidates, of: np.ndarray, n: int) -> np.ndarray:
    """For each tile the first candidate whose bytes have the least information; 0 without pixels.

    A tile has as many bytes by each candidate, so that only the weights of their counts differ.
    """
    most, best = np.full(n, -1), np.zeros(n, np.int64)
    for k, planes in candidates:
        weight = np.zeros(n, np.int64)
        for values in planes:
            counts = np.bincount((of + values).ravel(), minlength=n * 256)
            weight += _weights().take(counts).reshape(n, 256).sum(axis=1)
        best[weight > most] = k
        np.maximum(most, weight, out=most)
    return best


def _mean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``_half`` of bytes."""
    return (a & b) + ((a ^ b) >> 1)


def _all_residuals(own, left, top, top_right, top_left) -> np.ndarray:
    """What each predictor leaves of opaque pixels, as bytes: predictors x blue, green, red x pixels."""
    left_mean, right_mean, mean = _mean(left, top_left), _mean(top, top_right), _mean(left, top)
    by_left, by_top = (
        (np.maximum(near, top_left) - np.minimum(near, top_left)).sum(axis=0, dtype=np.uint16) for near in (top, left)
    )
    signed_left = top_left.astype(np.int16)
    half = mean - signed_left
    half += half < 0
    half >>= 1  # halved towards 0
    predictions = [
        np.uint8(0), left, top, top_right, top_left, _mean(_mean(left, top_right), top), left_mean, mean, _mean(top_left, top),
        right_mean, _mean(left_mean, right_mean), np.where(by_left < by_top, left, top),
        np.clip(left + (top - signed_left), 0, 255).astype(np.uint8), np.clip(mean + half, 0, 255).astype(np.uint8),
    ]
    return np.stack([own - p for p in predictions])


def transformed(images: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None, bool]]:
    """The pixels, modes, elements and subtraction of green with which each opaque image (``WIDTH`` to a row) is stored.

    Each tile has the predictor, and then the cross-colour element, after which its bytes have the least information; elements
    are tried where the predictors leave at most ``REACH`` times that of the pixels. An image is stored so, as it is, or either
    with green subtracted, whichever has the least, with its tiles, over the whole image.
    """
    n = len(images)
    heights = np.array([len(i) // WIDTH for i in images], np.int64)
    starts = np.cumsum(heights) - heights
    #: Planes of blue, green and red, which are quicker to count than bytes of pixels.
    c = np.ascontiguousarray(np.moveaxis(_channels(np.concatenate(images).reshape(-1, WIDTH))[..., :3], -1, 0))
    image = np.repeat(np.arange(n), heights)
    row = np.arange(len(image)) - starts[image]
    across, down = -(-WIDTH >> TILE), (heights + (1 << TILE) - 1) >> TILE
    first_tile = across * (np.cumsum(down) - down)
    tiles = int(across * down.sum())
    tile = (first_tile[image] + across * (row >> TILE))[:, None] + (np.arange(WIDTH) >> TILE)
    of_image = np.repeat(256 * image[:, None], WIDTH, axis=1)

    left, top, top_left, top_right = (np.zeros_like(c) for _ in range(4))
    left[..., 1:], top[:, 1:], top_left[:, 1:, 1:] = c[..., :-1], c[:, :-1], c[:, :-1, :-1]
    top_right[:, 1:, :-1], top_right[:, 1:, -1] = c[:, :-1, 1:], c[:, 1:, 0]
    below = np.flatnonzero(row)  # the first row of an image has no row above it
    residuals = _all_residuals(*(x[:, below] for x in (c, left, top, top_right, top_left)))
    modes = _best(enumerate(residuals), 256 * tile[below], tiles)
    crossed = c - left  # as in the first rows
    crossed[:, below] = np.take_along_axis(residuals, modes[tile[below]][None, None], axis=0)[0]
    crossed[:, below, 0] = c[:, below, 0] - top[:, below, 0]
    del residuals

    plain_bits, crossed_bits = ([_bits(v, of_image, n) for v in planes] for planes in (c, crossed))
    near = sum(crossed_bits) <= REACH * sum(plain_bits)
    to_red, to_blue, red_to_blue = (np.zeros(tiles, np.int64) for _ in range(3))
    some = np.flatnonzero(near)
    rows = np.flatnonzero(near[image])
    if len(some):
        own_tiles = np.flatnonzero(np.repeat(near, across * down))
        at = tile[rows]
        of = 256 * np.searchsorted(own_tiles, at)
        blue, green, red = crossed[:, rows]
        signed_green, signed_red = _signed(green), _signed(red)
        by_green = [(e, (e * signed_green >> 5).astype(np.uint8)) for e in ELEMENTS]
        to_red[own_tiles] = _best(((e, [red - d]) for e, d in by_green), of, len(own_tiles))
        to_blue[own_tiles] = _best(((e, [blue - d]) for e, d in by_green), of, len(own_tiles))
        blue = blue - (to_blue[at] * signed_green >> 5).astype(np.uint8)
        by_red = ((e, [blue - (e * signed_red >> 5).astype(np.uint8)]) for e in ELEMENTS)
        red_to_blue[own_tiles] = _best(by_red, of, len(own_tiles))
        crossed[2, rows] = red - (to_red[at] * signed_green >> 5).astype(np.uint8)
        crossed[0, rows] = blue - (red_to_blue[at] * signed_red >> 5).astype(np.uint8)
    elements = _numbers(np.stack([to_red, to_blue, red_to_blue, np.full(tiles, 255)], axis=1).astype(np.uint8))

    #: As it is, with green subtracted, and both after the tiles' transforms.
    bits = np.full((4, n), _NEVER)
    blue, green, red = c
    bits[0] = sum(plain_bits)
    bits[1] = plain_bits[1] + 1024 * 3 + _bits(blue - green, of_image, n) + _bits(red - green, of_image, n)
    if len(some):
        of = 256 * np.repeat(np.searchsorted(some, image[rows])[:, None], WIDTH, axis=1)
        blue, green, red = crossed[:, rows]
        common = _bits(green, of, len(some)) + 1024 * (2 * _TILE_IMAGE + _TILE * across * down[some])
        bits[2, some] = common + _bits(blue, of, len(some)) + _bits(red, of, len(some))
        bits[3, some] = common + 1024 * 3 + _bits(blue - green, of, len(some)) + _bits(red - green, of, len(some))
    out = []
    for k, way in enumerate(np.argmin(bits, axis=0).tolist()):
        pixels, own_modes, own_elements = images[k], None, None
        if way > 1:
            planes = crossed[:, starts[k] : starts[k] + heights[k]].astype(np.uint32)
            pixels = (planes[0] | planes[1] << np.uint32(8) | planes[2] << np.uint32(16)).ravel()
            t = slice(first_tile[k], first_tile[k] + across * down[k])
            own_modes, own_elements = modes[t], elements[t]
        out.append((_add_green(pixels, -1) if way & 1 else pixels, own_modes, own_elements, bool(way & 1)))
    return out


def encode_many(images: list[np.ndarray], cache_bits: int, palette: bool = False) -> list[bytes]:
    """WebP files of opaque images (flat ARGB numbers, ``WIDTH`` to a row), made all at once.

    There may be at most ``65,536 >> cache_bits`` images. A file does not depend on the others. With ``palette`` each image
    has at most 256 colours.
    """
    n = len(images)
    every, widths = np.arange(n), np.full(n, WIDTH)
    heights = np.array([len(i) // WIDTH for i in images], np.int64)
    parts: Parts = [(every, 0x2F | WIDTH - 1 << 8 | heights - 1 << 22, np.full(n, 40))]
    if palette:
        steps = []
        for k, pixels in enumerate(images):
            colours, index = np.unique(pixels, return_inverse=True)
            steps.append(_numbers(np.diff(_channels(colours), axis=0, prepend=np.uint8(0))))
            packed = _palette_bits(len(colours))
            widths[k] = WIDTH >> packed
            indices = index.reshape(-1, 1 << packed) << (np.arange(1 << packed) * (8 >> packed))
            images[k] = (indices.sum(axis=1).astype(np.uint32) << np.uint32(8)) | np.uint32(_OPAQUE)
        number = np.fromiter(map(len, steps), np.int64, n)
        parts.append((every, 1 | PALETTE << 1 | number - 1 << 3, np.full(n, 11)))
        parts += _coded(steps, number, 0, False)
    else:
        images, modes, elements, subtract = map(list, zip(*transformed(images)))
        used = np.array([k for k in range(n) if modes[k] is not None], np.int64)
        for kind, tiles in ((PREDICTOR, modes), (CROSS_COLOUR, elements)):
            if len(used):
                own = [tiles[k].astype(np.uint32) << np.uint32(8) if kind == PREDICTOR else tiles[k] for k in used]
                parts.append((used, np.full(len(used), 1 | kind << 1 | TILE - 2 << 3), np.full(len(used), 6)))
                parts += [(used[r], *rest) for r, *rest in _coded(own, np.full(len(used), -(-WIDTH >> TILE)), 0, False)]
        green = np.flatnonzero(subtract)
        parts.append((green, np.full(len(green), 1 | SUBTRACT_GREEN << 1), np.full(len(green), 3)))
    parts.append((every, np.zeros(n, np.int64), np.ones(n, np.int64)))
    parts += _coded(images, widths, cache_bits, True)
    bits = sum(np.bincount(rows, size, n) for rows, _, size in parts).astype(np.int64)
    parts.append((every, np.zeros(n, np.int64), -bits % 64))  # each image begins at a word
    rows, value, size = (np.concatenate(p) for p in zip(*parts))
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    out = Writer()
    out.many(value[order], size[order])
    stream = out.bytes()
    starts = np.cumsum((bits + 63) // 64 * 8) - (bits + 63) // 64 * 8
    return [_file(stream[s : s + (b + 7) // 8]) for s, b in zip(starts.tolist(), bits.tolist())]


def _residuals(pixels: np.ndarray, modes: np.ndarray, tile: int) -> np.ndarray:
    c = _channels(pixels).astype(np.int64)
    height, width = pixels.shape
    left, top, top_left, top_right = (np.zeros_like(c) for _ in range(4))
    left[:, 1:], top[1:], top_left[1:, 1:] = c[:, :-1], c[:-1], c[:-1, :-1]
    top_right[1:, :-1], top_right[1:, -1] = c[:-1, 1:], c[1:, 0]
    of_pixel = _tiles(modes, height, width, tile)
    guess = np.zeros_like(c)
    for mode in np.unique(of_pixel).tolist():
        here = of_pixel == mode
        guess[here] = predicted(mode, left, top, top_right, top_left)[here]
    guess[0], guess[1:, 0] = left[0], top[1:, 0]
    guess[0, 0] = [0, 0, 0, 255]
    return _numbers(((c - guess) & 255).astype(np.uint8))
