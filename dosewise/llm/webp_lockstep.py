"""Many small WebP images read in lockstep: each step reads one code length or one pixel of every image.

The steps only find where the symbols of each image are; lengths, pixels, back-references and colour-cache hits are then
resolved for all images together, as ``webp`` does for one. Images with other transforms than a palette, several groups of
codes, repeated code lengths or codes above ``webp.LONGEST``, large images and damaged ones are left to ``webp``.
"""

from __future__ import annotations

import numpy as np

from dosewise.llm import webp as W

#: Pixels of the largest image read in lockstep, images read together, and steps between looks at which are finished.
MOST_PIXELS, TOGETHER, STEPS = 4096, 512, 32
_BEFORE, _COPY, _HIT = 8, 256, 256 + W._LENGTHS
#: Bits that a code length's symbol takes beside its code, and the least run that it stands for.
_RUN_BITS = np.array([0] * 16 + [2, 3, 7])
_RUN_LEAST = np.array([1] * 16 + [3, 3, 11])


class _Streams:
    def __init__(self, streams: list[bytes]):
        sizes = np.fromiter(map(len, streams), np.int64, len(streams)) + _BEFORE
        d = np.frombuffer(b"".join(s + bytes(_BEFORE) for s in streams) + bytes(16 * STEPS + 8), np.uint8).astype(np.int64)
        #: The next four bytes at each byte.
        self.words = d[:-3] | d[1:-2] << 8 | d[2:-1] << 16 | d[3:] << 24
        self.starts = 8 * (np.cumsum(sizes) - sizes)
        self.ends = self.starts + 8 * (sizes - _BEFORE)
        self.ok = np.ones(len(streams), bool)

    def ahead(self, at: np.ndarray) -> np.ndarray:
        """The next 25 bits or more."""
        return self.words[at >> 3] >> (at & 7)

    def check(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Marks the images that have been read beyond their end, which go on at their last bit."""
        self.ok[rows[at > self.ends[rows]]] = False
        return np.minimum(at, self.ends[rows])


def _tables(t: _Streams, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For each row and each value of the next bits: 16 times the symbol plus the length of its code."""
    n = len(lengths)
    lengths[lengths.max(axis=1) > W.LONGEST] = 0
    row, symbol = np.nonzero(lengths)
    used = np.bincount(row, minlength=n)
    size = np.where(used[row] > 1, lengths[row, symbol], 0)
    width = int(size.max(initial=0))
    span = np.int64(1) << (width - size)
    whole = np.bincount(row, span, n) == 1 << width
    t.ok[rows[~whole & (used > 0)]] = False
    order = np.lexsort((size, row))
    order = order[whole[row[order]]]
    table = np.zeros((n, 1 << width), np.int32)
    table[whole] = np.repeat((symbol << 4 | size)[order].astype(np.int32), span[order]).reshape(-1, 1 << width)
    return np.take(table, W._reversed_bits(width), axis=1).ravel() if width else table.ravel(), width


def _read_lengths(t: _Streams, rows: np.ndarray, at: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code lengths of one code of each row, and the positions after them."""
    lengths = np.zeros((len(rows), max(int(alphabet.max()), 1)), np.int64)
    w = t.ahead(at)
    short = w & 1 == 1
    two, wide = w >> 1 & 1, w >> 2 & 1
    after = at + 3 + np.where(wide, 8, 1)
    symbols = np.where(wide, w >> 3 & 255, w >> 3 & 1), t.ahead(after) & 255
    for symbol, here in zip(symbols, (short, short & (two == 1))):
        t.ok[rows[here & (symbol >= alphabet)]] = False
        here = np.flatnonzero(here & (symbol < alphabet))
        lengths[here, symbol[here]] = 1
    after += 8 * two
    long = np.flatnonzero(~short)
    if not len(long):
        return lengths, t.check(rows, after)

    n = 4 + (w[long] >> 1 & 15)
    p = at[long] + 5
    first = np.zeros((len(long), 19), np.int64)
    for k, symbol in enumerate(W._LENGTH_ORDER):
        first[:, symbol] = np.where(k < n, t.ahead(np.minimum(p + 3 * k, t.ends[rows[long]])) & 7, 0)
    p = t.check(rows[long], p + 3 * n)
    w = t.ahead(p)
    bits = 2 + 2 * (w >> 1 & 7)
    limited = w & 1 == 1
    tokens = np.where(limited, 2 + (w >> 4 & ((np.int64(1) << bits) - 1)), alphabet[long])
    p = t.check(rows[long], p + np.where(limited, 4 + bits, 1))
    table, width = _tables(t, rows[long], first)
    taken = (table & 15) + _RUN_BITS[table >> 4]
    active, mask, step = np.arange(len(long)), (1 << width) - 1, 0
    filled = np.zeros(len(long), np.int64)
    while len(active):
        own, here = active << width, np.empty((STEPS + 1, len(active)), np.int64)
        q = p[active]
        for k in range(STEPS):
            here[k] = q
            q = q + taken[own + (t.words[q >> 3] >> (q & 7) & mask)]
        here[STEPS] = q
        w = t.ahead(here[:-1])
        entry = table[own + (w & mask)]
        symbol = entry >> 4
        run = _RUN_LEAST[symbol] + (w >> (entry & 15) & ((1 << _RUN_BITS[symbol]) - 1))
        total = np.cumsum(run, axis=0) + filled[active]
        final = (total >= alphabet[long[active]]) | (step + 1 + np.arange(STEPS)[:, None] >= tokens[active])
        last = np.where(final.any(axis=0), final.argmax(axis=0), STEPS - 1)
        valid = np.arange(STEPS)[:, None] <= last
        column = np.arange(len(active))
        p[active], filled[active] = here[last + 1, column], total[last, column]
        t.ok[rows[long[active[(valid & (symbol == 16)).any(axis=0)]]]] = False  # repeats a length before
        k, c = np.nonzero(valid & (symbol > 0) & (symbol < 16) & (total <= alphabet[long[active]]))
        lengths[long[active[c]], total[k, c] - 1] = symbol[k, c]
        p[active] = t.check(rows[long[active]], p[active])
        active = active[~final.any(axis=0) & t.ok[rows[long[active]]]]
        step += STEPS
    t.ok[rows[long[filled > alphabet[long]]]] = False
    after[long] = p
    return lengths, t.check(rows, after)


def _value(t: _Streams, prefix: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    extra = np.maximum(0, (prefix - 2) >> 1)
    start = np.where(prefix < 4, prefix, (2 + (prefix & 1)) << extra)
    return start + (t.ahead(at) & ((np.int64(1) << extra) - 1)) + 1, at + extra


def _read_pixels(t: _Streams, rows: np.ndarray, at: np.ndarray, widths: np.ndarray, counts: np.ndarray, top: bool):
    """Pixels of all rows one after the other, and the positions after them."""
    n = len(rows)
    w = t.ahead(at)
    cached = w & 1 == 1
    cache_bits = np.where(cached, w >> 1 & 15, 0)
    at = at + np.where(cached, 5, 1)
    t.ok[rows[(cache_bits > 11) | cached & (cache_bits == 0)]] = False
    cache_bits = np.minimum(cache_bits, 11)
    if top:
        t.ok[rows[t.ahead(at) & 1 == 1]] = False
        at = at + 1
    at = t.check(rows, at)
    codes = []
    for size in (np.where(cached, _HIT + (1 << cache_bits), _HIT), 256, 256, 256, W._DISTANCES):
        lengths, at = _read_lengths(t, rows, at, np.full(n, size) if isinstance(size, int) else size)
        codes.append(_tables(t, rows, lengths))
    (green, g), *channels, (far, f) = codes

    found = []
    filled = np.zeros(n, np.int64)
    active = np.flatnonzero(t.ok[rows])
    while len(active):
        here = np.empty((STEPS + 1, len(active)), np.int64)
        q = at[active]
        own, others = active << g, [(table, width, active << width) for table, width in channels if width]
        for k in range(STEPS):
            here[k] = q
            entry = green[own + (t.words[q >> 3] >> (q & 7) & ((1 << g) - 1))]
            q = q + (entry & 15)
            special = np.flatnonzero(entry >= _COPY << 4)
            if len(special):
                kind, s = entry[special] >> 4, q[special]
                copy = np.flatnonzero(kind < _HIT)
                if len(copy):
                    c = s[copy] + np.maximum(0, (kind[copy] - _COPY - 2) >> 1)
                    d = far[(active[special[copy]] << f) + (t.ahead(c) & ((1 << f) - 1))]
                    s[copy] = c + (d & 15) + np.maximum(0, ((d >> 4) - 2) >> 1)
            for table, width, place in others:
                q += table[place + (t.words[q >> 3] >> (q & 7) & ((1 << width) - 1))] & 15
            if len(special):
                q[special] = s
        here[STEPS] = q
        w = t.ahead(here[:-1])
        entry = green[own + (w & ((1 << g) - 1))]
        kind = entry >> 4
        size = np.ones(kind.shape, np.int64)
        copy = (kind >= _COPY) & (kind < _HIT)
        after = here[:-1] + (entry & 15)
        size[copy], _ = _value(t, kind[copy] - _COPY, after[copy])
        total = np.cumsum(size, axis=0) + filled[active]
        final = total >= counts[active]
        last = np.where(final.any(axis=0), final.argmax(axis=0), STEPS - 1)
        k, c = np.nonzero(np.arange(STEPS)[:, None] <= last)
        found.append((active[c], after[k, c], kind[k, c], size[k, c]))
        column = np.arange(len(active))
        filled[active] = total[last, column]
        at[active] = t.check(rows[active], here[last + 1, column])
        active = active[~final.any(axis=0) & t.ok[rows[active]]]
    t.ok[rows[filled != counts]] = False

    base = np.cumsum(counts) - counts
    value = np.zeros(int(counts.sum()) + 1, np.uint32)  # the last stands for an empty slot of the cache
    if not found:
        return value[:-1], at
    of, after, kind, size = (np.concatenate(p) for p in zip(*found))
    keep = np.flatnonzero(t.ok[rows[of]])
    keep = keep[np.argsort(of[keep].astype(np.uint16), kind="stable")]
    of, after, kind, size = of[keep], after[keep], kind[keep], size[keep]
    ends = np.cumsum(size)
    starts = np.searchsorted(of, np.arange(n))
    first = base[of] + ends - size - np.concatenate([[0], ends])[starts][of]
    source = np.arange(len(value))
    plain = np.flatnonzero(kind < _COPY)
    place, colour = after[plain], kind[plain].astype(np.int64) << 8
    for (table, width), shift in zip(channels, (16, 0, 24)):
        entry = table[(of[plain] << width) + (t.ahead(place) & ((1 << width) - 1))].astype(np.int64)
        place = place + (entry & 15)
        colour |= entry >> 4 << shift
    value[first[plain]] = colour
    copies = np.flatnonzero((kind >= _COPY) & (kind < _HIT))
    if len(copies):
        _, p = _value(t, kind[copies] - _COPY, after[copies])
        entry = far[(of[copies] << f) + (t.ahead(p) & ((1 << f) - 1))]
        code, _ = _value(t, entry >> 4, p + (entry & 15))
        back = code - 120
        for width in np.unique(widths[of[copies]]).tolist():
            near = np.flatnonzero((widths[of[copies]] == width) & (code <= 120))
            back[near] = W._back(width)[0][code[near]]
        t.ok[rows[of[copies[back > first[copies] - base[of[copies]]]]]] = False
        length = size[copies]
        target = np.repeat(first[copies] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        source[target] = np.maximum(target - np.repeat(back, length), 0)
    hits = np.flatnonzero(kind >= _HIT)
    if len(hits):
        # Slots of all pixels are known without their values: a copy has the slot of what it copies.
        slot = np.zeros(len(value), np.uint16)
        shift = (32 - np.maximum(cache_bits, 1)[of[plain]]).astype(np.uint32)
        slot[first[plain]] = value[first[plain]] * np.uint32(W._CACHE_FACTOR) >> shift
        slot[first[hits]] = kind[hits] - _HIT
        slot = slot[W._roots(source)][:-1]
        image = np.repeat(np.arange(n, dtype=np.uint16), counts)
        order = np.argsort(slot, kind="stable")
        order = order[np.argsort(image[order], kind="stable")]
        slot, image = slot[order], image[order]
        before = np.full(len(order), len(order))
        before[order[1:]] = np.where((slot[1:] == slot[:-1]) & (image[1:] == image[:-1]), order[:-1], len(order))
        source[first[hits]] = before[first[hits]]
    return value[W._roots(source)][:-1], at


def _read_together(streams: list[bytes], palette: bool) -> list[np.ndarray | None]:
    """Pixels of images of one kind; None for those that cannot be read in this way."""
    t = _Streams(streams)
    rows = np.arange(len(streams))
    w = t.ahead(t.starts + 8)
    width = (w & 0x3FFF) + 1
    height = (t.ahead(t.starts + 22) & 0x3FFF) + 1
    at, inner, colours = t.starts + 41, width, []
    if palette:
        number = (t.ahead(t.starts + 43) & 255) + 1
        steps, at = _read_pixels(t, rows, t.starts + 51, number, number, False)
        for part in np.split(steps, np.cumsum(number)[:-1]):
            colours.append(W._numbers(np.cumsum(W._channels(part), axis=0, dtype=np.uint8)))
        t.ok[t.ahead(at) & 1 == 1] = False  # another transform
        at = t.check(rows, at + 1)
        packed = np.array([W._palette_bits(int(k)) for k in number])
        inner = (width + (1 << packed) - 1) >> packed
    counts = inner * height
    pixels, _ = _read_pixels(t, rows, at, inner, counts, True)
    out: list[np.ndarray | None] = []
    for k, part in enumerate(np.split(pixels, np.cumsum(counts)[:-1])):
        part = part.reshape(height[k], inner[k])
        out.append((W._from_palette(part, colours[k], int(width[k])) if palette else part) if t.ok[k] else None)
    return out


def decode_streams(streams: list[bytes]) -> list[np.ndarray]:
    """Pixels (height x width ARGB numbers) of lossless streams."""
    out: list[np.ndarray | None] = [None] * len(streams)
    kinds: dict[bool, list[tuple[int, int]]] = {False: [], True: []}
    for k, stream in enumerate(streams):
        head = int.from_bytes(stream[:8], "little")
        size = ((head >> 8 & 0x3FFF) + 1) * ((head >> 22 & 0x3FFF) + 1)
        transform = head >> 40 & 1
        if head & 255 == 0x2F and not head >> 37 & 7 and size <= MOST_PIXELS and (not transform or head >> 41 & 3 == W.PALETTE):
            kinds[bool(transform)].append((size, k))
    for palette, found in kinds.items():
        found.sort()  # images of about the same size end at about the same step
        for start in range(0, len(found), TOGETHER):
            part = [k for _, k in found[start : start + TOGETHER]]
            for k, pixels in zip(part, _read_together([streams[k] for k in part], palette)):
                out[k] = pixels
    return [W.decode_stream(stream) if pixels is None else pixels for stream, pixels in zip(streams, out)]
