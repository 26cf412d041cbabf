"""Lossless WebP (VP8L): a decoder of the whole format and an encoder of byte payloads.

``decode_webp`` reads any still lossless image: prefix codes in both forms, groups of codes
by a meta image, back-references with distance map, colour cache, and the predictor,
cross-colour, subtract-green and palette transforms. ``encode_many`` stores payloads, one
image each, with references at any distance, a colour cache and subtract-green where they shrink the image, and
prefix codes fitted to it. ``decode_many`` reads many such images in step: one array
operation reads the next symbol of all of them, and references and cached colours are put in for all pixels at
once. What it doesn't know it hands to ``decode_webp``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vgraph.llm.arrays import U64, chunks, lean, spans, utf8

# Fixed values of the format: the order of code length codes, and the (x, y) of short distances.
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
DISTANCES = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


class Bits:
    """A reader of bits, least significant first; zeros follow the end."""

    def __init__(self, data: bytes):
        self.value, self.at, self.size = int.from_bytes(data, "little"), 0, 8 * len(data)
        self.window, self.base = self.value & ((1 << 4096) - 1), 0

    def peek(self, n: int) -> int:
        if self.at + n - self.base > 4096:
            self.base = self.at
            self.window = self.value >> self.base & ((1 << 4096) - 1)
        return self.window >> (self.at - self.base) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        got = self.peek(n)
        self.at += n
        if self.at > self.size + 64:
            raise ValueError("the data end too soon")
        return got


class Code:
    """A canonical prefix code given by its lengths."""

    def __init__(self, lengths: list[int]):
        used = [s for s, n in enumerate(lengths) if n]
        self.single = used[0] if len(used) == 1 else None
        self.most = max(lengths, default=0)
        if not used:
            raise ValueError("a prefix code without symbols")
        if self.single is None and sum(1 << (15 - n) for n in lengths if n) != 1 << 15:
            raise ValueError("an incomplete prefix code")
        self.table: dict[tuple[int, int], int] = {}
        code = 0
        for n in range(1, self.most + 1):
            code <<= 1
            for s in used:
                if lengths[s] == n:
                    self.table[n, code] = s
                    code += 1

    def read(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        code = 0
        for n in range(1, self.most + 1):
            code = code << 1 | bits.read(1)
            found = self.table.get((n, code))
            if found is not None:
                return found
        raise ValueError("no such code")


def _read_code(bits: Bits, alphabet: int) -> Code:
    lengths = [0] * alphabet
    if bits.read(1):
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    order = [0] * 19
    for k in range(4 + bits.read(4)):
        order[CODE_ORDER[k]] = bits.read(3)
    how = Code(order)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, last = 0, 8
    while at < alphabet and left > 0:
        left -= 1
        s = how.read(bits)
        if s < 16:
            lengths[at] = s
            last, at = s or last, at + 1
            continue
        value, repeat = (last, 3 + bits.read(2)) if s == 16 else (0, 3 + bits.read(3)) if s == 17 else (0, 11 + bits.read(7))
        if at + repeat > alphabet:
            raise ValueError("code lengths beyond the alphabet")
        lengths[at : at + repeat] = [value] * repeat
        at += repeat
    return Code(lengths)


def _extent(bits: Bits, symbol: int) -> int:
    """A length or distance from its prefix symbol."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """The pixels of an entropy-coded image as 32-bit ARGB."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("too large a colour cache")
    cache = [0] * (1 << cache_bits if cache_bits else 0)
    meta, shift = None, 0
    if main and bits.read(1):
        shift = bits.read(3) + 2
        across = (width + (1 << shift) - 1) >> shift
        meta = (_image(bits, across, (height + (1 << shift) - 1) >> shift, False) >> 8 & 0xFFFF).reshape(-1, across)
    n_groups = 1 if meta is None else int(meta.max()) + 1
    groups = [[_read_code(bits, n) for n in (280 + len(cache), 256, 256, 256, 40)] for _ in range(n_groups)]
    out, total = [], width * height
    while len(out) < total:
        y, x = divmod(len(out), width)
        green, red, blue, alpha, far = groups[0 if meta is None else int(meta[y >> shift, x >> shift])]
        s = green.read(bits)
        begin = len(out)
        if s < 256:
            r, b = red.read(bits), blue.read(bits)
            out.append(alpha.read(bits) << 24 | r << 16 | s << 8 | b)
        elif s < 280:
            n, d = _extent(bits, s - 256), _extent(bits, far.read(bits))
            if d > 120:
                d -= 120
            else:
                dx, dy = DISTANCES[d - 1]
                d = max(1, dx + dy * width)
            if d > begin or begin + n > total:
                raise ValueError("a reference outside of the image")
            for _ in range(n):
                out.append(out[-d])
        else:
            out.append(cache[s - 280])
        if cache:
            for p in out[begin:]:
                cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
    return np.array(out, np.uint32)


def _channels(argb: np.ndarray) -> np.ndarray:
    """(n, 4) of A, R, G, B."""
    return np.stack([argb >> np.uint32(s) & np.uint32(255) for s in (24, 16, 8, 0)], -1).astype(np.int64)


def _predict(argb: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    h, w = argb.shape
    res, out = _channels(argb), np.zeros((h, w, 4), np.int64)
    clip = lambda v: np.clip(v, 0, 255)
    for y in range(h):
        for x in range(w):
            left = out[y, x - 1] if x else None
            if y == 0:
                p = np.array([255, 0, 0, 0]) if x == 0 else left
            elif x == 0:
                p = out[y - 1, 0]
            else:
                top, corner = out[y - 1, x], out[y - 1, x - 1]
                # at the right edge the pixel above to the right is the row's own first
                right = out[y - 1, x + 1] if x + 1 < w else out[y, 0]
                mode = int(modes[y >> shift, x >> shift])
                mean = lambda a, b: (a + b) >> 1
                if mode == 11:
                    guess = left + top - corner
                    p = left if np.abs(guess - left).sum() < np.abs(guess - top).sum() else top
                elif mode == 13:
                    m = mean(left, top)
                    d = m - corner
                    p = clip(m + np.where(d < 0, -(-d // 2), d // 2))
                else:
                    p = {0: lambda: np.array([255, 0, 0, 0]), 1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner, 5: lambda: mean(mean(left, right), top), 6: lambda: mean(left, corner), 7: lambda: mean(left, top), 8: lambda: mean(corner, top), 9: lambda: mean(top, right), 10: lambda: mean(mean(left, corner), mean(top, right)), 12: lambda: clip(left + top - corner)}.get(mode, lambda: np.array([255, 0, 0, 0]))()
            out[y, x] = (res[y, x] + p) & 255
    return _argb(out)


def _argb(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def _signed(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.int64) & 255 ^ 128) - 128


def _cross(argb: np.ndarray, factors: np.ndarray, shift: int) -> np.ndarray:
    h, w = argb.shape
    f = np.repeat(np.repeat(factors, 1 << shift, 0), 1 << shift, 1)[:h, :w]
    red_to_blue, green_to_blue, green_to_red = (_signed(f >> np.uint32(s)) for s in (16, 8, 0))
    c = _channels(argb)
    green = _signed(c[..., 2])
    c[..., 1] = c[..., 1] + (green_to_red * green >> 5) & 255
    c[..., 3] = c[..., 3] + (green_to_blue * green >> 5) + (red_to_blue * _signed(c[..., 1]) >> 5) & 255
    return _argb(c)


def decode_vp8l(data: bytes) -> np.ndarray:
    """(height, width) of 32-bit ARGB from a VP8L chunk's data."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("not VP8L")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    undo, across = [], width
    while bits.read(1):
        kind = bits.read(2)
        if any(k == kind for k, *_ in undo):
            raise ValueError("a transform given twice")
        if kind in (0, 1):
            shift = bits.read(3) + 2
            w, h = (across + (1 << shift) - 1) >> shift, (height + (1 << shift) - 1) >> shift
            undo.append((kind, shift, _image(bits, w, h, False).reshape(h, w)))
        elif kind == 2:
            undo.append((kind,))
        else:
            n = bits.read(8) + 1
            palette = _argb(np.cumsum(_channels(_image(bits, n, 1, False)), 0) & 255)
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, palette, pack, across))
            across = (across + (1 << pack) - 1) >> pack
    image = _image(bits, across, height, True).reshape(height, across)
    for kind, *rest in reversed(undo):
        if kind == 0:
            image = _predict(image, rest[1] >> np.uint32(8) & np.uint32(15), rest[0])
        elif kind == 1:
            image = _cross(image, rest[1], rest[0])
        elif kind == 2:
            c = _channels(image)
            c[..., [1, 3]] = c[..., [1, 3]] + c[..., 2:3] & 255
            image = _argb(c)
        else:
            palette, pack, w = rest
            index = image >> np.uint32(8) & np.uint32(255)
            if pack:
                width_bits = 8 >> pack
                steps = np.arange(1 << pack, dtype=np.uint32) * np.uint32(width_bits)
                index = (index[..., None] >> steps & np.uint32((1 << width_bits) - 1)).reshape(height, -1)[:, :w]
            known = np.append(palette, np.zeros(max(0, 256 - len(palette)), np.uint32))
            image = known[index]
    return image


def chunk_of(data: bytes) -> bytes:
    """The VP8L chunk of a WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not WebP")
    at = 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"VP8L":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image")


def decode_webp(data: bytes) -> np.ndarray:
    """(height, width, 4) of 8-bit R, G, B, A."""
    c = _channels(decode_vp8l(chunk_of(data)))
    return c[..., [1, 2, 3, 0]].astype(np.uint8)


# ---- many payloads, one image each: three bytes a pixel as G, R, B ----

#: Bytes a payload is a multiple of, and pixels they make.
UNIT, PIXELS, WIDEST = 576, 192, 16384
#: Equal pixels that are stored as a back-reference, at least and at most, and the farthest that one reaches.
LEAST_RUN, MOST_RUN, FARTHEST = 3, 4096, (1 << 20) - 120
#: Bits of the longest codes: of green values, lengths and cached colours; of red; of blue; of distances; of code lengths.
MOST_BITS, MOST_LENGTH_BITS = (11, 10, 10, 8), 7
#: Bits of the largest colour cache that is tried.
MOST_CACHE = 9
#: Bits that a cached colour is taken to add to the list of code lengths.
SLOT_BITS = 6
#: By how much code lengths are cut before they are rounded up, in 256ths of a bit; the best is taken, and the first always fits.
CUTS = (-256, 0, 32, 64, 96, 128, 160)
_LOGS = np.rint(256 * np.log2(np.maximum(np.arange(1 << 16), 1))).astype(np.int64)
_REVERSED = {m: np.array([int(f"{i:0{m}b}"[::-1], 2) for i in range(1 << m)]) for m in {*MOST_BITS, MOST_LENGTH_BITS}}


def _log(x: np.ndarray) -> np.ndarray:
    """256 log2 of whole numbers, as whole numbers, so that no order of sums shows."""
    k = np.where(x < 1 << 16, 0, np.where(x < 1 << 24, 8, 16))
    return _LOGS[x >> k] + 256 * k


def _information(hist: np.ndarray) -> np.ndarray:
    """By row the bits (in 256ths) that an ideal code takes for the counted symbols."""
    total = hist.sum(1)
    return total * _log(total) - (hist * _log(hist)).sum(1)


def _fit(hist: np.ndarray, most: int) -> np.ndarray:
    """(n, alphabet) of code lengths for counts: complete codes near the optimal ones, of at most so many bits.

    Lengths are ideal ones rounded up, and what room is left goes to the first symbols of each length. A row with one symbol gives it length 1, one without gives that to symbol 0.
    """
    n, alphabet = hist.shape
    ranked = np.sort(hist << 16 | (0xFFFF - np.arange(alphabet)), axis=1)[:, ::-1]
    used = (hist > 0).sum(1)
    ranked = ranked[:, : max(int(used.max(initial=0)), 1)]
    symbol, count = 0xFFFF - (ranked & 0xFFFF), ranked >> 16
    past = np.concatenate([np.zeros((n, 1), np.int64), np.cumsum(count, 1)], 1)
    ideal = _log(past[:, -1:]) - _log(count)
    sizes, rows = np.arange(1, most + 1), (most + 1) * np.arange(n)[:, None]
    best, least = np.zeros((n, most), np.int64), np.full(n, np.iinfo(np.int64).max)
    for cut in CUTS:
        length = np.where(count > 0, np.clip(-((cut - ideal) // 256), 1, most), 0)
        per = np.bincount((length + rows).ravel(), minlength=n * (most + 1)).reshape(n, most + 1)[:, 1:].copy()
        room = (1 << most) - (per << (most - sizes)).sum(1)
        fits = (room >= 0) & (used > 1)
        room[~fits] = 0
        while room.any():
            for k in range(1, most):
                more = np.minimum(per[:, k], room >> (most - 1 - k))
                per[:, k] -= more
                per[:, k - 1] += more
                room -= more << (most - 1 - k)
        ends = np.cumsum(per, 1)
        cost = ((np.take_along_axis(past, ends, 1) - np.take_along_axis(past, ends - per, 1)) * sizes).sum(1)
        better = fits & (cost < least)
        best[better], least[better] = per[better], cost[better]
    best[used < 2, 0] = 1
    per = np.concatenate([best, symbol.shape[1] - best.sum(1)[:, None]], 1)
    out = np.zeros((n, alphabet), np.int64)
    np.put_along_axis(out, symbol, np.repeat(np.tile(np.append(sizes, 0), n), per.ravel()).reshape(symbol.shape), 1)
    return out


def _canonical(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By row (symbols in the order of their codes, their lengths, the room of each among codes of most bits); room is 0 behind the last."""
    order = np.argsort(np.where(lengths > 0, lengths, 99).astype(np.uint8), axis=1, kind="stable")
    sizes = np.take_along_axis(lengths, order, 1)
    return order, sizes, np.where(sizes > 0, 1 << np.maximum(most - sizes, 0), 0)


def _codes(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, bits) to write for each symbol; the only symbol of a row takes no bits."""
    order, _, room = _canonical(lengths, most)
    codes = np.zeros_like(lengths)
    np.put_along_axis(codes, order, _REVERSED[most][(np.cumsum(room, 1) - room) & ((1 << most) - 1)], 1)
    return codes, np.where(((lengths > 0).sum(1) > 1)[:, None], lengths, 0)


def shape_of(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(width, height) that hold so many pixels: 192 wide, wider by whole rows where that is too high."""
    times = -(-pixels // (PIXELS * 16384))
    width = PIXELS * times
    if len(width) and width.max() > WIDEST:
        raise ValueError("the payload is too large for one image")
    return width, -(-pixels // width)


def _extent_symbols(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol from 0, extra bits, their number) of lengths or distances from 1."""
    v = value - 1
    top = np.frexp(np.maximum(v, 1).astype(np.float64))[1].astype(np.int64) - 1
    extra = np.where(v < 4, 0, top - 1)
    return np.where(v < 4, v, 2 * top + (v >> extra & 1)), v & ((1 << extra) - 1), extra


def _extents(symbol: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths or distances from 1, number of extra bits) of symbols and the bits behind them."""
    extra = np.where(symbol < 4, 0, symbol - 2 >> 1)
    return np.where(symbol < 4, symbol, (2 + (symbol & 1) << extra) + (window & ((1 << extra) - 1))) + 1, extra


def _near(width: int) -> np.ndarray:
    """The distances that codes 1 to 120 stand for in an image of this width."""
    return np.array([max(1, x + y * width) for x, y in DISTANCES])


def _matches(pixel: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first pixel, length, distance) of stretches that stood before in their image; none overlap.

    Each pixel looks for the nearest place before it at which the same three pixels begin; neighbours with one distance make a stretch.
    """
    at = np.flatnonzero(row[:-2] == row[2:])
    h = pixel[at].astype(U64) * U64(0x9E3779B97F4A7C15) + pixel[at + 1].astype(U64) * U64(0xC2B2AE3D27D4EB4F) + pixel[at + 2].astype(U64) * U64(0xD6E8FEB86659FD93) + row[at].astype(U64) * U64(0xA0761D6478BD642F)
    h = h & U64(0xFFFFFFFF00000000) | at.astype(U64)
    h.sort()
    place, same = (h & U64(0xFFFFFFFF)).astype(np.int64), (h[1:] ^ h[:-1]) < U64(1 << 32)
    i, j = place[1:][same], place[:-1][same]
    same = (row[i] == row[j]) & (i - j <= FARTHEST)
    for k in range(3):
        same &= pixel[i + k] == pixel[j + k]
    far = np.zeros(len(pixel) + 2, np.int64)
    far[i[same] + 1] = (i - j)[same]
    here = far[1:-1]
    first = np.flatnonzero((here > 0) & (here != far[:-2]))
    stop = np.flatnonzero((here > 0) & (here != far[2:])) + 3
    far = here[first]
    first = np.maximum(first, np.append(0, stop[:-1])[: len(stop)])
    length = stop - first
    first, length, far = (x[length >= LEAST_RUN] for x in (first, length, far))
    parts = -(-length // MOST_RUN)
    at = MOST_RUN * spans(np.zeros(len(parts), np.int64), parts)
    return np.repeat(first, parts) + at, np.minimum(np.repeat(length, parts) - at, MOST_RUN), np.repeat(far, parts)


def _slots(argb: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The places of colours in a cache."""
    return (0x1E35A7BD * (argb | 0xFF000000) & 0xFFFFFFFF) >> (32 - bits)


def _hits(argb: np.ndarray, row: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Whether the last pixel before in the image that went to the same place of the cache has the same colour."""
    key = (row << MOST_CACHE | slot) << 32 | np.arange(len(row))
    key.sort()
    place = key & 0xFFFFFFFF
    out = np.zeros(len(row), bool)
    out[place[1:]] = (key[1:] >> 32 == key[:-1] >> 32) & (argb[place[1:]] == argb[place[:-1]])
    return out


def _length_list(lengths: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, symbol, extra bits, their number) of the lists of code lengths, each as long as its alphabet, with runs of zeros as one symbol."""
    n, widest = lengths.shape
    row, value = np.repeat(np.arange(n), alphabet), lengths.ravel()[spans(np.arange(n) * widest, alphabet)]
    cut = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (value[1:] > 0) | (row[1:] != row[:-1])))
    size, row, value = np.diff(np.append(cut, len(value))), row[cut], value[cut]
    whole, rest = size // 138, size % 138
    times = np.where(value > 0, 1, whole + np.where(rest > 2, 1, rest))
    nth = spans(np.zeros(len(times), np.int64), times)
    row, value, whole, rest = (np.repeat(x, times) for x in (row, value, whole, rest))
    size = np.where(value > 0, 1, np.where(nth < whole, 138, np.where(rest > 2, rest, 1)))
    symbol = np.where(value > 0, value, np.where(size > 10, 18, np.where(size > 2, 17, 0)))
    return row, symbol, np.where(symbol == 18, size - 11, np.where(symbol == 17, size - 3, 0)), np.where(symbol == 18, 7, np.where(symbol == 17, 3, 0))


def _counts(row: np.ndarray, symbol: np.ndarray, n: int, alphabet: int) -> np.ndarray:
    return np.bincount(row * alphabet + symbol, minlength=n * alphabet).reshape(n, alphabet)


def encode_many(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Each payload, a positive multiple of 576 bytes, as a lossless WebP file; a larger image's last row is filled with zeros.

    Stretches that stood before become references; green is taken from red and blue, and colours come from a cache, in the images that shrink by it; prefix codes are fitted to each image.
    """
    n = len(offsets) - 1
    size = np.diff(offsets)
    width, height = shape_of(size // 3)
    full = width * height
    if (full * 3 != size).any():
        padded = np.append(0, np.cumsum(full * 3))
        wide = np.zeros(padded[-1], np.uint8)
        wide[spans(padded[:-1], size)] = data
        data, offsets = wide, padded
    row = np.repeat(np.arange(n), full)
    green, red, blue = (data[k::3].astype(np.int64) for k in range(3))
    first, length, far = _matches(green << 8 | red << 16 | blue, row)
    # what is written: pixels, and a length and a distance where a stretch begins that stood before
    keep = np.ones(len(row), bool)
    keep[spans(first, length)] = False
    plain = np.flatnonzero(keep)
    keep[first] = True
    gain = np.zeros(n, np.int64)
    for c in (red, blue):
        as_is, less = (_counts(row[plain], x & 255, n, 256) for x in (c[plain], c[plain] - green[plain]))
        gain += _information(as_is) - _information(less)
    less_green = gain > 0
    shift = green * less_green[row]
    red, blue = red - shift & 255, blue - shift & 255
    argb = red << 16 | green << 8 | blue
    cache = np.clip(np.frexp(full.astype(np.float64))[1] - 2, 1, MOST_CACHE)
    slot = _slots(argb, cache[row])
    hit = _hits(argb, row, slot)
    symbol, extra, n_extra = _extent_symbols(length)
    what = green.copy()
    what[first] = 256 + symbol
    literal = np.zeros(len(row), bool)
    literal[plain] = True
    widest = 280 + (1 << int(cache.max(initial=1)))
    cached = literal & hit
    tried = []
    for told in (what, np.where(cached, 280 + slot, what)):
        own = plain if told is what else np.flatnonzero(literal & ~hit)
        tried.append([_counts(row[keep], told[keep], n, widest), *(_counts(row[own], c[own], n, 256) for c in (red, blue))])
    without, within = (sum(_information(h) for h in hists) for hists in tried)
    use = within + 256 * SLOT_BITS * (tried[1][0][:, 280:] > 0).sum(1) < without
    hists = [np.where(use[:, None], b, a) for a, b in zip(*tried, strict=True)]
    cached &= use[row]
    what = np.where(cached, 280 + slot, what)
    literal &= ~cached
    # distances: the short codes where they reach, the others behind them
    code = far + 120
    for w in np.unique(width):
        near = _near(int(w))
        order = np.argsort(near, kind="stable")
        own = np.flatnonzero(width[row[first]] == w)
        at = np.minimum(np.searchsorted(near[order], far[own]), 119)
        code[own] = np.where(near[order][at] == far[own], order[at] + 1, code[own])
    far_symbol, far_extra, n_far_extra = _extent_symbols(code)
    hists.append(_counts(row[first], far_symbol, n, 40))
    lengths = [_fit(h, m) for h, m in zip(hists, MOST_BITS, strict=True)]
    # fields of bits in the order of the format, by image
    parts: list[tuple] = []
    every = np.arange(n)
    put = lambda image, value, bits: parts.append((image, value, np.broadcast_to(bits, image.shape)))
    put(every, 0x2F | width - 1 << 8 | height - 1 << 22, 40)  # no alpha, version 0
    put(every, np.where(less_green, 0b0101, 0), np.where(less_green, 4, 1))
    put(every, np.where(use, 1 | cache << 1, 0), np.where(use, 6, 2))  # then one group of codes
    for k, lens in enumerate(lengths):
        if k == 3:
            put(every, np.full(n, 0b101 | 255 << 3), 11)  # alpha: one symbol
        alphabet = np.where(use, 280 + (1 << cache), 280) if k == 0 else np.full(n, lens.shape[1])
        image, token, more, n_more = _length_list(lens, alphabet)
        how = _fit(_counts(image, token, n, 19), MOST_LENGTH_BITS)
        put(every, np.full(n, 15 << 1), 5)
        put(every, (how[:, CODE_ORDER] << 3 * np.arange(19)).sum(1), 58)  # the whole alphabet follows
        codes, bits = _codes(how, MOST_LENGTH_BITS)
        put(image, codes[image, token] | more << bits[image, token], bits[image, token] + n_more)
    codes = [_codes(x, m) for x, m in zip(lengths, MOST_BITS, strict=True)]
    told = np.flatnonzero(keep)
    value, total = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    value[told], total[told] = codes[0][0][row[told], what[told]], codes[0][1][row[told], what[told]]
    for at, k, bits, n_bits in ((first, None, extra, n_extra), (first, 3, far_symbol, None), (first, None, far_extra, n_far_extra), (np.flatnonzero(literal), 1, red, None), (np.flatnonzero(literal), 2, blue, None)):
        if k is not None:
            of = bits if k == 3 else bits[at]
            bits, n_bits = codes[k][0][row[at], of], codes[k][1][row[at], of]
        value[at] |= bits << total[at]
        total[at] += n_bits
    put(row[told], value[told], total[told])
    return _packed(n, *(np.concatenate(x) for x in zip(*parts, strict=True)))


def _packed(n: int, image: np.ndarray, value: np.ndarray, bits: np.ndarray) -> list[bytes]:
    """WebP files of fields of bits, which stand in order for each image."""
    order = np.argsort(image.astype(np.uint16) if n < 1 << 16 else image, kind="stable")
    image, value, bits = image[order], value[order].astype(U64), bits[order]
    ends = np.cumsum(bits)
    begin = np.append(0, ends[np.cumsum(np.bincount(image, minlength=n)) - 1])
    n_bytes = (np.diff(begin) + 7) // 8
    # each image's bits start at a word of their own
    n_words = (np.diff(begin) + 63) // 64 + 1
    first_word = np.cumsum(n_words) - n_words
    words = np.zeros(int(n_words.sum()) + 1, U64)
    at = ends - bits - begin[image] + 64 * first_word[image]
    word, shift = at >> 6, (at & 63).astype(U64)
    low = value << shift
    high = np.where(shift > 0, value >> ((U64(64) - shift) & U64(63)), U64(0))
    for index, part in ((word, low), (word + 1, high)):
        cut = np.flatnonzero(np.append(True, index[1:] != index[:-1]))
        words[index[cut]] |= np.bitwise_or.reduceat(part, cut)
    raw = words.astype("<u8").tobytes()
    out = []
    for a, b in zip((8 * first_word).tolist(), n_bytes.tolist(), strict=True):
        pad = b & 1
        out.append(b"RIFF" + (12 + b + pad).to_bytes(4, "little") + b"WEBPVP8L" + b.to_bytes(4, "little") + raw[a : a + b] + b"\0" * pad)
    return out


class _Step:
    """Bits of many images, read at a place of each one's own."""

    def __init__(self, raw: list[bytes]):
        size = np.array([len(x) for x in raw], np.int64)
        self.bytes = np.frombuffer(b"".join(raw) + b"\0" * 16, np.uint8)
        self.words = np.ndarray((len(self.bytes) - 7,), "<i8", self.bytes, 0, (1,))
        self.at = 8 * (np.cumsum(size) - size)

    def peek(self, at: np.ndarray) -> np.ndarray:
        """At least 57 bits, with any others above them."""
        return self.words[np.minimum(at >> 3, len(self.words) - 1)] >> (at & 7)

    def read(self, n: int | np.ndarray) -> np.ndarray:
        got = self.peek(self.at) & ((1 << n) - 1)
        self.at = self.at + n
        return got


def _table(lengths: np.ndarray, most: int, ok: np.ndarray) -> np.ndarray:
    """By the next bits of each image: 16 times the symbol, and the length of its code. Images with a code that is not complete are no longer ok."""
    one = (lengths > 0).sum(1) == 1
    fine = (lengths <= most).all(1)
    fine &= one | (np.where(lengths > 0, 1 << (most - np.minimum(lengths, most)), 0).sum(1) == 1 << most)
    ok &= fine
    lengths = np.where(fine[:, None], lengths, 0)
    lengths[~fine, :2] = 1
    order, sizes, room = _canonical(lengths, most)
    room[one & fine, 0] = 1 << most
    sizes[one & fine, 0] = 0
    return np.repeat((order << 4 | sizes).ravel().astype(np.int32), room.ravel()).reshape(len(ok), 1 << most)[:, _REVERSED[most]]


def _read_lengths(bits: _Step, ok: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """The code lengths of each image's alphabet from a code in normal form that names all of its symbols."""
    n, widest = len(ok), int(alphabet.max())
    ok &= bits.read(5) == 15 << 1
    how = np.zeros((n, 19), np.int64)
    how[:, CODE_ORDER] = bits.read(57)[:, None] >> 3 * np.arange(19) & 7
    ok &= bits.read(1) == 0
    table = _table(how, MOST_LENGTH_BITS, ok).ravel()
    out = np.zeros((n, widest + 138), np.int64)
    flat = out.ravel()
    image = np.flatnonzero(ok)
    where, to, last, base = bits.at[image], image * out.shape[1], image * out.shape[1] + alphabet[image], image << MOST_LENGTH_BITS
    while len(image):
        window = bits.peek(where)
        found = table[base + (window & 127)].astype(np.int64)
        token, used = found >> 4, found & 15
        window >>= used
        run = np.where(token == 18, 11 + (window & 127), np.where(token == 17, 3 + (window & 7), 1))
        flat[to] = np.where(token < 16, token, 0)
        where, to = where + used + np.where(token == 18, 7, np.where(token == 17, 3, 0)), to + run
        wrong = (token == 16) | (to > last)
        if wrong.any():
            ok[image[wrong]] = False
        live = (to < last) & ~wrong
        if not live.all():
            bits.at[image] = where
            image, where, to, last, base = (x[live] for x in (image, where, to, last, base))
    return out[:, :widest]


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """The bytes of each image as G, R, B of its pixels, row by row."""
    if not files:
        return []
    chunk = [chunk_of(x) for x in files]
    n = len(files)
    bits = _Step(chunk)
    end = bits.at + 8 * np.array([len(x) for x in chunk])
    ok = bits.read(8) == 0x2F
    width, height = bits.read(14) + 1, bits.read(14) + 1
    ok &= bits.read(4) == 0
    less_green = bits.read(1) == 1
    ok &= ~less_green | (bits.read(np.where(less_green, 3, 0)) == 0b010)
    use = bits.read(1) == 1
    cache = np.where(use, bits.read(np.where(use, 4, 0)), 0)
    ok &= (cache <= MOST_CACHE) & (use == (cache > 0)) & (bits.read(1) == 0)
    cache = np.where(ok, cache, 0)
    tables = [_table(_read_lengths(bits, ok, np.where(cache > 0, 280 + (1 << cache), 280) if k == 0 else np.full(n, 256)), MOST_BITS[k], ok).ravel() for k in range(3)]
    ok &= bits.read(11) == 0b101 | 255 << 3
    tables.append(_table(_read_lengths(bits, ok, np.full(n, 40)), MOST_BITS[3], ok).ravel())
    ok &= bits.at <= end
    pixels = np.where(ok, width * height, 0)
    begin = np.cumsum(pixels) - pixels
    # colours of pixels, and -1 less the place in the cache where they come from it; references are kept beside
    out = np.zeros(int(pixels.sum()), np.int32)
    refs = [np.zeros((4, 0), np.int64)]
    # images that are not at their end: number, places of the next bit, the next pixel and the one behind the last
    image = np.flatnonzero(pixels)
    where, to, last = bits.at[image], begin[image], (begin + pixels)[image]
    bases, masks = [image << m for m in MOST_BITS], [(1 << m) - 1 for m in MOST_BITS]
    bad = []
    while len(image):
        window = bits.peek(where)
        found = tables[0][bases[0] + (window & masks[0])]
        green, total = found >> 4, found & 15
        window >>= total
        found = tables[1][bases[1] + (window & masks[1])]
        argb, more = (found >> 4) << 16 | green << 8, found & 15
        found = tables[2][bases[2] + ((window >> more) & masks[2])]
        argb |= found >> 4
        more += found & 15
        other = np.flatnonzero(green > 255)
        step = 1
        if len(other):
            more[other] = 0
            kind = green[other]
            argb[other] = 279 - kind
            ref = other[kind < 280]
            if len(ref):
                rest = window[ref]
                length, used = _extents(green[ref] - 256, rest)
                rest >>= used
                found = tables[3][bases[3][ref] + (rest & masks[3])]
                far, n_far = _extents(found >> 4, rest >> (found & 15))
                more[ref] = used + (found & 15) + n_far
                refs.append(np.stack([image[ref], to[ref], length, far]))
                step = np.ones(len(image), np.int64)
                step[ref] = length
        out[to] = argb
        where += total + more
        to = to + step
        live = to < last
        if not live.all():
            bad += image[~live & ((where > end[image]) | (to > last))].tolist()
            image, where, to, last = (x[live] for x in (image, where, to, last))
            bases = [image << m for m in MOST_BITS]
    ok[bad] = False
    _resolved(out, np.concatenate(refs, 1), ok, begin, pixels, width, cache)
    result = []
    for i in range(n):
        if ok[i]:
            x = out[begin[i] : begin[i] + pixels[i]]
            green = x >> 8 & 255
            shift = green if less_green[i] else 0
            result.append(np.stack([green, (x >> 16) + shift & 255, x + shift & 255], 1).astype(np.uint8).ravel())
        else:
            result.append(decode_webp(files[i])[..., [1, 0, 2]].reshape(-1))
    return result


def _resolved(out: np.ndarray, refs: np.ndarray, ok: np.ndarray, begin: np.ndarray, pixels: np.ndarray, width: np.ndarray, cache: np.ndarray) -> None:
    """Puts the colours of references and of the cache into ``out``; images that have wrong ones are no longer ok.

    Each pixel points at the one it is a copy of. That tells the place in the cache of every pixel, as one that comes from the cache names its own; such a pixel
    points at the last one before it that went to its place. Pointers are followed by doubling.
    """
    image, to, length, far = refs
    widths, of_width = np.unique(width, return_inverse=True)
    near = np.stack([_near(int(w)) for w in widths])
    short = np.flatnonzero(far <= 120)
    low = near[of_width[image[short]], far[short] - 1]
    far = far - 120
    far[short] = low
    ok[image[far > to - begin[image]]] = False
    fine = ok[image]
    to, length, far = to[fine], length[fine], far[fine]
    nth = spans(np.zeros(len(length), np.int64), length)
    copies = np.repeat(to, length) + nth
    parent = np.arange(len(out))
    parent[copies] = np.repeat(to - far, length) + nth % np.repeat(far, length)
    todo = copies
    while len(todo):
        up = parent[parent[todo]]
        moved = up != parent[todo]
        parent[todo] = up
        todo = todo[moved]
    own = np.flatnonzero(ok & (cache > 0))
    row, place = np.repeat(own, pixels[own]), spans(begin[own], pixels[own])
    value = out[parent[place]].astype(np.int64)
    slot = np.where(value < 0, -1 - value, _slots(value, cache[row]))
    key = (row << MOST_CACHE | slot) << 32 | place
    key.sort()
    before = np.append(False, key[1:] >> 32 == key[:-1] >> 32)
    place = key & 0xFFFFFFFF
    hit = (out[place] < 0) & (parent[place] == place)
    ok[key[hit & ~before] >> 32 + MOST_CACHE] = False
    at = np.flatnonzero(hit & before)
    parent[place[at]] = parent[place[at - 1]]
    todo = np.flatnonzero(out[parent] < 0)
    todo = todo[np.repeat(ok, pixels)[todo]]
    while len(todo):
        parent[todo] = parent[parent[todo]]
        todo = todo[out[parent[todo]] < 0]
    out[:] = out[parent]


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with bytes 255 behind them up to a positive multiple of 576."""
    size = np.diff(offsets)
    full = np.maximum(-(-size // UNIT), 1) * UNIT
    at = np.append(0, np.cumsum(full))
    out = np.full(at[-1], 255, np.uint8)
    out[spans(at[:-1], size)] = data
    return out, at


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text, null as empty, as the pixels of a lossless WebP file.

    Three payload bytes make a pixel's green, red and blue; images are 192 pixels wide, or a multiple for
    payloads over 9 MB. A text of over 800 MB doesn't fit into an image and stops the run.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=1 << 20, rows=1000):
            data, offsets = utf8(batch.column("text"))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(np.diff(offsets)), "media": pa.array(encode_many(*padded(data, offsets)), pa.binary())})

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read(media: DataFrame, pixels: bool = True) -> DataFrame:
    """Decodes ``media`` (doc_id, n_bytes, media): adds payload (the pixel array) if asked for, digests and a feature.

    The feature names the image's size, mean and deviation of its samples and the
    share of distinct values. Rows whose media are null or no lossless WebP stop the run.
    """
    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("n_bytes").to_numpy()
            at = 0
            while at < batch.num_rows:
                to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at : at + 3000]), 12 << 20, "right")))
                part = batch.slice(at, to - at)
                at = to
                files = part.column("media").to_pylist()
                found = decode_many(files)
                rows = {"doc_id": part.column("doc_id"), "n_bytes": part.column("n_bytes")}
                # what a wide image holds beyond its payload is zeros
                n = part.column("n_bytes").to_numpy()
                full = np.maximum(-(-n // UNIT), 1) * UNIT
                payload = [x[:k].tobytes() for x, k in zip(found, full.tolist(), strict=True)]
                rows |= {"payload_bytes": pa.array(full), "payload_sha256": [hashlib.sha256(x).hexdigest() for x in payload], "tail_crc32": pa.array([zlib.crc32(x[-32:]) for x in payload], pa.int64())}
                rows |= {"media_bytes": pa.array([len(x) for x in files], pa.int64()), "media_sha256": [hashlib.sha256(x).hexdigest() for x in files], "feature": [_feature(x, k) for x, k in zip(found, full.tolist(), strict=True)]}
                if pixels:
                    rows["payload"] = pa.array(payload, pa.binary())
                yield pa.RecordBatch.from_pydict(rows)

    return media.mapInArrow(run, kinds + ", payload binary" * pixels)


def _feature(x: np.ndarray, n: int) -> str:
    counts = np.bincount(x[:n], minlength=256)
    values = np.arange(256)
    mean = float(counts @ values / n)
    spread = float(np.sqrt(max(0.0, counts @ (values.astype(float) ** 2) / n - mean**2)))
    return f"{n // 3}px mean={mean:.3f} std={spread:.3f} values={int((counts > 0).sum())}"
