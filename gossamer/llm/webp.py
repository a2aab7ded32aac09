"""Lossless WebP (VP8L): a complete decoder that works on many frames at once, and an encoder.

Frames of a batch are decoded in lockstep: each step takes one symbol group of every frame that is
not done, with numpy gathers into one table of all prefix codes, one bit buffer and one pixel
buffer. So the interpreter's cost is shared by all frames. A file holds one frame, or (a payload
over FRAME_PIXELS) an animation of frames that are decoded alike.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.session import bounded_batches, table, trimmed

# Fixed values of the format.
#: Order in which the lengths of the code length code are stored.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
#: Neighbours (x to the left, y up) that the distance codes 1 to 120 stand for.
NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
CACHE_MULTIPLIER = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3

MAX_BITS = 15
_ORDER = np.array(LENGTH_ORDER)
_NEAR = np.array([(0, 0), *NEAR], np.int64)


# -- bits and codes -------------------------------------------------------------------------------


class Bits:
    """Reads a frame's header, lowest bit first."""

    def __init__(self, raw: bytes, at: int = 0):
        self.raw, self.at = raw, at

    def take(self, n: int) -> int:
        first = self.at >> 3
        v = int.from_bytes(self.raw[first : (self.at + n + 7) >> 3], "little") >> (self.at & 7)
        self.at += n
        if self.at > 8 * len(self.raw):
            raise ValueError("the frame ends early")
        return v & ((1 << n) - 1)


#: Every number of 15 bits read backwards.
_REVERSED = sum(((np.arange(1 << MAX_BITS) >> i) & 1) << (MAX_BITS - 1 - i) for i in range(MAX_BITS))


def by_length(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols that have a code, their lengths) in the order of their codes."""
    used = np.nonzero(lengths)[0]
    used = used[np.argsort(lengths[used], kind="stable")]
    return used, lengths[used]


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes of a canonical prefix code, bits reversed so that they can be read from the low end."""
    codes = np.zeros(len(lengths), np.int64)
    used, n = by_length(lengths)
    share = 1 << (MAX_BITS - n)
    codes[used] = _REVERSED[(np.cumsum(share) - share) & ((1 << MAX_BITS) - 1)]
    return codes


_LOOKUPS: dict[bytes, tuple[np.ndarray, int]] = {}


def lookup(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """(table of symbol << 4 | length for every reading of ``width`` bits, width)."""
    key = lengths.astype(np.uint8).tobytes()
    got = _LOOKUPS.get(key)
    if got is not None:
        return got
    used = np.nonzero(lengths)[0]
    if len(used) <= 1:
        # one symbol takes no bits
        out = (np.array([int(used[0]) << 4 if len(used) else 0], np.int64), 0)
    else:
        width = int(lengths.max())
        if int((1 << (MAX_BITS - lengths[used].astype(np.int64))).sum()) != 1 << MAX_BITS:
            raise ValueError("a prefix code is not complete")
        used, n = by_length(lengths)
        t = np.repeat(used << 4 | n, 1 << (width - n))
        out = (t[_REVERSED[: 1 << width] >> (MAX_BITS - width)], width)
    if len(_LOOKUPS) > 500:
        _LOOKUPS.clear()
    _LOOKUPS[key] = out
    return out


def read_code(bits: Bits, size: int) -> np.ndarray:
    """Code lengths of one prefix code."""
    lengths = np.zeros(size, np.int64)
    if bits.take(1):
        n = bits.take(1) + 1
        first = bits.take(8 if bits.take(1) else 1)
        lengths[first] = 1
        if n == 2:
            lengths[bits.take(8)] = 1
        return lengths
    inner = np.zeros(19, np.int64)
    for i in range(4 + bits.take(4)):
        inner[LENGTH_ORDER[i]] = bits.take(3)
    limit = size
    if bits.take(1):
        limit = 2 + bits.take(2 + 2 * bits.take(3))
        if limit > size:
            raise ValueError("more code lengths than symbols")
    t, width = lookup(inner)
    t, mask = t.tolist(), (1 << width) - 1
    # a code length takes 14 bits at most
    first = bits.at >> 3
    v, p = int.from_bytes(bits.raw[first : first + 2 * size + 2], "little"), bits.at & 7
    out: list[int] = []
    before = 8
    # the next bits, in a small number
    near, left = 0, 0
    while len(out) < size and limit > 0:
        limit -= 1
        if left < 14:
            near, left = v >> p & 0xFFFFFFFFFFFFFF, 56
        entry = t[near & mask]
        n = entry & 15
        c = entry >> 4
        near >>= n
        if c < 16:
            out.append(c)
            before = c or before
            p += n
            left -= n
            continue
        if c == 16:
            out += [before] * (3 + (near & 3))
            more = 2
        elif c == 17:
            out += [0] * (3 + (near & 7))
            more = 3
        else:
            out += [0] * (11 + (near & 127))
            more = 7
        near >>= more
        p += n + more
        left -= n + more
        if len(out) > size:
            raise ValueError("a repeat leaves the code")
    bits.at = 8 * first + p
    if bits.at > 8 * len(bits.raw):
        raise ValueError("the frame ends early")
    lengths[: len(out)] = out
    return lengths


def read_codes(bits: Bits, sizes: list[int]) -> list[np.ndarray]:
    """The codes of a group; one that is written as the one before is not read again."""
    out: list[np.ndarray] = []
    n = v = 0
    for size in sizes:
        if out and size == len(out[-1]) and bits.at + n <= 8 * len(bits.raw):
            at = bits.at
            if bits.take(n) == v:
                out.append(out[-1])
                continue
            bits.at = at
        at = bits.at
        out.append(read_code(bits, size))
        n = bits.at - at
        bits.at = at
        v = bits.take(n)
    return out


# -- one entropy-coded image ----------------------------------------------------------------------


class Image:
    """The state of one image that is to be decoded: its size, codes, cache and place in the bits."""

    def __init__(self, raw: bytes, at: int, width: int, height: int, groups: list[list[np.ndarray]], meta: np.ndarray | None, meta_bits: int, cache_bits: int):
        self.raw, self.at, self.width, self.height = raw, at, width, height
        self.groups, self.meta, self.meta_bits, self.cache_bits = groups, meta, meta_bits, cache_bits


def read_image_header(bits: Bits, width: int, height: int, main: bool) -> Image:
    cache_bits = bits.take(4) if bits.take(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    meta, meta_bits, n_groups = None, 0, 1
    if main and bits.take(1):
        meta_bits = bits.take(3) + 2
        w, h = (width + (1 << meta_bits) - 1) >> meta_bits, (height + (1 << meta_bits) - 1) >> meta_bits
        inner = read_image(bits, w, h)
        meta = (inner >> 8) & 0xFFFF
        n_groups = int(meta.max()) + 1
    sizes = [256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40]
    groups = [read_codes(bits, sizes) for _ in range(n_groups)]
    return Image(bits.raw, bits.at, width, height, groups, meta, meta_bits, cache_bits)


def read_image(bits: Bits, width: int, height: int) -> np.ndarray:
    """An image within a frame (a transform's data or the map of prefix codes), decoded alone."""
    image = read_image_header(bits, width, height, False)
    pixels, ends = decode_images([image])
    bits.at = ends[0]
    return pixels[0]


def decode_images(images: list[Image]) -> tuple[list[np.ndarray], list[int]]:
    """ARGB pixels (uint32 in int64, row by row) of every image, decoded in lockstep."""
    k = len(images)
    # one table of all codes: five starts and widths for each group of each image
    tables: dict[int, tuple[int, int]] = {}
    parts: list[np.ndarray] = []
    size = 0
    first_group = np.zeros(k, np.int64)
    start, width = [], []
    for i, im in enumerate(images):
        first_group[i] = len(start)
        for g in im.groups:
            s5, w5 = [], []
            for lengths in g:
                if id(lengths) not in tables:
                    t, w = lookup(lengths)
                    tables[id(lengths)] = size, w
                    parts.append(t)
                    size += len(t)
                s5.append(tables[id(lengths)][0])
                w5.append(tables[id(lengths)][1])
            start.append(s5)
            width.append(w5)
    codes = np.concatenate(parts)
    start, mask = np.array(start, np.int64).ravel(), (1 << np.array(width, np.int64).ravel()) - 1
    raw = b"".join(im.raw + b"\0" * 8 for im in images)
    # the eight bytes from every byte on, aligned
    words = np.ndarray((len(raw) - 7,), "<i8", raw, 0, (1,)).copy()
    base = 8 * np.concatenate([[0], np.cumsum([len(im.raw) + 8 for im in images])[:-1]])
    limit = base + np.array([8 * len(im.raw) for im in images])
    at = base + np.array([im.at for im in images])
    n_pix = np.array([im.width * im.height for im in images], np.int64)
    origin = np.concatenate([[0], np.cumsum(n_pix)])
    out = np.zeros(int(origin[-1]), np.int64)
    wide = np.array([im.width for im in images], np.int64)
    cache_bits = np.array([im.cache_bits for im in images], np.int64)
    cache_at = np.concatenate([[0], np.cumsum(np.where(cache_bits > 0, 1 << cache_bits, 0))])
    cache = np.zeros(max(1, int(cache_at[-1])), np.int64)
    has_meta = np.array([im.meta is not None for im in images])
    metas = np.concatenate([im.meta if im.meta is not None else np.zeros(0, np.int64) for im in images])
    meta_at = np.concatenate([[0], np.cumsum([len(im.meta) if im.meta is not None else 0 for im in images])])
    meta_bits = np.array([im.meta_bits for im in images], np.int64)
    meta_wide = (wide + (1 << meta_bits) - 1) >> meta_bits
    any_meta = bool(has_meta.any())

    def take(i: np.ndarray, group: np.ndarray, which: int) -> np.ndarray:
        a = at.take(i)
        v = words.take(a >> 3)
        v >>= a & 7
        code = group * 5 + which
        v &= mask.take(code)
        v += start.take(code)
        e = codes.take(v)
        at[i] = a + (e & 15)
        return e >> 4

    def extra(i: np.ndarray, n: np.ndarray) -> np.ndarray:
        a = at.take(i)
        v = words.take(a >> 3) >> (a & 7) & ((1 << n) - 1)
        at[i] = a + n
        return v

    def prefix_value(i: np.ndarray, code: np.ndarray) -> np.ndarray:
        n = np.maximum((code - 2) >> 1, 0)
        return np.where(code < 4, code + 1, ((2 + (code & 1)) << n) + extra(i, n) + 1)

    def remember(i: np.ndarray, p: np.ndarray, argb: np.ndarray) -> None:
        b = cache_bits.take(i)
        on = b > 0
        if on.any():
            if not on.all():
                i, argb, b = i[on], argb[on], b[on]
            cache[cache_at[i] + (((argb * CACHE_MULTIPLIER) & 0xFFFFFFFF) >> (32 - b))] = argb

    pos = np.zeros(k, np.int64)
    copying = np.zeros(k, np.int64)
    distance = np.zeros(k, np.int64)
    live = np.nonzero(pos < n_pix)[0]
    while len(live):
        fresh = live[copying[live] == 0]
        if len(fresh):
            group = first_group[fresh]
            if any_meta:
                hm = has_meta[fresh]
                f = fresh[hm]
                y, x = pos[f] // wide[f], pos[f] % wide[f]
                group = group.copy()
                group[hm] += metas[meta_at[f] + (y >> meta_bits[f]) * meta_wide[f] + (x >> meta_bits[f])]
            green = take(fresh, group, 0)
            lit, cached = green < 256, green >= 280
            argb = np.empty(len(fresh), np.int64)
            i = fresh[lit]
            if len(i):
                g = group[lit]
                red, blue, alpha = take(i, g, 1), take(i, g, 2), take(i, g, 3)
                argb[lit] = alpha << 24 | red << 16 | green[lit] << 8 | blue
            i = fresh[cached]
            if len(i):
                argb[cached] = cache.take(cache_at.take(i) + green[cached] - 280)
            one = lit | cached
            i, argb = fresh[one], argb[one]
            if len(i):
                p = pos.take(i)
                out[origin.take(i) + p] = argb
                remember(i, p, argb)
                pos[i] = p + 1
            back = ~one
            i = fresh[back]
            if len(i):
                copying[i] = prefix_value(i, green[back] - 256)
                code = prefix_value(i, take(i, group[back], 4))
                near = _NEAR[np.minimum(code, 120)]
                dist = np.where(code > 120, code - 120, np.maximum(1, near[:, 0] + near[:, 1] * wide[i]))
                if (dist > pos[i]).any() or (pos[i] + copying[i] > n_pix[i]).any():
                    raise ValueError("a copy leaves the image")
                distance[i] = dist
            if (at[fresh] > limit[fresh]).any():
                raise ValueError("the frame ends early")
        i = live[copying[live] > 0]
        if len(i):
            # a stretch that ends before it starts to overlap itself is copied at once
            n = np.minimum(copying[i], distance[i])
            if len(i) <= 4 or int(n.min()) >= 8:
                for j, m, d in zip(i.tolist(), n.tolist(), distance[i].tolist()):
                    p = int(origin[j] + pos[j])
                    argb = out[p - d : p - d + m].copy()
                    out[p : p + m] = argb
                    if cache_bits[j]:
                        cache[cache_at[j] + (((argb * CACHE_MULTIPLIER) & 0xFFFFFFFF) >> (32 - int(cache_bits[j])))] = argb
                pos[i] += n
                copying[i] -= n
            else:
                p = origin[i] + pos[i]
                argb = out[p - distance[i]]
                out[p] = argb
                remember(i, pos[i], argb)
                pos[i] += 1
                copying[i] -= 1
        live = live[pos[live] < n_pix[live]]
    return [out[origin[i] : origin[i + 1]] for i in range(k)], (at - base).tolist()


# -- transforms -----------------------------------------------------------------------------------


def _planes(argb: np.ndarray) -> np.ndarray:
    return np.stack([(argb >> s) & 255 for s in (24, 16, 8, 0)], -1)


def _argb(planes: np.ndarray) -> np.ndarray:
    return planes[..., 0] << 24 | planes[..., 1] << 16 | planes[..., 2] << 8 | planes[..., 3]


def predicted(mode: int, left, top, corner, right) -> np.ndarray:
    """Prediction of a pixel (planes) from its left, top, top-left and top-right neighbours."""
    avg = lambda a, b: (a + b) >> 1
    if mode == 0:
        return np.broadcast_to(np.array([255, 0, 0, 0]), np.shape(top))
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return avg(avg(left, right), top)
    if mode == 6:
        return avg(left, corner)
    if mode == 7:
        return avg(left, top)
    if mode == 8:
        return avg(corner, top)
    if mode == 9:
        return avg(top, right)
    if mode == 10:
        return avg(avg(left, corner), avg(top, right))
    if mode == 11:
        guess = left + top - corner
        nearer = np.abs(guess - left).sum(-1) < np.abs(guess - top).sum(-1)
        return np.where(np.expand_dims(nearer, -1), left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        a = avg(left, top)
        return np.clip(a + np.trunc((a - corner) / 2).astype(np.int64), 0, 255)
    raise ValueError("no such predictor")


#: Predictors that do not look at the left neighbour: a row of them is one array operation.
_ROWWISE = {0, 2, 3, 4, 8, 9}


def predict(planes: np.ndarray, modes: np.ndarray, bits: int, inverse: bool) -> np.ndarray:
    """Add (inverse) or subtract the predictions; planes are rows x columns x 4."""
    h, w, _ = planes.shape
    src = planes
    out = planes.copy()
    ref = out if inverse else src
    sign = 1 if inverse else -1
    black = np.array([255, 0, 0, 0])
    out[0, 0] = (src[0, 0] + sign * black) & 255
    if inverse:
        # along the first row every pixel adds to the one before
        if w > 1:
            out[0] = np.cumsum(out[0], 0) & 255
        out[:, 0] = np.cumsum(np.concatenate([out[:1, 0], src[1:, 0]]), 0) & 255
    else:
        out[0, 1:] = (src[0, 1:] - src[0, :-1]) & 255
        out[1:, 0] = (src[1:, 0] - src[:-1, 0]) & 255
    for y in range(1, h):
        row_modes = modes[y >> bits, np.arange(w) >> bits]
        above = ref[y - 1]
        # the top-right neighbour of the last column is the first pixel of the row itself
        right = np.concatenate([above[1:], ref[y, :1]])
        x = 1
        while x < w:
            mode = int(row_modes[x])
            end = x + 1
            while end < w and row_modes[end] == mode:
                end += 1
            if mode in _ROWWISE or not inverse:
                p = predicted(mode, ref[y, x - 1 : end - 1], above[x:end], above[x - 1 : end - 1], right[x:end])
                out[y, x:end] = (src[y, x:end] + sign * p) & 255
            elif mode == 1:
                out[y, x:end] = (out[y, x - 1] + np.cumsum(src[y, x:end], 0)) & 255
            else:
                for c in range(x, end):
                    p = predicted(mode, out[y, c - 1], above[c], above[c - 1], right[c])
                    out[y, c] = (src[y, c] + p) & 255
            x = end
    return out


def cross_colour(planes: np.ndarray, data: np.ndarray, bits: int, inverse: bool) -> np.ndarray:
    h, w, _ = planes.shape
    signed = lambda v: ((v & 255) ^ 128) - 128
    block = data[np.arange(h)[:, None] >> bits, np.arange(w)[None, :] >> bits]
    red_to_blue, green_to_blue, green_to_red = signed(block >> 16), signed(block >> 8), signed(block)
    out = planes.copy()
    sign = 1 if inverse else -1
    green = signed(planes[..., 2])
    delta = lambda t, c: (t * c) >> 5
    out[..., 1] = (planes[..., 1] + sign * delta(green_to_red, green)) & 255
    red = out[..., 1] if inverse else planes[..., 1]
    out[..., 3] = (planes[..., 3] + sign * (delta(green_to_blue, green) + delta(red_to_blue, signed(red)))) & 255
    return out


def subtract_green(planes: np.ndarray, inverse: bool) -> np.ndarray:
    out = planes.copy()
    sign = 1 if inverse else -1
    out[..., 1] = (planes[..., 1] + sign * planes[..., 2]) & 255
    out[..., 3] = (planes[..., 3] + sign * planes[..., 2]) & 255
    return out


def palette_width_bits(n: int) -> int:
    return 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0


def unpack_palette(argb: np.ndarray, colours: np.ndarray, width: int, height: int) -> np.ndarray:
    wb = palette_width_bits(len(colours))
    green = ((argb >> 8) & 255).reshape(height, -1)
    x = np.arange(width)
    depth = 8 >> wb
    index = (green[:, x >> wb] >> ((x & ((1 << wb) - 1)) * depth)) & ((1 << depth) - 1)
    full = np.zeros(256, np.int64)
    full[: len(colours)] = colours
    return full[index]


# -- frames ---------------------------------------------------------------------------------------


#: Codes of frames without transforms that have been read: a frame that has the same bits there is not parsed again.
_HEADERS: dict[bytes, tuple[int, bytes, int, int, tuple]] = {}
_HEADERS_KEPT = 300


class Frame:
    """A frame whose header and transforms have been read; its main image is still coded."""

    def __init__(self, raw: bytes):
        # signature and size are the first five bytes
        got = _HEADERS.get(raw[5:37])
        if got is not None and len(raw) > 37 and raw[0] == 0x2F and not raw[4] >> 5:
            at, head, mask, tail, parsed = got
            if raw[5 : at >> 3] == head and (raw[at >> 3] if at >> 3 < len(raw) else 0) & mask == tail:
                v = int.from_bytes(raw[1:5], "little")
                self.width, self.height, self.has_alpha, self.transforms = (v & 0x3FFF) + 1, (v >> 14 & 0x3FFF) + 1, bool(v >> 28 & 1), []
                self.image = Image(raw, at, self.width, self.height, *parsed)
                return
        self._parse(raw)
        at, im = self.image.at, self.image
        if self.transforms or im.meta is not None or at >> 3 < 37:
            return
        if len(_HEADERS) >= _HEADERS_KEPT:
            _HEADERS.clear()
        mask = (1 << (at & 7)) - 1
        _HEADERS[raw[5:37]] = at, raw[5 : at >> 3], mask, (raw[at >> 3] if at >> 3 < len(raw) else 0) & mask, (im.groups, None, 0, im.cache_bits)

    def _parse(self, raw: bytes) -> None:
        bits = Bits(raw)
        if bits.take(8) != 0x2F:
            raise ValueError("not a lossless frame")
        self.width, self.height = bits.take(14) + 1, bits.take(14) + 1
        self.has_alpha = bool(bits.take(1))
        if bits.take(3):
            raise ValueError("unknown version")
        self.transforms: list[tuple] = []
        width, seen = self.width, set()
        while bits.take(1):
            kind = bits.take(2)
            if kind in seen:
                raise ValueError("a transform occurs twice")
            seen.add(kind)
            if kind in (PREDICTOR, CROSS_COLOUR):
                b = bits.take(3) + 2
                w, h = (width + (1 << b) - 1) >> b, (self.height + (1 << b) - 1) >> b
                self.transforms.append((kind, width, b, read_image(bits, w, h).reshape(h, w)))
            elif kind == SUBTRACT_GREEN:
                self.transforms.append((kind, width))
            else:
                n = bits.take(8) + 1
                steps = _planes(read_image(bits, n, 1))
                self.transforms.append((kind, width, _argb(np.cumsum(steps, 0) & 255)))
                wb = palette_width_bits(n)
                width = (width + (1 << wb) - 1) >> wb
        self.image = read_image_header(bits, width, self.height, True)

    def finish(self, argb: np.ndarray) -> np.ndarray:
        """ARGB rows of the frame from its decoded main image."""
        h = self.height
        for t in reversed(self.transforms):
            kind, w = t[0], t[1]
            if kind == PALETTE:
                argb = unpack_palette(argb, t[2], w, h).ravel()
                continue
            planes = _planes(argb.reshape(h, w))
            if kind == PREDICTOR:
                planes = predict(planes, (t[3] >> 8) & 15, t[2], True)
            elif kind == CROSS_COLOUR:
                planes = cross_colour(planes, t[3], t[2], True)
            else:
                planes = subtract_green(planes, True)
            argb = _argb(planes).ravel()
        return argb.reshape(h, self.width)


def chunks(raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
    while at + 8 <= end:
        n = int.from_bytes(raw[at + 4 : at + 8], "little")
        yield raw[at : at + 4], raw[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)


def frames_of(raw: bytes) -> list[bytes]:
    """The lossless frames of a file, in order."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    out = []
    for name, body in chunks(raw, 12, 8 + int.from_bytes(raw[4:8], "little")):
        if name == b"VP8L":
            out.append(body)
        elif name == b"ANMF":
            out += [b for n, b in chunks(body, 16, len(body)) if n == b"VP8L"]
    return out


def decode_files(files: list[bytes]) -> list[list[np.ndarray]]:
    """Frames (rows x columns of ARGB) of every file; all of them are decoded side by side."""
    frames = [[Frame(b) for b in frames_of(raw)] for raw in files]
    flat = [f for fs in frames for f in fs]
    pixels = decode_images([f.image for f in flat])[0] if flat else []
    done = iter([f.finish(p) for f, p in zip(flat, pixels)])
    return [[next(done) for _ in fs] for fs in frames]


# -- encoder --------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Huffman code lengths; counts are flattened until none exceeds the limit."""
    counts = counts.astype(np.int64)
    used = np.nonzero(counts)[0]
    out = np.zeros(len(counts), np.int64)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    while True:
        order = used[np.argsort(counts[used], kind="stable")]
        # leaves by weight, then the nodes as they are made: these come by weight, too
        leaves = counts[order].tolist()
        top = 1 + sum(leaves)
        leaves += [top, top]
        # nodes that are not yet made are heavier than any leaf
        nodes = [top] * (n + 1)
        leaf_of, node_of = [0] * n, [0] * n
        leaf = node = 0
        for new in range(n - 1):
            if leaves[leaf] <= nodes[node]:
                total = leaves[leaf]
                leaf_of[leaf] = new
                leaf += 1
            else:
                total = nodes[node]
                node_of[node] = new
                node += 1
            if leaves[leaf] <= nodes[node]:
                total += leaves[leaf]
                leaf_of[leaf] = new
                leaf += 1
            else:
                total += nodes[node]
                node_of[node] = new
                node += 1
            nodes[new] = total
        depth = [1] * (n - 1)
        for k in range(n - 3, -1, -1):
            depth[k] = depth[node_of[k]] + 1
        own = [depth[k] for k in leaf_of]
        if max(own) <= limit:
            out[order] = own
            return out
        counts[used] = (counts[used] + 1) // 2


class Writer:
    """Bits, lowest first."""

    def __init__(self):
        self.values: list[np.ndarray] = []
        self.widths: list[np.ndarray] = []

    def put(self, value: int, n: int) -> None:
        if n:
            self.many(np.array([value]), np.array([n]))

    def many(self, values: np.ndarray, widths: np.ndarray) -> None:
        self.values.append(np.asarray(values, np.int64).ravel())
        self.widths.append(np.asarray(widths, np.int64).ravel())

    def done(self) -> bytes:
        return joined(self.values, self.widths)


def joined(values: list[np.ndarray], widths: list[np.ndarray]) -> bytes:
    """The bits of values of given widths, up to 60, in a row."""
    n = np.concatenate([np.zeros(0, np.int64), *widths])
    v = (np.concatenate([np.zeros(0, np.int64), *values]) & ((1 << n) - 1)).astype(np.uint64)
    end = np.cumsum(n)
    if not len(n):
        return b""
    at = end - n
    cell, shift = at >> 6, (at & 63).astype(np.uint64)
    first = np.nonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))[0]
    out = np.zeros(int(end[-1]) // 64 + 2, np.uint64)
    out[cell[first]] = np.bitwise_or.reduceat(v << shift, first)
    out[cell[first] + 1] |= np.bitwise_or.reduceat(v >> np.uint64(1) >> (np.uint64(63) - shift), first)
    return out.astype("<u8").tobytes()[: (int(end[-1]) + 7) // 8]


#: Symbols of the runs of equal code lengths that have been written.
_RUNS: dict[tuple[int, int], list[int]] = {}


def run_symbols(v: int, run: int) -> list[int]:
    """Symbol, extra bits << 5 and their number << 12 that write the code length ``v`` so often."""
    symbols: list[tuple[int, int, int]] = []
    key = v, run
    if v == 0:
        while run >= 3:
            m = min(run, 138)
            symbols.append((18, m - 11, 7) if m >= 11 else (17, m - 3, 3))
            run -= m
    else:
        symbols.append((v, 0, 0))
        run -= 1
        while run >= 3:
            m = min(run, 6)
            symbols.append((16, m - 3, 2))
            run -= m
    symbols += [(v, 0, 0)] * run
    _RUNS[key] = [s | value << 5 | n << 12 for s, value, n in symbols]
    return _RUNS[key]


def write_code(w: Writer, lengths: np.ndarray) -> None:
    """One prefix code, in the short form for one or two small symbols."""
    used = np.nonzero(lengths)[0]
    if len(used) <= 2 and (not len(used) or used.max() < 256):
        used = used if len(used) else np.array([0])
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        wide = used[0] > 1
        w.put(int(wide), 1)
        w.put(int(used[0]), 8 if wide else 1)
        if len(used) == 2:
            w.put(int(used[1]), 8)
        return
    w.put(0, 1)
    symbols: list[int] = []
    edge = np.concatenate([[0], np.nonzero(lengths[1:] != lengths[:-1])[0] + 1, [len(lengths)]])
    for v, run in zip(lengths[edge[:-1]].tolist(), (edge[1:] - edge[:-1]).tolist()):
        symbols += _RUNS.get((v, run)) or run_symbols(v, run)
    packed = np.array(symbols)
    s, value, n = packed & 31, packed >> 5 & 127, packed >> 12
    inner = code_lengths(np.bincount(s, minlength=19), 7)
    in_order = inner[_ORDER]
    last = max(4, int(np.nonzero(in_order)[0][-1]) + 1)
    w.put(last - 4, 4)
    w.many(in_order[:last], np.full(last, 3))
    w.put(0, 1)
    codes = canonical(inner)
    if (inner > 0).sum() == 1:  # a lone symbol takes no bits when it is read
        inner = np.zeros(19, np.int64)
    w.many(np.stack([codes[s], value], 1), np.stack([inner[s], n], 1))


#: The prefix codes of all lengths, and of distances as long.
_PREFIXES: list[np.ndarray] = []


def prefix_code(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix symbol, extra bits, their number) of lengths or distances of 1 or more."""
    v = np.asarray(v, np.int64)
    if _PREFIXES and (not len(v) or v.max() < len(_PREFIXES[0])):
        return tuple(t.take(v) for t in _PREFIXES)
    v = v - 1
    high = np.floor(np.log2(np.maximum(v, 1))).astype(np.int64)
    second = (v >> np.maximum(high - 1, 0)) & 1
    code = np.where(v < 4, v, 2 * high + second)
    n = np.where(v < 4, 0, high - 1)
    return code, np.where(v < 4, 0, v & ((1 << np.maximum(n, 0)) - 1)), n


_PREFIXES += prefix_code(np.maximum(1, np.arange(1 << 13)))


class Codes:
    """Five prefix codes with what is needed to write symbols by them."""

    def __init__(self, lengths: list[np.ndarray]):
        self.lengths = lengths
        # codes of equal planes are made once
        made = {id(x): (canonical(x), x if np.count_nonzero(x) > 1 else np.zeros_like(x)) for x in lengths}
        self.codes, self.sizes = ([made[id(x)][j] for x in lengths] for j in range(2))


def own_codes(counts: list[np.ndarray], one: bool = False) -> Codes:
    """Codes by counts; ``one``: the planes red, blue and alpha have a code in common, by their sum."""
    if one:
        same = code_lengths(counts[1] + counts[2] + counts[3], OWN_BITS)
        return Codes([code_lengths(counts[0], OWN_BITS), same, same, same, code_lengths(counts[4], OWN_BITS)])
    return Codes([code_lengths(c, OWN_BITS) for c in counts])


def cache_index(argb: np.ndarray, bits: int) -> np.ndarray:
    return ((argb * CACHE_MULTIPLIER) & 0xFFFFFFFF) >> (32 - bits)


#: Pixels of a copy, at least, and at most.
LEAST_COPY, MOST_COPY = 3, 4096


def repeats(argb: np.ndarray, frame: np.ndarray) -> np.ndarray:
    """For every pixel the latest place before, in the same frame, where the same LEAST_COPY pixels start, or -1."""
    n = len(argb)
    out = np.full(n, -1, np.int64)
    m = n - LEAST_COPY + 1
    if m < 2:
        return out
    key = frame[:m].astype(np.uint64)
    for k in range(LEAST_COPY):
        key = (key ^ argb[k : m + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    at, before = order[1:][same], order[:-1][same]
    # hashes may clash, and a frame may end in between
    sure = (frame[at] == frame[before]) & (frame[at] == frame[at + LEAST_COPY - 1])
    for k in range(LEAST_COPY):
        sure &= argb[at + k] == argb[before + k]
    out[at[sure]] = before[sure]
    return out


def plan_symbols(argb: np.ndarray, cache_bits: int, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, kind, value, distance) of each symbol group: 0 literal, 1 cache (index), 2 copy (length).

    Every pixel goes through the cache, so a pixel is in it iff the last pixel of its slot equals it.
    A copy goes on from the latest place where its first pixels are; the first copy that is found is taken.
    """
    n = len(argb)
    before = repeats(argb, np.zeros(n, np.int64)) if before is None else before
    kind, value, distance = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    if cache_bits:
        slot = cache_index(argb, cache_bits)
        order = np.argsort(slot.astype(np.uint16), kind="stable")
        hit = np.zeros(n, bool)
        hit[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (argb[order[1:]] == argb[order[:-1]])
        kind[hit], value[hit] = 1, slot[hit]
    free = np.ones(n, bool)
    end = 0
    for at in np.nonzero(before >= 0)[0].tolist():
        if at < end:
            continue
        d = at - int(before[at])
        other = np.nonzero(argb[at : at + MOST_COPY] != argb[at - d : min(n, at + MOST_COPY) - d])[0]
        length = int(other[0]) if len(other) else min(MOST_COPY, n - at)
        kind[at], value[at], distance[at] = 2, length, d
        end = at + length
        free[at + 1 : end] = False
    place = np.nonzero(free)[0]
    return place, kind[place], value[place], distance[place]


_DISTANCES: dict[int, np.ndarray] = {}


def distance_codes(d: np.ndarray, width: int) -> np.ndarray:
    """The number that stands for each distance: that of a neighbour, or 120 more."""
    if width not in _DISTANCES:
        near = np.maximum(1, _NEAR[1:, 0] + _NEAR[1:, 1] * width)
        t = np.arange(int(near.max()) + 1) + 120
        for code in range(120, 0, -1):
            t[near[code - 1]] = code
        _DISTANCES[width] = t
    t = _DISTANCES[width]
    return np.where(d < len(t), t[np.minimum(d, len(t) - 1)], d + 120)


class Groups:
    """The symbol groups of an image: the symbols of the five codes (those of a literal, a cached pixel, a copy) and their extra bits."""

    def __init__(self, argb: np.ndarray, cache_bits: int, width: int, before: np.ndarray | None = None):
        self.place, kind, value, distance = plan_symbols(argb, cache_bits, before)
        px = argb[self.place]
        self.lit, self.back = kind == 0, kind == 2
        self.lit, self.back = np.nonzero(self.lit)[0], np.nonzero(self.back)[0]
        self.green = np.where(kind == 0, (px >> 8) & 255, 280 + value)
        q = px[self.lit]
        self.planes = [(q >> 16) & 255, q & 255, q >> 24]
        run, self.extra, self.n_extra = prefix_code(value[self.back])
        self.green[self.back] = 256 + run
        self.dist, self.far, self.n_far = prefix_code(distance_codes(distance[self.back], width))

    def counts(self, sizes: list[int], of: np.ndarray | None = None) -> list[np.ndarray]:
        """How often each symbol of each code occurs, in all groups or those marked in ``of``."""
        lit, back = (slice(None), slice(None)) if of is None else (of[self.lit], of[self.back])
        all_ = [self.green if of is None else self.green[of], *(p[lit] for p in self.planes), self.dist[back]]
        return [np.bincount(x, minlength=n) for x, n in zip(all_, sizes)]

    def words(self, codes: list[Codes], group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(bits, number of bits) of each symbol group under its group's codes; up to 60 bits."""
        word, size = np.zeros(len(self.place), np.int64), np.zeros(len(self.place), np.int64)

        def put(at: np.ndarray | slice, v: np.ndarray, n: np.ndarray) -> None:
            word[at] |= v << size[at]
            size[at] += n

        def code(which: int, symbols: np.ndarray, at: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
            if len(codes) == 1:
                return codes[0].codes[which][symbols], codes[0].sizes[which][symbols]
            g = group[at]
            return tuple(np.stack([x[which] for x in y])[g, symbols] for y in ([c.codes for c in codes], [c.sizes for c in codes]))

        put(slice(None), *code(0, self.green, slice(None)))
        for j, p in enumerate(self.planes):
            put(self.lit, *code(j + 1, p, self.lit))
        put(self.back, self.extra, self.n_extra)
        put(self.back, *code(4, self.dist, self.back))
        put(self.back, self.far, self.n_far)
        return word, size


def symbol_sizes(cache_bits: int) -> list[int]:
    return [280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40]


def write_image(w: Writer, argb: np.ndarray, cache_bits: int, main: bool, codes: Codes | None = None, width: int = 1 << 14, split: tuple[int, np.ndarray] | None = None, groups: Groups | None = None, one: bool = False) -> None:
    """An entropy-coded image with literals, colour cache and copies.

    With ``split`` (bits of a block, group of each block) it has codes of its own for every group of blocks.
    """
    groups = groups or Groups(argb, cache_bits, width)
    sizes, own = symbol_sizes(cache_bits), None
    if split is not None:
        y, x = np.divmod(groups.place, width)
        own = split[1][y >> split[0], x >> split[0]]
        used = [own_codes(groups.counts(sizes, own == g), one) for g in range(int(split[1].max()) + 1)]
    else:
        used = [codes or own_codes(groups.counts(sizes), one)]
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(int(split is not None), 1)
        if split is not None:
            w.put(split[0] - 2, 3)
            write_image(w, (0xFF000000 | split[1] << 8).ravel(), 0, False, width=split[1].shape[1])
    for c in used:
        before = None
        for x in c.lengths:
            if x is not before:
                one_code = Writer()
                write_code(one_code, x)
                before = x
            w.values += one_code.values
            w.widths += one_code.widths
    w.many(*groups.words(used, own))


def encode_frame(argb: np.ndarray, cache_bits: int = 6, transforms: tuple[int, ...] = (), mode: int = 11, codes: Codes | None = None, block_bits: int = 3, crossed: int = 0xFF05FA09, split: tuple[int, np.ndarray] | None = None) -> bytes:
    """One VP8L frame of a rows x columns ARGB array; ``crossed`` is the pixel of a cross-colour image."""
    h, width = argb.shape
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(h - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    flat = argb.astype(np.int64)
    for t in transforms:
        w.put(1, 1)
        w.put(t, 2)
        wide = flat.shape[1]
        bw, bh = (wide + (1 << block_bits) - 1) >> block_bits, (h + (1 << block_bits) - 1) >> block_bits
        if t == PREDICTOR:
            modes = (np.arange(bw * bh).reshape(bh, bw) + mode) % 14 if mode < 0 else np.full((bh, bw), mode)
            w.put(block_bits - 2, 3)
            write_image(w, (0xFF000000 | modes << 8).ravel(), 0, False)
            flat = _argb(predict(_planes(flat), modes, block_bits, False))
        elif t == CROSS_COLOUR:
            data = np.full((bh, bw), crossed)
            w.put(block_bits - 2, 3)
            write_image(w, data.ravel(), 0, False)
            flat = _argb(cross_colour(_planes(flat), data, block_bits, False))
        elif t == SUBTRACT_GREEN:
            flat = _argb(subtract_green(_planes(flat), False))
        else:
            colours = np.unique(flat)
            if len(colours) > 256:
                raise ValueError("too many colours for a palette")
            w.put(len(colours) - 1, 8)
            steps = _planes(colours)
            steps[1:] = (steps[1:] - steps[:-1]) & 255
            write_image(w, _argb(steps), 0, False)
            wb = palette_width_bits(len(colours))
            depth = 8 >> wb
            index = np.searchsorted(colours, flat)
            index = np.pad(index, ((0, 0), (0, -wide % (1 << wb))))
            packed = (index.reshape(h, -1, 1 << wb) << (np.arange(1 << wb) * depth)).sum(-1)
            flat = 0xFF000000 | packed << 8
    w.put(0, 1)
    write_image(w, flat.ravel(), cache_bits, True, codes, flat.shape[1], split)
    return w.done()


def riff(frames: list[tuple[bytes, int, int]]) -> bytes:
    """A file of one frame, or an animation of several."""

    def chunk(name: bytes, body: bytes) -> bytes:
        return name + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)

    if len(frames) == 1:
        body = chunk(b"VP8L", frames[0][0])
    else:
        w, h = max(f[1] for f in frames), max(f[2] for f in frames)
        size = lambda x, y: (x - 1).to_bytes(3, "little") + (y - 1).to_bytes(3, "little")
        body = chunk(b"VP8X", bytes([0x12, 0, 0, 0]) + size(w, h)) + chunk(b"ANIM", bytes(6))
        for raw, x, y in frames:
            body += chunk(b"ANMF", bytes(6) + size(x, y) + (100).to_bytes(3, "little") + b"\x02" + chunk(b"VP8L", raw))
    return b"RIFF" + (4 + len(body)).to_bytes(4, "little") + b"WEBP" + body


# -- payloads -------------------------------------------------------------------------------------

#: Pixels of a row of a stored payload (64 bytes), and of a frame at most.
ROW_PIXELS = 16
FRAME_PIXELS = 1 << 11
CACHE_BITS = 7
#: Longest codes that are made for a frame.
OWN_BITS = 11
#: The text codes are kept unless another way saves a tenth of their bits: a code of its own costs more time than the frame.
SAVES = 1 / 0.9
#: Frames that are planned side by side.
PLANNED = 512


def _text_codes() -> Codes:
    """Codes for UTF-8 text by a rule: common letters short, other text longer, the rest long."""
    weight = np.full(256, 1, np.int64)
    weight[128:256] = 6
    weight[0] = 12
    weight[33:127] = 14
    weight[97:123] = 260
    for c in b"aeinorst":
        weight[c] = 900
    weight[32] = 1800
    weight[[10, 44, 46]] = 90
    green = np.concatenate([weight, np.full(24, 4), np.full(1 << CACHE_BITS, 6)])
    # a cache symbol stands for four bytes
    return Codes([code_lengths(x) for x in (green, weight, weight, weight, np.array([4, 400] + [4] * 38))])


_TEXT: Codes | None = None
_HEAD: list[tuple[np.ndarray, np.ndarray]] = []


def text_codes() -> Codes:
    global _TEXT
    if _TEXT is None:
        _TEXT = _text_codes()
    return _TEXT


def _head() -> tuple[np.ndarray, np.ndarray]:
    """(values, widths) of everything between the size and the pixels of a frame in the text codes."""
    if not _HEAD:
        w = Writer()
        w.put(0, 1)
        w.put(1, 1)
        w.put(CACHE_BITS, 4)
        w.put(0, 1)
        for x in text_codes().lengths:
            write_code(w, x)
        n, raw = int(np.concatenate(w.widths).sum()), w.done()
        v = np.array([int.from_bytes(raw[i : i + 6], "little") for i in range(0, len(raw), 6)])
        _HEAD.append((v, np.minimum(48, n - 48 * np.arange(len(v)))))
    return _HEAD[0]


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    # the least multiple of 64 that holds the text, 64 for none
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw)), len(raw)


_XLOG = np.arange(3 * FRAME_PIXELS + 1) * np.log2(np.maximum(np.arange(3 * FRAME_PIXELS + 1), 1))


def entropy(counts: np.ndarray) -> np.ndarray:
    """Bits of symbols that occur so often (last axis), and of a code for them: about 5 for each."""
    return _XLOG[counts.sum(-1)] - _XLOG[counts].sum(-1) + 5 * np.count_nonzero(counts, -1)


def plane_counts(planes: list[np.ndarray], frame: np.ndarray, n: int) -> np.ndarray:
    """How often each byte occurs in each plane of each frame: n x 4 x 256."""
    first = frame << 8
    return np.stack([np.bincount(first + p, minlength=n << 8).reshape(n, 256) for p in planes], 1)


def byte_planes(px: np.ndarray) -> list[np.ndarray]:
    """Alpha, red, green and blue of pixels, as bytes, whose sums and differences wrap around."""
    return list(np.ascontiguousarray(px.view(np.uint8).reshape(-1, 4).T[::-1]))


def choices(px: np.ndarray, frame: np.ndarray, start: np.ndarray, before: np.ndarray) -> list[tuple]:
    """(way, argument, bits) of each frame: the transform, or none with the text codes or its own, for which the
    fewest bits are expected.

    The bits of a way are the entropy of its four planes with the codes' size (of pixels that no copy covers), or, for the text codes, their
    lengths; of a palette the entropy of its indices and 22 bits a colour.
    """
    n = len(start) - 1
    first = np.arange(len(px)) - start[:-1][frame]
    y, x = first // ROW_PIXELS, first % ROW_PIXELS
    # what a copy repeats costs about the same in any way
    alone = np.ones(len(px), bool)
    for k in range(LEAST_COPY):
        alone[np.nonzero(before >= 0)[0] + k] = False
    of = frame[alone]
    whole = px.astype("<u4")
    planes = a, r, g, b = byte_planes(whole[alone])
    counts = plane_counts(planes, of, n)
    same = entropy(counts[:, 0]) + entropy(counts[:, 2])
    three = counts[:, 0] + counts[:, 1] + counts[:, 3]
    sizes = text_codes().sizes
    cost = {"text": (counts * np.stack([sizes[3], sizes[1], sizes[0][:256], sizes[2]])).sum((1, 2)), "own": entropy(counts[:, 2]) + entropy(three) + 10 * np.count_nonzero(three, 1) + 100}
    cost[SUBTRACT_GREEN] = same + entropy(plane_counts([r - g, b - g], of, n)).sum(1) + 100
    # multipliers by least squares
    sg, sr, sb = (v.view(np.int8).astype(np.int64) for v in (g, r, b))
    square = np.maximum(1, np.bincount(of, sg * sg, n))
    times = [np.clip(np.rint(32 * np.bincount(of, sg * v, n) / square), -128, 127).astype(np.int64) for v in (sr, sb)]
    cost[CROSS_COLOUR] = same + entropy(plane_counts([v - (t.take(of) * sg >> 5).astype(np.uint8) for v, t in zip((r, b), times)], of, n)).sum(1) + 150
    black = np.uint32(0xFF000000)
    shifted = lambda k: np.concatenate([np.full(min(k, len(px)), black), whole[:-k]])
    left, top = shifted(1), shifted(ROW_PIXELS)
    edge = np.where(y == 0, np.where(x == 0, black, left), top)
    at_edge = (y == 0) | (x == 0)
    own = byte_planes(whole)
    # the mean of four bytes at once
    modes = {1: left, 2: top, 7: (left & top) + (((left ^ top) & np.uint32(0xFEFEFEFE)) >> np.uint32(1))}
    for mode, guess in modes.items():
        rest = [(p - q)[alone] for p, q in zip(own, byte_planes(np.where(at_edge, edge, guess)))]
        cost[PREDICTOR, mode] = entropy(plane_counts(rest, of, n)).sum(1) + 120
    # colours: pixels in order, frame by frame
    colour = np.sort(frame << 32 | px)
    new = np.concatenate([[True], colour[1:] != colour[:-1]])
    at = np.nonzero(new)[0]
    often = np.diff(np.append(at, len(colour)))
    where = frame[at]
    n_colours = np.bincount(where, minlength=n)
    indices = _XLOG[np.diff(start)] - np.bincount(where, _XLOG[often], n)
    # pixels that copies cover are indices, too: a palette is compared with all pixels in the other ways
    share = np.diff(start) / np.maximum(1, np.bincount(of, minlength=n))
    cost[PALETTE] = np.where(n_colours <= 256, (indices + 5 * n_colours) / np.maximum(share, 1) + 22 * n_colours + 200, np.inf)
    ways = list(cost)
    bits = np.stack([cost[k] for k in ways])
    bits[1:] *= SAVES
    best = np.argmin(bits, 0).tolist()
    out = []
    for f, k in enumerate(best):
        way, argument = ways[k] if isinstance(ways[k], tuple) else (ways[k], None)
        if way == CROSS_COLOUR:
            argument = 0xFF000000 | (int(times[1][f]) & 255) << 8 | int(times[0][f]) & 255
        out.append((way, argument, float(cost[ways[k]][f])))
    return out


#: A block of the map of code groups has so many rows (and all columns).
SPLIT_BITS = 5


def split_of(groups: Groups, height: int) -> tuple[tuple[int, np.ndarray] | None, float]:
    """Where a frame is better cut in two, with codes for either part: the map of its blocks; and the bits expected."""
    blocks = (height + (1 << SPLIT_BITS) - 1) >> SPLIT_BITS
    if blocks < 2:
        return None, math.inf
    block = groups.place // ROW_PIXELS >> SPLIT_BITS
    sizes = symbol_sizes(CACHE_BITS)
    parts = []
    for k in range(blocks):
        c = groups.counts(sizes, block == k)
        parts.append(np.concatenate([c[0], c[1] + c[2] + c[3], c[4]]))
    sums = np.cumsum(parts, 0)
    ends = [0, sizes[0], sizes[0] + 256, sums.shape[1]]
    # the code of three planes is written three times
    bits = lambda c: sum(entropy(c[:, x:y]) for x, y in zip(ends, ends[1:])) + 10 * np.count_nonzero(c[:, ends[1] : ends[2]], 1)
    both = bits(np.concatenate([sums, sums[-1] - sums[:-1]]))
    cost = both[: blocks - 1] + both[blocks:] + 60
    k = int(np.argmin(cost)) + 1
    if cost[k - 1] >= both[blocks - 1]:
        return None, float(both[blocks - 1])
    return (SPLIT_BITS, (np.arange(blocks)[:, None] >= k).astype(np.int64)), float(cost[k - 1])


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """Each payload as a WebP file: four bytes a pixel in the order alpha, red, green, blue.

    Every frame takes the way that is expected to be the shortest: predictor, cross-colour, subtract-green, palette or no
    transform; the text codes or codes by its own counts, for the whole or for two parts of it; and copies and
    the colour cache in each of them.
    """
    frames: list[list[tuple[bytes, int, int]]] = [[] for _ in payloads]
    todo = [(i, np.frombuffer(p, ">u4", min(FRAME_PIXELS, len(p) // 4 - at), 4 * at).astype(np.int64)) for i, p in enumerate(payloads) for at in range(0, len(p) // 4, FRAME_PIXELS)]
    for at in range(0, len(todo), PLANNED):
        some = todo[at : at + PLANNED]
        start = np.cumsum([0, *(len(p) for _, p in some)])
        px, frame = np.concatenate([p for _, p in some]), np.repeat(np.arange(len(some)), np.diff(start))
        before = repeats(px, frame)
        for (i, p), s, way in zip(some, start.tolist(), choices(px, frame, start, before)):
            own = before[s : s + len(p)]
            frames[i].append((encode_way(p, np.where(own >= 0, own - s, -1), *way), ROW_PIXELS, len(p) // ROW_PIXELS))
    return [riff(f) for f in frames]


def encode_way(px: np.ndarray, before: np.ndarray, way: str | int, argument: int | None = None, bits: float = 0.0) -> bytes:
    """A frame by one of ``choices``; where two parts with own codes are expected to be shorter than a transform, by these."""
    height = len(px) // ROW_PIXELS
    if way in (PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN):
        split, less = split_of(Groups(px, CACHE_BITS, ROW_PIXELS, before), height)
        way = "own" if split is not None and less < bits else way
    if way == PALETTE:
        return encode_frame(px.reshape(height, ROW_PIXELS), 0, (PALETTE,))
    if way == PREDICTOR:
        return encode_frame(px.reshape(height, ROW_PIXELS), CACHE_BITS, (PREDICTOR,), argument, block_bits=6)
    if way == CROSS_COLOUR:
        return encode_frame(px.reshape(height, ROW_PIXELS), CACHE_BITS, (CROSS_COLOUR,), block_bits=6, crossed=argument)
    if way == SUBTRACT_GREEN:
        return encode_frame(px.reshape(height, ROW_PIXELS), CACHE_BITS, (SUBTRACT_GREEN,))
    groups = Groups(px, CACHE_BITS, ROW_PIXELS, before)
    head = Writer()
    head.many(np.array([0x2F, ROW_PIXELS - 1, height - 1, 1, 0]), np.array([8, 14, 14, 1, 3]))
    if way == "text":
        head.many(*_head())
        head.many(*groups.words([text_codes()]))
        return head.done()
    head.put(0, 1)
    write_image(head, px, CACHE_BITS, True, None, ROW_PIXELS, split_of(groups, height)[0], groups, True)
    return head.done()


def payload_from(frames: list[np.ndarray]) -> bytes:
    return b"".join(f.astype(">u4").tobytes() for f in frames)


MEDIA = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
#: Files of about so many bytes of payload are encoded and decoded side by side.
BATCH_BYTES = 6 << 20
#: Files that are encoded and decoded side by side at most.
BATCH_FILES = 4000


def payload_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[tuple[bytes, int]]]]:
    """(ids, payloads) of about BATCH_BYTES and at most BATCH_FILES rows, across Arrow batches: a step over many frames costs little more than over few."""
    ids: list[pa.Array] = []
    todo: list[tuple[bytes, int]] = []
    size = 0
    for b in batches:
        at = 0
        for k, text in enumerate(b.column(1).to_pylist(), 1):
            todo.append(payload_of(text))
            size += len(todo[-1][0])
            if size >= BATCH_BYTES or len(todo) == BATCH_FILES:
                yield pa.concat_arrays([*ids, b.column(0).slice(at, k - at)]), todo
                ids, todo, size, at = [], [], 0, k
        ids.append(b.column(0).slice(at))
    if todo:
        yield pa.concat_arrays(ids), todo


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Store each whole text as a WebP file, read the stored bytes back and describe them.

    Null texts are empty; the payload is the text in UTF-8 and zeros up to the least positive multiple of
    64 bytes that holds it. Rows keep their ids as they are (null, repeated); equal texts give equal values; an
    empty table gives an empty one; no column but id and text is looked at or returned. The
    feature is the mean of each channel and the number of distinct pixels, as read back. With
    ``keep_media`` the file is returned as ``media``. One narrow pass, whatever the texts' lengths.
    """
    bounded_batches(docs.sparkSession)
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, todo in payload_batches(batches):
            files = encode_payloads([p for p, _ in todo])
            rows = []
            for (_, n), raw, frames in zip(todo, files, decode_files(files)):
                back = payload_from(frames)
                planes = np.frombuffer(back, np.uint8).reshape(-1, 4)
                means = [planes[:, c].sum(dtype=np.int64) / len(planes) for c in range(4)]
                colours = np.sort(np.frombuffer(back, "<u4"))
                colours = 1 + np.count_nonzero(colours[1:] != colours[:-1])
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), ",".join(f"{m:.3f}" for m in means) + f";{colours};{len(frames)}", raw))
            cols = [pa.array(c, t) for c, t in zip(list(zip(*rows))[:7], (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
            if keep_media:
                cols.append(pa.array([r[7] for r in rows], pa.binary()))
            yield pa.RecordBatch.from_arrays([ids, *cols], [id_col, *names, *["media"] * keep_media])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col)).mapInArrow(trimmed(run), f"`{id_col}` {kind}, {MEDIA}" + ", media binary" * keep_media)


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents").select("doc_id", "text"))
