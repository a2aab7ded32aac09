"""Vectorised words, shingles and hashes over Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time.
SLICE_BYTES = 1 << 19


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_BYTE = _keys(256, 11)
_PLACE = _keys(1 << 12, 23)
_GRAM = _keys(16, 37)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_column(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    col = col.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes; a longer row is a range of its own."""
    n = len(offsets) - 1
    at = 0
    while at < n:
        stop = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        stop = min(n, max(at + 1, stop))
        yield at, stop
        at = stop


def lowered(a: np.ndarray) -> np.ndarray:
    return mapped(a, _LOWER)


def mapped(a: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Bytes by a table of 256 bytes; ``to[a]`` makes an index of eight bytes for each."""
    return np.frombuffer(bytearray(a).translate(to.tobytes()), np.uint8)


def word_starts(a: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which bytes are in words, which start one); a row's start starts a word."""
    solid = (a != 32) & (a - np.uint8(9) > 4)
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    first = off[:-1][off[:-1] < len(a)]
    begins[first] = solid[first]
    return solid, begins


def hash_pieces(a: np.ndarray, solid: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hashes of the pieces that start at ``starts``; bytes outside words do not count."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(a)
    # the place of each byte within its piece
    run = np.zeros(n, np.int64)
    run[starts] = np.diff(np.concatenate([[0], starts]))
    place = np.arange(n)
    place -= np.cumsum(run, out=run)
    terms = _BYTE.take(a)
    if place.max() < len(_PLACE):
        terms *= _PLACE.take(place)
    else:
        terms *= _PLACE.take(place & (len(_PLACE) - 1))
        long = place >= len(_PLACE)
        terms[long] = mix64(terms[long] + (place[long] >> 12).astype(np.uint64))
    terms *= solid
    return mix64(piece_sums(terms, starts))


def piece_sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of each piece, from its start to the next one's; integers of 64 bits may overflow on the way."""
    total = np.cumsum(x)
    up_to = total.take(np.append(starts[1:], len(x)) - 1)
    up_to[1:] -= up_to[:-1].copy()
    if starts[0]:
        up_to[:1] -= total[starts[0] - 1 : starts[0]]
    return up_to


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of consecutive rows, and the rows' offsets into them.

    Words are runs of bytes other than space and 9-13, with A-Z lowered.
    """
    a = lowered(data[offsets[0] : offsets[-1]])
    off = offsets - offsets[0]
    if len(a) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    solid, begins = word_starts(a, off)
    starts = np.nonzero(begins)[0]
    return hash_pieces(a, solid, starts), np.searchsorted(starts, off)


def shingle_sets(words: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each row; fewer words are one shingle, none is empty."""
    grams = np.zeros(0, np.uint64)
    if len(words) >= k:
        grams = sum((words[i : len(words) - k + 1 + i] * _GRAM[i] for i in range(1, k)), words[: len(words) - k + 1] * _GRAM[0])
        grams = mix64(grams)
    out = []
    for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
        if e - s >= k:
            g = np.sort(grams[s : e - k + 1])
            keep = np.ones(len(g), bool)
            keep[1:] = g[1:] != g[:-1]
            out.append(g[keep])
        elif e > s:
            h = np.uint64(e - s)
            with np.errstate(over="ignore"):
                for i in range(s, e):
                    h = mix64(np.array([h * np.uint64(0x9E3779B97F4A7C15) + words[i]], np.uint64))[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
