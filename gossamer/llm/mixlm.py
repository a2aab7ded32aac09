"""Language-model scoring by online logistic context mixing.

A text is coded token by token, a token being a lower-cased word or the end. A known word is an
escape decision, the BITS leading bits of its hash (its bucket), and its share of the bucket's
count. Each bit of the bucket is predicted by order 0, by three hashed contexts (the word before,
the last two frequent words, the two words before) and by a match with another text; the
predictions are mixed by weights that are gated by how well the contexts are known, and refined by
an adaptive probability map. An unknown word pays for its escape and its spelling in a byte bigram
model. ``score`` is the log10 probability of the tokens over the events of the add-one base score,
where all unknown words are one symbol, so that the two can be compared; ``spelled_score`` is that of
the tokens with unknown words spelled out; ``bits_per_byte`` is of the text as it stands: there the
case of the words and the white space between them are coded, too.

What is counted in the corpus: words and matches by shuffles as large as what is counted, contexts
in hashed tables of fixed size, and the small tables of spelling, case and white space. Every place
of a text may match: where another training text holds its last three words, what follows there is
predicted. A training text does not count for itself as another text; in the counts of words and
contexts it does, as in the add-one base score.

Every text is coded on its own and in order: mixing weights and refinement start from the same
values and learn after its tokens 1, 2, 4, 8, 16, 32, 64 and every 64th from there on.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.llm.bytesets import mapped, mix64, piece_sums, slices, text_column, word_hashes, word_starts
from gossamer.session import bounded_batches, materialize, table, trimmed

BITS = 12
NODES = 1 << BITS
#: Bits that share a slot group: a context is hashed once for each.
NIBBLE = 4
GROUPS = BITS // NIBBLE
#: Counters of each hashed context: 2 ** TABLE_BITS.
TABLE_BITS = 20
CONTEXTS = 3
#: A word gives context with at least 1/FREQUENT of all tokens, so at most FREQUENT words do.
FREQUENT = 16_000
#: The counts of words with at least 1/COMMON of all tokens are in the model: at most COMMON words, 4 MB.
COMMON = 1 << 18
#: Tokens between two learning steps, at most.
CHUNK = 64
#: Text bytes of a block of documents that is scored together, with the counts of its words.
BLOCK_BYTES = 8 << 20
PARTS = 64
#: One place in so many is an anchor, where a match may start: every one.
ANCHOR_EVERY = 1
#: Words that an anchor predicts; the next place has its own anchor.
REACH = 1
#: Leading bits of the hash by which three words are told apart.
KEY_BITS = 44
#: Text bytes that a task holds before it deals them to blocks, and anchors that are summed up at a time.
HELD_BYTES, HELD_KEYS = 32 << 20, 1 << 20
#: Start of the mixing weights by grade of the match: order 0, the contexts, the match.
START = np.array([[0.35, 0.30, 0.45, 0.35, 0.0], [0.25, 0.25, 0.35, 0.30, 0.5], [0.10, 0.10, 0.15, 0.15, 1.0]], np.float32)
LEARN = 0.02
#: Sets of mixing weights: grades of trust in the first context, in the better known of the others, and of the match.
GATES = 27
ESCAPE_PRIOR = 60.0
APM_BINS = 24
#: Fixed-point scale of a context's prediction; its two low bits hold the grade of trust.
SCALE = 256.0
END_HASH = np.uint64(0x51A7E0F5D0C7E4D5)

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)

# what depends on a word's bucket alone: its bits, its nodes in the tree, its places in the slot groups
# (a row for each bit)
_CODE = np.arange(NODES) | NODES
_LEVEL = np.arange(BITS)[:, None]
_NODE = (_CODE >> (BITS - _LEVEL)).astype(np.int32)
_BIT = ((_CODE >> (BITS - 1 - _LEVEL)) & 1).astype(np.float32)
_PREFIX = _NODE[::NIBBLE].astype(np.uint64) * _C3
_PLACE = ((1 << _LEVEL % NIBBLE) | (_CODE >> (BITS - _LEVEL)) & ((1 << _LEVEL % NIBBLE) - 1)).astype(np.int64)
_SIGN = 2 * _BIT - 1
#: A counter's place and the bit that is counted there.
_COUNTED = (_PLACE << 1 | (_BIT > 0)).astype(np.int32)


def held_out(doc_id: int | None) -> bool:
    """crc32 of the id as text modulo 7 is 2; a null id trains."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def with_ends(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with the end token behind each row's words, and the rows' offsets."""
    n = len(at) - 1
    out = np.full(len(words) + n, END_HASH, np.uint64)
    offsets = at + np.arange(n + 1)
    keep = np.ones(len(out), bool)
    keep[offsets[1:] - 1] = False
    out[keep] = words
    return out, offsets


def token_rows(batch_ids: list, col: pa.Array, train_only: bool) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, token hashes, offsets, bytes, byte offsets) of slices of a batch."""
    if train_only:
        keep = [i for i, d in enumerate(batch_ids) if not held_out(d)]
        col, batch_ids = col.take(pa.array(keep, pa.int64())), [batch_ids[i] for i in keep]
    data, offsets = text_column(col)
    for lo, hi in slices(offsets):
        words, at = word_hashes(data, offsets[lo : hi + 1])
        tokens, off = with_ends(words, at)
        yield batch_ids[lo:hi], tokens, off, data, offsets[lo : hi + 1]


def buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


class Hashes:
    """Sorted 64-bit hashes, looked up by their leading bits: hashes are spread evenly, so that a place
    is a few steps behind the first hash with these bits."""

    def __init__(self, keys: np.ndarray):
        bits = len(keys).bit_length() + 1
        self.shift = np.uint64(64 - bits)
        self.first = np.concatenate([[0], np.cumsum(np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits))[:-1]]).astype(np.int32)
        self.keys = np.concatenate([keys, np.full(1, ~np.uint64(0))])
        self.size = len(keys)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each hash, or of the next greater one; is it there)."""
        at = self.first.take((h >> self.shift).view(np.int64))
        got = self.keys.take(at)
        left = np.nonzero(got < h)[0]
        while len(left):
            at[left] += 1
            got[left] = self.keys.take(at[left])
            left = left[got[left] < h[left]]
        return at, (got == h) & (at < self.size)


# -- contexts ---------------------------------------------------------------------------------------


def contexts(h: np.ndarray, off: np.ndarray, frequent: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each context: its hash at every token, and whether it is there at all.

    The word before, if frequent; the last two frequent words, wherever they are; the two words
    before, if both are frequent. ``frequent`` is sorted.
    """
    n = len(h)
    known = Hashes(frequent).find(h)[1] & (h != END_HASH)
    row = np.repeat(off[:-1], np.diff(off))
    i = np.arange(n)
    first = i - row
    zero = np.uint64(0)
    p1 = np.where((first >= 1), np.roll(h, 1), zero)
    k1 = (first >= 1) & np.roll(known, 1)
    p2 = np.where((first >= 2), np.roll(h, 2), zero)
    k2 = k1 & (first >= 2) & np.roll(known, 2)
    last = np.maximum.accumulate(np.where(known, i, -1))
    before = np.concatenate([[-1], last[:-1]])
    ok = before >= row
    f1 = np.where(ok, h[before], zero)
    second = np.where(before > 0, np.concatenate([[-1], last])[np.maximum(before, 0)], -1)
    ok2 = ok & (second >= row)
    f2 = np.where(ok2, h[second], zero)
    return [(p1 * _C1, k1), (f1 * _C2 + f2 * _C3 + np.uint64(1), ok), (p1 * _C3 + p2 * _C1 + np.uint64(7), k2)]


def slots(ctx: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """The counter of each context at each bit of the word's bucket: GROUPS x NIBBLE x tokens.

    The bits of a nibble share a group of 16 neighbouring counters, found by one hash of the
    context and the bits before the nibble.
    """
    out = _PLACE.take(bucket, 1).reshape(GROUPS, NIBBLE, -1)
    out += slot_groups(ctx, bucket)[:, None]
    return out


def slot_groups(ctx: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """The first counter of each context's slot group at each nibble: GROUPS x tokens."""
    x = _PREFIX.take(bucket, 1)
    x ^= ctx
    x *= _C2
    x ^= x >> np.uint64(32)
    x *= _C1
    x >>= np.uint64(64 - TABLE_BITS + NIBBLE)
    x <<= np.uint64(NIBBLE)
    return x.view(np.int64)


def counted(ctx: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """``slots`` doubled, plus the bit that is counted there, in a row."""
    out = _COUNTED.take(bucket, 1).reshape(GROUPS, NIBBLE, -1)
    out += (slot_groups(ctx, bucket) << 1).astype(np.int32)[:, None]
    return out.ravel()


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; ``np.unique`` may hash them one by one, which takes several times as long."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    return x[keep]


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


# -- matches ----------------------------------------------------------------------------------------


def anchors(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys) of all tokens with two words before; end tokens are no anchors."""
    if len(h) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    key = mix64(h[2:] * _C1 + h[1:-1] * _C2 + h[:-2] * _C3) >> np.uint64(64 - KEY_BITS)
    place = np.arange(len(h)) - np.repeat(off[:-1], np.diff(off))
    at = np.nonzero((place[2:] >= 2) & (h[2:] != END_HASH))[0]
    return at + 2, key[at]


def first_of_text(at: np.ndarray, key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For every anchor the place of the first one of its key in its row; ``at`` ascends."""
    order = np.lexsort((key, row))
    r, k = row[order], key[order]
    new = np.ones(len(order), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    out = np.empty(len(order), np.int64)
    out[order] = at[order[new]][np.cumsum(new) - 1]
    return out


def matched(h: np.ndarray, off: np.ndarray, trains: np.ndarray, facts: tuple[Hashes, np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket that a match predicts for each token, or -1; how many words the anchor lies back).

    ``facts`` are keys with the number of training texts that hold them (2: or more) and the smallest and
    largest bucket that follows. A training text leaves itself out: it counts one text less, and of two
    different continuations it takes the one that is not its own.
    """
    guess, run = np.full(len(h), -1, np.int32), np.zeros(len(h), np.int32)
    keys, n, a, b = facts
    at, key = anchors(h, off)
    if not len(at) or not keys.size:
        return guess, run
    where, there = keys.find(key << np.uint64(64 - KEY_BITS))
    row = np.searchsorted(off, at, "right") - 1
    mine = trains[row]
    there[there] = n[where[there]] > mine[there]
    at, key, where, row, mine = at[there], key[there], where[there], row[there], mine[there]
    own = np.full(len(at), -1, np.int64)
    own[mine] = buckets(h[first_of_text(at[mine], key[mine], row[mine]) + 1])
    guess[at + 1] = np.where(own == a[where], b[where], a[where])
    return guess, run


# -- what goes between blocks and the parts of all keys ---------------------------------------------


def packed(x: np.ndarray) -> bytes:
    """Integers that are not negative by planes of bytes, as many as the largest one needs."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + len(x).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    width, n = raw[0], int.from_bytes(raw[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(raw[9:], decompressed_size=n * width, codec="zstd"), np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def part_starts(n_parts: int, bits: int) -> np.ndarray:
    """The smallest key of each part: parts share the keys of so many bits evenly, in order."""
    return (np.array([-(-(p << 24) // n_parts) for p in range(n_parts)], np.uint64)) << np.uint64(bits - 24)


def sorted_sums(key: np.ndarray, row: np.ndarray, code: np.ndarray, trains: np.ndarray) -> tuple[np.ndarray, ...]:
    """(distinct keys, training texts that hold each (2: or more), smallest and largest bucket that follows
    there, does a held-out text ask) of the anchors of a block's texts, in the order of the texts.

    A text counts once, by its first anchor of a key.
    """
    order = np.argsort(key, kind="stable")
    k, r = key[order], row[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    again = np.zeros(len(k), bool)
    again[1:] = ~new[1:] & (r[1:] == r[:-1])
    counts = trains[order]
    asks = ~counts
    counts = counts & ~again
    start = np.nonzero(new)[0]
    return (k[start], *totals(start, counts.astype(np.int64), code[order], code[order]), np.logical_or.reduceat(asks, start))


def totals(start: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts, up to 2; smallest; largest bucket) of groups that begin at ``start``; rows of no texts do not count."""
    out = np.minimum(np.add.reduceat(n, start), 2)
    low = np.minimum.reduceat(np.where(n > 0, a, NODES), start)
    return out, np.where(out > 0, low, 0), np.maximum.reduceat(np.where(n > 0, b, 0), start)


def as_value(n: np.ndarray, a: np.ndarray, b: np.ndarray, flag: np.ndarray) -> tuple[bytes, bytes]:
    """Number of texts, smallest bucket and a flag of each key; and the largest where it is another one."""
    two = a != b
    return packed(a | n << BITS | flag.astype(np.int64) << (BITS + 2) | two.astype(np.int64) << (BITS + 3)), packed(b[two])


def from_value(value: bytes, more: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    v = unpacked(value).astype(np.int64)
    a = v & (NODES - 1)
    b = a.copy()
    b[v >> (BITS + 3) == 1] = unpacked(more)
    return v >> BITS & 3, a, b, (v >> (BITS + 2) & 1).astype(bool)


ASKED = "part int, block int, words binary, anchors binary, value binary, more binary"
ANSWERS = "block int, part int, counts binary, known binary, value binary, more binary"


def asked_rows(block: int, n_parts: int, words: np.ndarray, grams: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    """What a block asks each part: its sorted words, and its sorted anchors with what it knows of them itself."""
    names = [x.split()[0] for x in ASKED.split(", ")]
    cuts = [[*np.searchsorted(x, part_starts(n_parts, bits)).tolist(), len(x)] for x, bits in ((words, 64), (grams[0], KEY_BITS))]
    for p, (w0, w1, g0, g1) in enumerate(zip(cuts[0], cuts[0][1:], cuts[1], cuts[1][1:])):
        if w0 < w1 or g0 < g1:
            w, g = words[w0:w1], grams[0][g0:g1]
            _, n, a, b, asks = (x[g0:g1] for x in grams)
            steps_ = [packed(np.diff(x, prepend=x[:1] * np.uint64(0))) for x in (w, g)]
            row = [p, block, *steps_, *as_value(n, a, b, asks)]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32() if i < 2 else pa.binary()) for i, x in enumerate(row)], names)


def answers(facts: pa.Table, asked: pa.Table) -> pa.Table:
    """For one part of all keys: the count of each word that a block asks for, and which of its anchors other
    texts hold, in the block's order.

    Anchors are summed up over the blocks in ranges of about HELD_KEYS; beside them a task holds ten bytes
    or so for each anchor of its part.
    """
    h, c = facts.column("h").to_numpy().view(np.uint64), facts.column("c").to_numpy()
    order = np.argsort(h)
    lexicon, c = Hashes(h[order]), np.append(c[order], 0)
    counts = []
    for raw in asked.column("words").to_pylist():
        where, there = lexicon.find(np.cumsum(unpacked(raw), dtype=np.uint64))
        counts.append(packed(np.where(there, c[where], 0)))
    keys = [np.cumsum(unpacked(raw), dtype=np.uint64) for raw in asked.column("anchors").to_pylist()]
    known = list(zip(asked.column("value").to_pylist(), asked.column("more").to_pylist()))
    facts_of = [tuple(x.astype(np.int16) for x in from_value(*v)) for v in known]
    got: list[list[tuple[np.ndarray, ...]]] = [[] for _ in keys]
    whole = sum(map(len, keys))
    if whole:
        low, high = min(int(k[0]) for k in keys if len(k)), max(int(k[-1]) for k in keys if len(k)) + 1
        n_ranges = -(-whole // HELD_KEYS)
        limits = np.array([low + (high - low) * i // n_ranges for i in range(n_ranges + 1)], np.uint64)
        cuts = [np.searchsorted(k, limits) for k in keys]
        for i in range(n_ranges):
            spans = [slice(x[i], x[i + 1]) for x in cuts]
            k = np.concatenate([x[s] for x, s in zip(keys, spans)])
            if not len(k):
                continue
            n, a, b, asks = (np.concatenate([f[j][s] for f, s in zip(facts_of, spans)]).astype(np.int64) for j in range(4))
            order = np.argsort(k, kind="stable")
            k = k[order]
            new = np.ones(len(k), bool)
            new[1:] = k[1:] != k[:-1]
            group = np.empty(len(k), np.int64)
            group[order] = np.cumsum(new) - 1
            n, a, b = (x[group] for x in totals(np.nonzero(new)[0], n[order], a[order], b[order]))
            # an anchor that only its own training text holds says nothing
            use = (n > 1) | (n == 1) & (asks > 0)
            ends = np.cumsum([s.stop - s.start for s in spans]).tolist()
            for one, e, s in zip(got, ends, spans):
                here = slice(e - (s.stop - s.start), e)
                u = use[here]
                one.append((u, *(x[here][u].astype(np.int16) for x in (n, a, b))))
    rows = []
    for one in got:
        use, n, a, b = (np.concatenate([x[j] for x in one]).astype(t) if one else np.zeros(0, t) for j, t in enumerate((bool, *[np.int64] * 3)))
        rows.append((packed(np.packbits(use)), *as_value(n, a, b, n > 2)))
    cols = [asked.column("block"), asked.column("part"), pa.array(counts, pa.binary())]
    return pa.table([*cols, *(pa.array([r[j] for r in rows], pa.binary()) for j in range(3))], [x.split()[0] for x in ANSWERS.split(", ")])


def answered(got: pa.Table, n_words: int, keys: np.ndarray, n_parts: int) -> tuple[np.ndarray, tuple[Hashes, np.ndarray, np.ndarray, np.ndarray]]:
    """(count of each of a block's words, facts of its anchors) from the answers of all parts."""
    got = got.sort_by("part")
    counts = [unpacked(x) for x in got.column("counts").to_pylist()]
    cut = np.append(np.searchsorted(keys, part_starts(n_parts, KEY_BITS)), len(keys))
    found, facts = [np.zeros(0, np.uint64)], [tuple([np.zeros(0, np.int64)] * 4)]
    for p, use, value, more in zip(*(got.column(x).to_pylist() for x in ("part", "known", "value", "more"))):
        own = keys[cut[p] : cut[p + 1]]
        found.append(own[np.unpackbits(unpacked(use).astype(np.uint8), count=len(own)).astype(bool)])
        facts.append(from_value(value, more))
    counts_ = np.concatenate([np.zeros(0, np.uint64), *counts]).astype(np.int64)
    if len(counts_) != n_words or len(np.concatenate(found)) != sum(len(f[0]) for f in facts):
        raise ValueError("answers for other texts than the block's")
    n, a, b, _ = (np.concatenate([f[j] for f in facts]) for j in range(4))
    return counts_, (Hashes(np.concatenate(found) << np.uint64(64 - KEY_BITS)), n, a, b)


# -- case and white space ---------------------------------------------------------------------------

#: Gaps: one space, one line feed, two, none, others. Cases: lower, first byte upper, all letters upper, others.
N_GAPS, N_CASES = 5, 4


def forms(a: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How words are written: (row, cell, bytes or letters to spell out) of the gaps, then of the cases.

    A gap's cell is (leading, inner or trailing; the gap before; the gap), a case's is (does a
    sentence begin; the case).
    """
    n_rows = len(off) - 1
    solid, begins = word_starts(a, off)
    starts = np.nonzero(begins)[0]
    ends = np.nonzero(solid & np.concatenate([~solid[1:] | begins[1:], np.ones(min(1, len(a)), bool)]))[0] + 1
    row = np.searchsorted(off, starts, "right") - 1
    n = np.bincount(row, minlength=n_rows)
    # the gaps of a row: before each word, and one behind the last
    gap_row = np.concatenate([row, np.arange(n_rows)])
    lead = np.ones(len(starts), bool)
    lead[1:] = row[1:] != row[:-1]
    frm = np.where(lead, off[row], np.concatenate([[0], ends[:-1]])) if len(starts) else np.zeros(0, np.int64)
    last = np.cumsum(n) - 1
    tail = np.where(n > 0, ends[np.maximum(last, 0)] if len(ends) else 0, off[:-1])
    begin, stop = np.concatenate([frm, tail]), np.concatenate([starts, off[1:]])
    place = np.concatenate([np.where(lead, 0, 1), np.full(n_rows, 2)])
    size = stop - begin
    byte = a[np.minimum(begin, len(a) - 1)] if len(a) else np.zeros(len(begin), np.uint8)
    after = a[np.minimum(begin + 1, len(a) - 1)] if len(a) else byte
    kind = np.where(size == 0, 3, np.where((size == 1) & (byte == 32), 0, np.where((size == 1) & (byte == 10), 1, np.where((size == 2) & (byte == 10) & (after == 10), 2, 4))))
    # the gap before: that of the word before in the row
    before = np.full(len(kind), 3)
    m = len(starts)
    before[1:m] = np.where(lead[1:], 3, kind[: m - 1]) if m > 1 else 3
    before[m:] = np.where(n > 0, kind[np.maximum(last, 0)], 3)
    gap_cell = (place * N_GAPS + before) * N_GAPS + kind
    gap_extra = np.where(kind == 4, size, 0)
    if not m:
        none = np.zeros(0, np.int64)
        return gap_row, gap_cell, gap_extra, none, none, none
    up = (a >= 65) & (a <= 90)
    letter = up | ((a >= 97) & (a <= 122))
    ups, letters = piece_sums(up, starts), piece_sums(letter, starts)
    case = np.where(ups == 0, 0, np.where((ups == 1) & up[starts], 1, np.where(ups == letters, 2, 3)))
    stops = np.isin(a[ends - 1], np.frombuffer(b".!?", np.uint8))
    opens = np.concatenate([[True], stops[:-1]]) | lead
    return gap_row, gap_cell, gap_extra, row, opens * N_CASES + case, np.where(case == 3, letters, 0)


# -- the model --------------------------------------------------------------------------------------


def context_words(common: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """The hashes of the words with at least 1/FREQUENT of the ``n`` tokens."""
    return common[0][common[1] * FREQUENT >= max(n, 1)]


class Model:
    """What scoring needs besides the facts of a block; its size does not follow the input.

    ``common`` are the sorted hashes of the words that every block is taken to hold, with their
    counts; those of them with at least 1/FREQUENT of the tokens give context.
    """

    def __init__(self, n: int, v: int, singles: int, bucket_counts: np.ndarray, common: tuple[np.ndarray, np.ndarray], ones: np.ndarray, alls: np.ndarray, pairs: np.ndarray, gaps: np.ndarray, cases: np.ndarray):
        self.n, self.v = n, v
        self.escape = (singles + 1) / (n + 2)
        self.common, self.common_counts = common
        self.frequent = context_words(common, n)
        self.log_bucket = np.log10(np.maximum(bucket_counts, 1))
        tree = np.zeros(2 * NODES)
        tree[NODES:] = bucket_counts
        for k in range(NODES - 1, 0, -1):
            tree[k] = tree[2 * k] + tree[2 * k + 1]
        one, whole = tree[3 : 2 * NODES : 2], tree[1:NODES]
        order0 = np.concatenate([[0], np.clip(stretch((one + 0.02) / (whole + 0.04)), -12, 12)]).astype(np.float32)
        #: order 0 at every bit of every bucket
        self.order0 = order0[_NODE]
        x = np.clip(stretch((ones + 0.1) / (alls + 0.2)), -10, 10)
        # how well a slot is known: not at all, a little, well
        trust = np.digitize(alls, [3, 40])
        x[trust == 0] = 0
        # one more slot, for a context that is not there
        table_ = (np.rint(x * SCALE).astype(np.int16) << 2) | trust.astype(np.int16)
        self.table = np.concatenate([table_, np.zeros((CONTEXTS, 1), np.int16)], 1)
        self.spell = -np.log10((pairs + 0.05) / (pairs.sum(1, keepdims=True) + 0.05 * 256))
        share = lambda t, k: -np.log10((t.reshape(-1, k) + 0.5) / (t.reshape(-1, k).sum(1, keepdims=True) + 0.5 * k)).ravel()
        self.gap, self.case = share(gaps, N_GAPS), share(cases, N_CASES)


def corpus_facts(docs: DataFrame) -> DataFrame:
    """(h, c): every training token's count by its 64-bit hash. One row a task and token is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def settle() -> tuple[np.ndarray, np.ndarray]:
            h = np.concatenate([x for x, _ in held])
            c = np.concatenate([x for _, x in held])
            u, inv = np.unique(h, return_inverse=True)
            return u, np.bincount(inv, c, len(u)).astype(np.int64)

        for b in batches:
            for _, tokens, *_ in token_rows(b.column(0).to_pylist(), b.column(1), True):
                held.append(tuple(np.unique(tokens, return_counts=True)))
                size += len(held[-1][0])
                if size > 2_000_000:
                    held = [settle()]
                    size = 0
                    if len(held[0][0]) > 4_000_000:
                        yield from rows(*held[0])
                        held = []
        if held:
            yield from rows(*settle())

    def rows(h: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(h), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 200_000]) for x in (h.view(np.int64), c)], ["h", "c"])

    return docs.mapInArrow(trimmed(run), "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


#: The small tables behind the contexts' counters: byte pairs, gaps, cases.
SMALL = (65536, 3 * N_GAPS * N_GAPS, 2 * N_CASES)


def context_tables(docs: DataFrame, frequent: np.ndarray, text_bytes: int) -> tuple[np.ndarray, ...]:
    """(ones, all) of every context slot, byte pairs of words, gaps and cases, added up over all training texts.

    Partial tables of larger corpora (``text_bytes``) are added up in two rounds, so that a task reads
    each part about as often as the square root of the number of map tasks says.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    size = 1 << TABLE_BITS
    small_kind = 2 * CONTEXTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        both = np.zeros((CONTEXTS, 2 * size), np.uint32)
        small = np.zeros(sum(SMALL), np.int64)
        held: list[list[np.ndarray]] = [[] for _ in range(CONTEXTS)]
        n_held = 0

        def settle() -> None:
            for j in range(CONTEXTS):
                if held[j]:
                    both[j] += np.bincount(np.concatenate(held[j]), minlength=2 * size).astype(np.uint32)
                    held[j] = []

        for b in batches:
            for _, h, off, data, byte_off in token_rows(b.column(0).to_pylist(), b.column(1), True):
                code = buckets(h)
                for j, (ctx, there) in enumerate(contexts(h, off, shared.value)):
                    own = code[there]
                    held[j].append(counted(ctx[there], own))
                    n_held += len(held[j][-1])
                a, cut = data[byte_off[0] : byte_off[-1]], byte_off - byte_off[0]
                if len(a) > 1:
                    small[:65536] += np.bincount(spelling_pairs(a), minlength=65536)
                _, gap, _, _, case, _ = forms(a, cut)
                small[65536:] += np.concatenate([np.bincount(gap, minlength=SMALL[1]), np.bincount(case, minlength=SMALL[2])])
                if n_held > 6_000_000:
                    settle()
                    n_held = 0
        settle()
        if not both.any() and not small.any():
            return
        for j in range(CONTEXTS):
            alls, ones = both[j][::2] + both[j][1::2], both[j][1::2]
            for kind, t in ((2 * j, alls), (2 * j + 1, ones)):
                for k, part in enumerate(t.reshape(PARTS, -1)):
                    if part.any():
                        yield packed(kind * PARTS + k, part, task)
        yield packed(small_kind * PARTS, small, task)

    def packed(part: int, t: np.ndarray, task: int) -> pa.RecordBatch:
        short = t.max(initial=0) < 65536
        raw = zlib.compress(t.astype("<u2" if short else "<i8").tobytes(), 1)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([task], pa.int32()), pa.array([bool(short)]), pa.array([raw], pa.binary())], ["part", "task", "small", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for p, short, c in zip(*(b.column(i).to_pylist() for i in (0, 2, 3))):
                v = np.frombuffer(zlib.decompress(c), "<u2" if short else "<i8").astype(np.int64)
                sums[p] = sums[p] + v if p in sums else v
        for p, v in sums.items():
            yield packed(p, v, 0)

    ddl = "part int, task int, small boolean, counts binary"
    parts = docs.mapInArrow(trimmed(count), ddl)
    rounds = math.isqrt(text_bytes >> 24)
    if rounds > 8:
        parts = parts.repartition(PARTS * rounds, "part", F.col("task") % rounds).mapInArrow(trimmed(add), ddl)
    got = parts.repartition(PARTS, "part").mapInArrow(trimmed(add), ddl)
    alls, ones, small = np.zeros((CONTEXTS, size), np.int64), np.zeros((CONTEXTS, size), np.int64), np.zeros(sum(SMALL), np.int64)
    for p, _, short, c in got.toLocalIterator():
        v = np.frombuffer(zlib.decompress(c), "<u2" if short else "<i8")
        kind, k = divmod(p, PARTS)
        if kind == small_kind:
            small[:] = v
        else:
            (ones if kind % 2 else alls)[kind // 2].reshape(PARTS, -1)[k] = v
    return alls, ones, *np.split(small, np.cumsum(SMALL)[:-1])


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def spelling_pairs(a: np.ndarray) -> np.ndarray:
    """Pairs of neighbouring bytes within words, with a space at either end of a word."""
    x = mapped(a, _FOLD)
    pair = (x[:-1].astype(np.int64) << 8) | x[1:]
    return pair[pair != (32 << 8 | 32)]


# -- scoring ----------------------------------------------------------------------------------------


def block_tokens(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, token hashes, offsets) of the slices of a block in which it is scored."""
    data, offsets = text_column(col)
    for lo, hi in slices(offsets, 1 << 21):
        yield lo, hi, *with_ends(*word_hashes(data, offsets[lo : hi + 1]))


def asked_words(tokens: list[np.ndarray], common: np.ndarray) -> np.ndarray:
    """The sorted hashes of the tokens, without common ones: these would have a row a block, their counts are in the model."""
    return np.setdiff1d(distinct(np.concatenate(tokens)), common, assume_unique=True) if tokens else np.zeros(0, np.uint64)


def score_texts(model: Model, trains: np.ndarray, col: pa.Array, got: pa.Table, n_parts: int) -> Iterator[dict[str, np.ndarray]]:
    """Scores of the texts of one block, given the answers of all parts."""
    data, offsets = text_column(col)
    tokens = list(block_tokens(col))
    words = asked_words([t[2] for t in tokens], model.common)
    keys = distinct(np.concatenate([np.zeros(0, np.uint64), *(anchors(h, off)[1] for _, _, h, off in tokens)]))
    word_counts, facts = answered(got, len(words), keys, n_parts)
    log_all = math.log10(model.n + model.v + 1)
    words, word_counts = words[word_counts > 0], word_counts[word_counts > 0]
    known_hash = np.concatenate([words, model.common])
    order = np.argsort(known_hash, kind="stable")
    lexicon, known_count = Hashes(known_hash[order]), np.concatenate([np.concatenate([word_counts, model.common_counts])[order], [0]])
    for lo, hi, h, off in tokens:
        cut = offsets[lo : hi + 1] - offsets[lo]
        a = data[offsets[lo] : offsets[hi]]
        n_rows = hi - lo
        row = np.repeat(np.arange(n_rows), np.diff(off))
        where, known = lexicon.find(h)
        c = np.where(known, known_count.take(where), 0)
        base = np.bincount(row, np.log10(c + 1.0) - log_all, n_rows)
        # escapes: counted over the document so far
        place = np.arange(len(h)) - off[:-1][row]
        fresh = (~known).astype(np.int64)
        so_far = np.cumsum(fresh) - fresh
        so_far = so_far - so_far[off[:-1]][row]
        p_esc = np.clip((so_far + ESCAPE_PRIOR * model.escape) / (place + ESCAPE_PRIOR), 1e-9, 1 - 1e-9)
        logs = np.log10(np.where(known, 1 - p_esc, p_esc))
        bucket = buckets(h)
        logs += np.where(known, np.log10(np.maximum(c, 1)) - model.log_bucket[bucket], 0.0)
        logs += mixed_bits(model, h, off, row, known, *matched(h, off, trains[lo:hi], facts))
        score = np.bincount(row, logs, n_rows)
        spelled = score + np.bincount(row, spelling(model, a, cut, off, fresh), n_rows)
        gap_row, gap, odd, case_row, case, letters = forms(a, cut)
        form = np.bincount(gap_row, model.gap[gap] + odd * math.log10(12), n_rows) + np.bincount(case_row, model.case[case] + letters * math.log10(2), n_rows)
        yield {"n_tokens": np.diff(off), "n_known": np.bincount(row, known, n_rows).astype(np.int64), "base": base, "score": score, "spelled": spelled, "whole": spelled - form, "n_bytes": np.diff(cut)}


def spelling(model: Model, a: np.ndarray, byte_off: np.ndarray, off: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """log10 probability of each unknown token's bytes (with the space behind), 0 for known ones."""
    if not len(a) or not fresh.any():
        return np.zeros(len(fresh))
    x = mapped(a, _FOLD)
    solid = x != 32
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    first = byte_off[:-1][byte_off[:-1] < len(a)]
    begins[first] = solid[first]
    before = np.concatenate([_FOLD[32:33], x[:-1]])
    before[begins] = 32
    cost = model.spell.take((before.astype(np.int32) << 8) | x)
    cost[~solid] = 0
    starts = np.nonzero(begins)[0]
    out = np.zeros(len(fresh))
    if len(starts):
        per_word = np.add.reduceat(cost, starts)
        after = np.nonzero(solid & np.concatenate([~solid[1:] | begins[1:], [True]]))[0]
        per_word = per_word + model.spell[x[after], 32]
        keep = np.ones(len(fresh), bool)
        keep[off[1:] - 1] = False
        out[keep] = -per_word
    return out * fresh


def steps(place: np.ndarray) -> np.ndarray:
    """The number of the learning step that follows each place of a text: after 1, 2, 4 ... CHUNK tokens, then every CHUNK."""
    early = np.frexp(place.astype(np.float64))[1]
    return np.where(place < CHUNK, early, np.frexp(float(CHUNK))[1] + (place - CHUNK) // CHUNK)


def mixed_bits(model: Model, h: np.ndarray, off: np.ndarray, row: np.ndarray, known: np.ndarray, guess: np.ndarray, run: np.ndarray) -> np.ndarray:
    """log10 probability of each known token's bucket under the mixed bit predictors."""
    n, n_rows = len(h), len(off) - 1
    out = np.zeros(n)
    if n == 0:
        return out
    ctxs = contexts(h, off, model.frequent)
    bucket = buckets(h)
    # a match predicts a bit as long as the word's bits before agree with it
    differ = np.where(guess >= 0, bucket ^ guess, NODES)
    valid = BITS - np.frexp(differ.astype(np.float64))[1]  # -1: no match
    force = (2 + np.minimum(run, 4)).astype(np.float32)
    weights = [np.repeat(START[None, :, j], 9, 0).ravel() for j in range(CONTEXTS + 2)]
    weights = [np.tile(w, n_rows).astype(np.float32) for w in weights]
    centres = np.linspace(-8, 8, APM_BINS)
    apm = np.tile(1 / (1 + np.exp(-centres)), n_rows).astype(np.float32)
    step = steps(np.arange(n) - off[:-1][row])
    # longer texts first, so that the ones that a step still reaches come before all others
    rank = np.empty(n_rows, np.int64)
    rank[np.argsort(-np.diff(off), kind="stable")] = np.arange(n_rows)
    row = rank[row]
    order = np.argsort(step * n_rows + row, kind="stable") if n_rows > 1 else np.arange(n)
    order = order[known[order]]
    bounds = np.nonzero(np.diff(step[order]))[0] + 1
    nothing = 1 << TABLE_BITS
    for part in np.split(order, bounds):
        m = len(part)
        if not m:
            continue
        code = bucket[part]
        cube = (GROUPS, NIBBLE, m)
        bit = _BIT.take(code, 1).reshape(cube)
        inputs, trust = [model.order0.take(code, 1).reshape(cube)], []
        for j, (ctx, there) in enumerate(ctxs):
            on = there[part]
            if not on.any():
                inputs.append(None)
                trust.append(np.zeros((GROUPS, m), np.int16))
                continue
            s = slots(ctx[part], code)
            if not on.all():
                s[:, :, ~on] = nothing
            got = model.table[j].take(s)
            trust.append(got[:, 0] & 3)
            got >>= 2
            inputs.append(got * np.float32(1 / SCALE))
        okay = valid[part]
        if (okay >= 0).any():
            sign = _SIGN.take(np.maximum(guess[part], 0), 1)
            sign *= force[part]
            sign *= _LEVEL <= okay
            inputs.append(sign.reshape(cube))
            grade = np.where(_LEVEL[::NIBBLE] <= okay, np.where(run[part] >= 2, 2, 1), 0)
        else:
            inputs.append(None)
            grade = 0
        key = row[part] * GATES + trust[0] * 9 + np.maximum(trust[1], trust[2]) * 3 + grade
        z = weights[0].take(key)[:, None] * inputs[0]
        for w, x in zip(weights[1:], inputs[1:]):
            if x is not None:
                z += w.take(key)[:, None] * x
        np.clip(z, -12, 12, out=z)
        p = np.negative(z)
        np.exp(p, out=p)
        p += 1
        np.divide(1, p, out=p)
        cell = z
        cell += 8
        cell *= np.float32((APM_BINS - 1) / 16)
        np.clip(cell, 0, np.float32(APM_BINS - 1.001), out=cell)
        low = cell.astype(np.int64)
        frac = cell
        frac -= low.astype(np.float32)
        low += row[part] * APM_BINS
        live = int(row[part].max()) + 1
        own = apm[: live * APM_BINS]
        final = np.append(own[1:] - own[:-1], np.float32(0)).take(low)
        final *= frac
        final += own.take(low)
        final *= np.float32(0.4)
        final += np.float32(0.6) * p
        # the probability of the bit that came
        final -= 1 - bit
        np.clip(np.abs(final, out=final), 1e-7, 1, out=final)
        out[part] = np.log10(np.multiply.reduce(final.reshape(BITS, m), axis=0, dtype=np.float64))
        # learn from what has been coded
        err = np.subtract(bit, p, out=p)
        flat = key.ravel()
        for w, x in zip(weights, inputs):
            if x is not None:
                x *= err
                step_ = LEARN * np.bincount(flat, x.sum(1).ravel(), live * GATES)
                w[: live * GATES] += np.clip(step_, -0.1, 0.1).astype(np.float32)
        low += frac > 0.5
        low <<= 1
        low += bit > 0
        near = np.bincount(low.ravel(), minlength=2 * live * APM_BINS).reshape(-1, 2).astype(np.float32)
        ones, seen = near[:, 1], near[:, 0] + near[:, 1]
        own += (ones - seen * own) / (seen + np.float32(60))
    return out


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_bytes bigint, spelled_score double, bits_per_byte double"


def train(docs: DataFrame, counts: DataFrame, text_bytes: int) -> Model:
    """Fit on the training documents; ``counts`` is their materialized ``corpus_facts``."""
    bucket = F.shiftrightunsigned("h", 64 - BITS)
    sums = counts.groupBy(bucket.alias("b")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v"), F.sum((F.col("c") == 1).cast("long")).alias("s")).collect()
    by_bucket = np.zeros(NODES, np.int64)
    for r in sums:
        by_bucket[r["b"]] = r["c"]
    n, v, singles = (sum(r[x] for r in sums) for x in ("c", "v", "s"))
    # words of 1/COMMON of the tokens, so at most COMMON rows
    often = counts.where(F.col("c") * max(COMMON, FREQUENT) >= max(n, 1)).select("h", "c").toArrow()
    hashes, c = often.column("h").to_numpy().view(np.uint64), often.column("c").to_numpy()
    order = np.argsort(hashes)
    common = hashes[order], c[order]
    alls, ones, pairs, gaps, cases = context_tables(docs, context_words(common, n), text_bytes)
    return Model(n, v, singles, by_bucket, common, ones, alls, pairs.reshape(256, 256), gaps, cases)


def dealt_blocks(rows: DataFrame, n_blocks: int, n: int) -> DataFrame:
    """(block, raw): the rows dealt to blocks by a hash of id and text; what a task has for a block is one compressed table or several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size > HELD_BYTES:
                yield from deal(held)
                held, size = [], 0
        if held:
            yield from deal(held)

    def deal(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held).sort_by("block")
        block = whole.column("block").to_numpy()
        whole = whole.drop_columns("block")
        start = np.nonzero(np.concatenate([[True], block[1:] != block[:-1]]))[0].tolist()
        for at, end in zip(start, [*start[1:], len(block)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(whole.slice(at, end - at).combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([block[at]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "raw"])

    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int").alias("block")
    return rows.select("doc_id", "text", block).mapInArrow(trimmed(run), "block int, raw binary").repartition(n, "block")


def unpacked_rows(raw: bytes) -> tuple[list, pa.Array]:
    """(ids, texts) of one compressed table."""
    t = pa.ipc.open_stream(raw).read_all().combine_chunks()
    text = t.column("text")
    return t.column("doc_id").to_pylist(), text.chunk(0) if text.num_chunks else pa.array([], pa.string())


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text, learning from those whose crc32(id as text) modulo 7 is not 2.

    Null texts are empty (one end token); a null id trains and has held_out false; repeated rows
    count, and are scored, as often as they occur; equal texts of one block are scored once. An
    empty table gives no rows; columns of ``docs`` other than the two named are not read, so their
    names do not matter. Words are told apart by 64-bit hashes, three words by KEY_BITS bits. Texts go
    to blocks by a hash of their id and text. All keys (words and anchors) are shared out to parts, by
    their leading bits: a block asks each part for its own keys and is answered in the same order, so
    no task and no broadcast holds the vocabulary. A very long text is in one block with others and is
    scored whole.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    facts = materialize(corpus_facts(rows), "lm-facts")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    model = train(rows, facts, size)
    shared = spark.sparkContext.broadcast(model)
    n_blocks = max(1, -(-size // BLOCK_BYTES))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n_parts = min(n, max(PARTS, size >> 26))
    dealt = dealt_blocks(rows, n_blocks, n)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, block, held, n_rows = shared.value.common, None, [], 0
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1)):
                if k != block:
                    yield from settled(block, held, common)
                    block, held, n_rows = k, [], 0
                ids, col = unpacked_rows(raw.as_py())
                trains = np.array([not held_out(d) for d in ids], bool)
                for lo, _, tokens, off in block_tokens(col):
                    at, key = anchors(tokens, off)
                    row = np.searchsorted(off, at, "right") - 1 + lo
                    held.append((distinct(tokens), key, (row + n_rows).astype(np.int32), buckets(tokens[at + 1]).astype(np.int16), trains[row]))
                n_rows += len(ids)
        yield from settled(block, held, common)

    def settled(block: int | None, held: list, common: np.ndarray) -> Iterator[pa.RecordBatch]:
        if held:
            grams = [np.concatenate([x[j] for x in held]) for j in range(1, 5)]
            sums = sorted_sums(*grams) if len(grams[0]) else (grams[0], *[np.zeros(0, np.int64)] * 3, np.zeros(0, bool))
            yield from asked_rows(block, n_parts, asked_words([x[0] for x in held], common), sums)

    asks = dealt.sortWithinPartitions("block").mapInArrow(trimmed(ask), ASKED)
    part = F.shiftright(F.shiftrightunsigned("h", 40) * n_parts, 24).cast("int")
    known = facts.withColumn("part", part).repartition(n_parts, "part").groupBy("part").cogroup(asks.repartition(n_parts, "part").groupBy("part")).applyInArrow(answers, ANSWERS)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = [unpacked_rows(raw.as_py()) for raw in left.column("raw")]
        ids = [i for t in tables for i in t[0]]
        held = np.array([held_out(d) for d in ids], bool)
        m = shared.value
        col = pa.chunked_array([t[1] for t in tables], pa.string()).combine_chunks()
        # a text is scored once for those that train and once for those held out
        coded = col.fill_null("").dictionary_encode()
        pair = coded.indices.to_numpy().astype(np.int64) * 2 + held
        each, which = np.unique(pair, return_inverse=True)
        # by length: a slice takes as many learning steps as its longest text
        order = np.argsort(np.append(pc.binary_length(coded.dictionary).to_numpy(), 0)[each // 2], kind="stable")
        place = np.empty(len(each), np.int64)
        place[order] = np.arange(len(each))
        each, which = each[order], place[which]
        cols: dict[str, list] = {k: [] for k in ("n_tokens", "n_known", "base", "score", "spelled", "whole", "n_bytes")}
        for got in score_texts(m, each % 2 == 0, coded.dictionary.take(pa.array(each // 2)), right, n_parts):
            for k, v in cols.items():
                v.append(got[k])
        full = {k: np.concatenate(v)[which] if v else np.zeros(0) for k, v in cols.items()}
        size = np.maximum(full["n_bytes"], 1)
        long = lambda k: pa.array(full[k].astype(np.int64))
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(held), "n_tokens": long("n_tokens"), "n_known": long("n_known"),
            "train_tokens": pa.array(np.full(len(ids), m.n, np.int64)), "base_score": pa.array(full["base"]), "score": pa.array(full["score"]), "n_bytes": long("n_bytes"),
            "spelled_score": pa.array(full["spelled"]), "bits_per_byte": pa.array(-full["whole"] * math.log2(10) / size),
        })

    return dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(score, SCORES)


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"))
