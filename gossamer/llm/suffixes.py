"""Removal of repeated substrings by a distributed merge of front-coded, sorted suffix runs.

Which suffixes matter is settled first. In every window of WINDOW bytes the k-mer with the smallest
hash is its anchor (common k-mers
come last); equal windows have their anchors at equal places. A window whose anchor's k-mer
occurs once in the corpus occurs once itself. What is left are stretches of windows with one
repeated anchor. The text of such a stretch, from its anchor on, is a suffix to be sorted: tasks
sort theirs into runs, front-code them (length of the prefix shared with the one before, and the
rest), and exchange them by ranges of the anchor's hash; the runs of a range are merged by a loser
tree that knows how far each string agrees with the last one put out, so no byte of a known common
prefix is compared again. Suffixes that share an anchor come out next to each other, and the shared
prefixes of neighbours tell which of their windows are equal.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.llm.bytesets import mix64, slices, text_column
from gossamer.llm.groups import attach_groups
from gossamer.session import bounded_batches, materialize, table, trimmed

WINDOW = 100
KMER = 16
#: A task sorts at most so many suffixes into one run.
RUN_SUFFIXES = 80_000
#: Hash ranges a shuffle partition gets on average.
RANGES_EACH = 4
#: Slots of the table of common k-mers: 2 ** HOT_BITS.
HOT_BITS = 20
#: So many ids are broadcast at most (16 bytes each); beyond it the join is shuffled.
BROADCAST_IDS = 1_000_000
NULL_ID = -(1 << 63)

_POS_BITS = 24
_POS = np.uint64((1 << _POS_BITS) - 1)


def text_tag(raw: bytes) -> int:
    """31 bits of a text's crc32, which tell rows of one id apart."""
    return zlib.crc32(raw) & 0x7FFFFFFF


def kmer_hashes(a: np.ndarray, hot: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the KMER-byte strings at every place; hot ones are larger than all others."""
    n = len(a) - KMER + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    raw = np.ascontiguousarray(a)
    lo, hi = np.ndarray((n,), "<u8", raw, 0, (1,)), np.ndarray((n,), "<u8", raw, 8, (1,))
    h = lo * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h += hi * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    if hot is not None:
        h = (h >> np.uint64(1)) | (hot[(h >> np.uint64(64 - HOT_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(63))
    return h


def hot_kmers(docs: DataFrame) -> np.ndarray:
    """Slots of k-mers that are more frequent than chance, in a table that is as large for any input.

    A common phrase makes a bad anchor: very many different stretches would meet at it. Which
    k-mers are hot changes the order of anchors only, never what is found.
    """
    rows = 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.zeros(1 << HOT_BITS, np.int64)
        held, n = [], 0
        for b in batches:
            data, offsets = text_column(b.column(0))
            for lo, hi in slices(offsets):
                held.append((kmer_hashes(data[offsets[lo] : offsets[hi]]) >> np.uint64(64 - HOT_BITS)).astype(np.int32))
                n += len(held[-1])
                if n > 2_000_000:
                    t += np.bincount(np.concatenate(held), minlength=len(t))
                    held, n = [], 0
        if held:
            t += np.bincount(np.concatenate(held), minlength=len(t))
        if t.any():
            parts = [zlib.compress(p.astype("<u4").tobytes(), 1) for p in t.reshape(rows, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int32()), pa.array(parts, pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = np.frombuffer(zlib.decompress(c), "<u4").astype(np.int64)
                sums[p] = sums[p] + v if p in sums else v
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())], ["part", "counts"])

    got = docs.select("text").mapInArrow(trimmed(count), "part int, counts binary").repartition(rows, "part").mapInArrow(trimmed(add), "part int, counts binary").collect()
    table_ = np.zeros((rows, (1 << HOT_BITS) // rows), np.int64)
    for p, c in got:
        table_[p] = np.frombuffer(c, "<i8")
    flat = table_.ravel()
    # the median stands for chance: common phrases do not move it
    usual = float(np.median(flat))
    return flat > usual + 6 * usual**0.5 + 16


def anchors(h: np.ndarray) -> np.ndarray:
    """For the window at each place, the place of its anchor (leftmost of the smallest hashes)."""
    width = WINDOW - KMER + 1
    if len(h) < width:
        return np.zeros(0, np.int64)
    v = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    if span < width:
        v = np.minimum(v[: len(v) - (width - span)], v[width - span :])
    return (v & _POS).astype(np.int64)


def pieces(n: int) -> Iterator[tuple[int, int]]:
    """Overlapping stretches of a very long text, so that every window lies in one that is whole."""
    step = (1 << _POS_BITS) - WINDOW
    at = 0
    while True:
        yield at, min(n, at + step + WINDOW - 1)
        at += step
        if at + WINDOW > n:
            return


def text_anchors(a: np.ndarray, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(anchor place of each window of one text, the anchors' hashes)."""
    if len(a) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place, value = [], []
    for s, e in pieces(len(a)):
        h = kmer_hashes(a[s:e], hot)
        m = anchors(h)
        place.append(m + s)
        value.append(mix64(h[m]))
    return np.concatenate(place), np.concatenate(value)


ROW, SEEN, ANCHOR = 0, 1, 2
WIDE = pa.schema([("route", pa.int64()), ("kind", pa.int8()), ("d", pa.int64()), ("p", pa.int64()), ("n", pa.int64()), ("name", pa.binary())])
WIDE_DDL = "route bigint, kind byte, d bigint, p bigint, n bigint, name binary"


def _wide(kind: int, route, d, p, n=None, name=None) -> pa.RecordBatch:
    size = len(d)
    return pa.RecordBatch.from_arrays([
        pa.array(route, pa.int64()), pa.array(np.full(size, kind, np.int8)), pa.array(d, pa.int64()), pa.array(p, pa.int64()),
        pa.array(n, pa.int64()) if n is not None else pa.nulls(size, pa.int64()), pa.array(name, pa.binary()) if name is not None else pa.nulls(size, pa.binary()),
    ], schema=WIDE)


def anchor_rows(docs: DataFrame, shared) -> DataFrame:
    """A ROW of every document, and an ANCHOR for every anchor whose k-mer occurs again anywhere.

    ``docs`` is (d, text) with d never null. ``p`` holds the text's tag in its high half (rows
    of one id are told apart by it) and a place in its low half. A task sends one row for a k-mer
    that it has many times: those places are known to be repeated without it. ``shared`` is a
    broadcast of ``hot_kmers``.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, ds, ps = [], [], []
        held = 0

        def settle() -> Iterator[pa.RecordBatch]:
            h, d, p = np.concatenate(hs), np.concatenate(ds), np.concatenate(ps)
            order = np.argsort(h, kind="stable")
            h, d, p = h[order], d[order], p[order]
            start = np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0]
            length = np.diff(np.concatenate([start, [len(h)]]))
            many = np.repeat(length > 1, length)
            lone = ~many
            for at in range(0, int(lone.sum()), 200_000):
                part = np.nonzero(lone)[0][at : at + 200_000]
                yield _wide(SEEN, h[part].view(np.int64), d[part], p[part])
            first = start[length > 1]
            yield _wide(SEEN, h[first].view(np.int64), d[first], np.full(len(first), -1))
            for at in range(0, int(many.sum()), 200_000):
                part = np.nonzero(many)[0][at : at + 200_000]
                yield _wide(ANCHOR, mix64((p[part] + d[part] * 31).view(np.uint64)).view(np.int64), d[part], p[part])

        for b in batches:
            data, offsets = text_column(b.column(1))
            ids = b.column(0).to_numpy()
            for lo, hi in slices(offsets):
                off = offsets[lo : hi + 1] - offsets[lo]
                a = data[offsets[lo] : offsets[hi]]
                raws = [a[off[i] : off[i + 1]].tobytes() for i in range(hi - lo)]
                crc = np.array([text_tag(r) for r in raws], np.int64)
                yield _wide(ROW, mix64(ids[lo:hi].astype(np.int64).view(np.uint64)).view(np.int64), ids[lo:hi], crc << 32, np.diff(off), [hashlib.sha256(r).digest() for r in raws])
                if hi - lo > 1:
                    h = kmer_hashes(a, shared.value)
                    m = anchors(h)
                    at = np.arange(len(m))
                    row = np.searchsorted(off, at, "right") - 1
                    inside = at + WINDOW <= off[row + 1]
                    m = np.unique(m[inside])
                    v = mix64(h[m])
                    row = np.searchsorted(off, m, "right") - 1
                    local = m - off[row]
                else:
                    m, v = text_anchors(a, shared.value)
                    local, first = np.unique(m, return_index=True)
                    v, row = v[first], np.zeros(len(local), np.int64)
                if len(local):
                    hs.append(v)
                    ds.append(ids[lo + row].astype(np.int64))
                    ps.append((crc[row] << 32) | local)
                    held += len(local)
                if held > 1_000_000:
                    yield from settle()
                    hs, ds, ps, held = [], [], [], 0
        if held:
            yield from settle()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for b in batches:
            kind = b.column(1).to_numpy()
            other = np.nonzero(kind != SEEN)[0]
            if len(other):
                yield b.take(pa.array(other))
            own = b.take(pa.array(np.nonzero(kind == SEEN)[0]))
            got.append(tuple(own.column(i).to_numpy() for i in (0, 2, 3)))
        if not got:
            return
        h, d, p = (np.concatenate([g[i] for g in got]) for i in range(3))
        order = np.argsort(h, kind="stable")
        h, d, p = h[order], d[order], p[order]
        if not len(h):
            return
        start = np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0]
        length = np.diff(np.concatenate([start, [len(h)]]))
        known = np.minimum.reduceat(p, start) < 0
        again = np.repeat((length > 1) | known, length) & (p >= 0)
        yield _wide(ANCHOR, h[again], d[again], p[again])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.mapInArrow(trimmed(emit), WIDE_DDL).repartition(n, "route").mapInArrow(trimmed(meet), WIDE_DDL).drop("route")


# -- sorted runs ---------------------------------------------------------------------------------


def front_code(strings: list[bytes], d: np.ndarray, p: np.ndarray) -> bytes:
    """Sorted strings as shared-prefix lengths and rests, with their documents and places."""
    n = len(strings)
    lens = np.array([len(s) for s in strings], np.int64)
    width = int(lens.max())
    m = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(n, width)
    lcp = np.zeros(n, np.int64)
    if n > 1:
        differ = m[1:] != m[:-1]
        lcp[1:] = np.where(differ.any(1), differ.argmax(1), width)
        lcp[1:] = np.minimum(lcp[1:], np.minimum(lens[1:], lens[:-1]))
    rests = b"".join(s[c:] for s, c in zip(strings, lcp.tolist()))
    return b"".join([np.array([n], "<u4").tobytes(), lcp.astype("<u2").tobytes(), (lens - lcp).astype("<u2").tobytes(), d.astype("<i8").tobytes(), p.astype("<i8").tobytes(), rests])


def decode_run(blocks: list[bytes]) -> Iterator[tuple[bytes, int, int, int]]:
    """(string, prefix shared with the string before, document, place) of a run's blocks in order."""
    before = b""
    for raw in blocks:
        n = int(np.frombuffer(raw, "<u4", 1)[0])
        lcp = np.frombuffer(raw, "<u2", n, 4).tolist()
        rest = np.frombuffer(raw, "<u2", n, 4 + 2 * n).tolist()
        d = np.frombuffer(raw, "<i8", n, 4 + 4 * n).tolist()
        p = np.frombuffer(raw, "<i8", n, 4 + 12 * n).tolist()
        at = 4 + 20 * n
        for i in range(n):
            s = before[: lcp[i]] + raw[at : at + rest[i]]
            at += rest[i]
            # a block starts with a whole string; what it shares with the one before is found once
            yield s, lcp[i] if i else shared_prefix(before, s, 0), d[i], p[i]
            before = s


def shared_prefix(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix, of which ``at`` bytes are known."""
    n = min(len(a), len(b))
    while at < n and a[at : at + 16] == b[at : at + 16]:
        at += 16
    if at >= n:
        return n
    while at < n and a[at] == b[at]:
        at += 1
    return at


class LoserTree:
    """Merges sorted streams of (string, shared prefix, ...); every string knows what it shares with
    the last one put out, and two strings are compared only from there on."""

    def __init__(self, streams: list[Iterator[tuple[bytes, int, int, int]]]):
        self.k = 1 << max(0, (len(streams) - 1).bit_length())
        self.streams = streams
        self.now: list[tuple | None] = [next(s, None) for s in streams] + [None] * (self.k - len(streams))
        self.known = [0] * self.k
        self.loser = [0] * self.k
        self.compared = 0
        self.loser[0] = self._play(1)

    def _beats(self, i: int, j: int) -> bool:
        """Does i come before j? Sets what the loser shares with the winner."""
        a, b = self.now[i], self.now[j]
        if b is None:
            return True
        if a is None:
            return False
        x, y = self.known[i], self.known[j]
        if x != y:
            return x > y
        h = shared_prefix(a[0], b[0], x)
        self.compared += h - x + 1
        first = a[0][h:] <= b[0][h:] if h < min(len(a[0]), len(b[0])) else len(a[0]) <= len(b[0])
        if first:
            self.known[j] = h
        else:
            self.known[i] = h
        return first

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        i, j = self._play(2 * node), self._play(2 * node + 1)
        if self._beats(i, j):
            self.loser[node] = j
            return i
        self.loser[node] = i
        return j

    def __iter__(self) -> Iterator[tuple[bytes, int, int, int]]:
        while True:
            w = self.loser[0]
            item = self.now[w]
            if item is None:
                return
            yield item[0], self.known[w], item[2], item[3]
            nxt = next(self.streams[w], None)
            self.now[w] = nxt
            self.known[w] = nxt[1] if nxt is not None else 0
            node = (w + self.k) >> 1
            while node:
                if not self._beats(w, self.loser[node]):
                    w, self.loser[node] = self.loser[node], w
                node >>= 1
            self.loser[0] = w


# a suffix string: hash (8 bytes), text from the anchor on, text before the anchor, both lengths
def suffix_string(value: int, raw: bytes, first: int, last: int, anchor: int) -> bytes:
    right, left = raw[anchor : last + WINDOW], raw[first:anchor]
    return value.to_bytes(8, "big") + right + left + len(right).to_bytes(2, "big") + len(left).to_bytes(2, "big")


def sides(s: bytes) -> tuple[int, bytes]:
    """(bytes from the anchor on, the bytes before the anchor backwards) of a suffix string."""
    left = int.from_bytes(s[-2:], "big")
    return len(s) - 12 - left, s[len(s) - 4 - left : len(s) - 4][::-1]


#: Stretches of one anchor up to this many are compared two by two, more by ranks.
FEW = 24


def repeated_windows(group: list[tuple[bytes, int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(document, place, end) of the windows that occur earlier, among stretches with one anchor.

    ``group`` has distinct suffix strings in merged order, each with the prefix it shares with the one
    before it (as the merge knows it), and the earliest document and place that it occurs at. Two
    stretches have a window in common that starts l bytes before the anchor exactly if they share
    WINDOW - l bytes from the anchor on, which is the smallest shared prefix on the way from one to the other,
    and l bytes before it; no window is looked at again. Spans may overlap.
    """
    both = [sides(s) for s, *_ in group]
    share = [lcp - 8 for _, lcp, _, _ in group]
    found = _by_pairs(group, both, share) if len(group) <= FEW else _by_ranks(group, both, share)
    for i, low, high in found:
        _, _, d, p = group[i]
        # a window that starts l bytes before the anchor is at place p + left - l
        at = p + len(both[i][1])
        yield d, at - high, at - low + WINDOW


def _by_pairs(group: list, both: list[tuple[int, bytes]], share: list[int]) -> Iterator[tuple[int, int, int]]:
    """(stretch, smallest l, largest l) of windows that an earlier stretch has."""
    for i in range(len(group)):
        right, left = both[i]
        agree, mine = WINDOW, group[i][2:]
        for j in range(i + 1, len(group)):
            agree = min(agree, share[j])
            low = WINDOW - min(agree, right, both[j][0])
            back = both[j][1]
            if low <= len(left) and low <= len(back) and left[:low] == back[:low]:
                yield (j if group[j][2:] > mine else i), low, shared_prefix(left, back, low)


def _by_ranks(group: list, both: list[tuple[int, bytes]], share: list[int]) -> Iterator[tuple[int, int, int]]:
    """As ``_by_pairs`` without comparing pairs: stretches are equal on either side if no smaller shared
    prefix lies between them, in merged order and in the order of the bytes before the anchor."""
    n = len(group)
    right, left = np.array([r for r, _ in both], np.int64), np.array([len(x) for _, x in both], np.int64)
    fore = np.array(share, np.int64)
    fore[0] = -1
    order = np.array(sorted(range(n), key=lambda i: group[i][2:]))
    back = sorted(range(n), key=lambda i: both[i][1])
    near = np.array([-1] + [shared_prefix(both[x][1], both[y][1], 0) for x, y in zip(back, back[1:])], np.int64)
    back = np.array(back)
    cls = np.empty(n, np.int64)
    again = np.zeros((n, int(left.max()) + 3), np.int8)
    for x in range(int(left.max()) + 1):
        live = order[((left >= x) & (right >= WINDOW - x))[order]]
        if len(live) < 2:
            continue
        run = np.cumsum(fore < WINDOW - x)
        cls[back] = np.cumsum(near < x)
        _, first = np.unique(run[live] * (n + 1) + cls[live], return_index=True)
        again[live, x + 1] = 1
        again[live[first], x + 1] = 0
    step = np.diff(again, axis=1)
    rows, low = np.nonzero(step == 1)
    _, high = np.nonzero(step == -1)
    yield from zip(rows.tolist(), low.tolist(), (high - 1).tolist())


RUN, SPAN = 0, 1
EXCHANGE = pa.schema([("route", pa.int64()), ("kind", pa.int8()), ("run", pa.int64()), ("d", pa.int64()), ("p", pa.int64()), ("e", pa.int64()), ("block", pa.binary())])
EXCHANGE_DDL = "route bigint, kind byte, run bigint, d bigint, p bigint, e bigint, block binary"


def _spans(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    d, p, e = (np.array(x, np.int64) for x in zip(*found))
    n = len(d)
    route = -1 - (mix64((d * 31 + p).view(np.uint64)) >> np.uint64(1)).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(route), pa.array(np.full(n, SPAN, np.int8)), pa.nulls(n, pa.int64()), pa.array(d), pa.array(p), pa.array(e), pa.nulls(n, pa.binary())], schema=EXCHANGE)


def repeated_spans(docs: DataFrame, shared) -> DataFrame:
    """(d, p, e): spans covered by windows that occur earlier. ``docs`` is (d, text, ps) with the
    repeated anchors of each text; spans may overlap, and p and e bear the tag as above."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_ranges = RANGES_EACH * n

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        best: dict[bytes, tuple[int, int]] = {}
        found: list[tuple[int, int, int]] = []
        runs = 0

        def flush() -> Iterator[pa.RecordBatch]:
            strings = sorted(best)
            d, p = (np.array([best[s][i] for s in strings], np.int64) for i in range(2))
            value = np.array([int.from_bytes(s[:8], "big") for s in strings], np.uint64)
            where = ((value >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int64)
            cuts = np.nonzero(np.diff(where))[0] + 1
            name = task << 20 | runs
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(strings)]):
                block = front_code(strings[s:e], d[s:e], p[s:e])
                yield pa.RecordBatch.from_arrays([pa.array([int(where[s])], pa.int64()), pa.array([RUN], pa.int8()), pa.array([name], pa.int64()), *[pa.nulls(1, pa.int64())] * 3, pa.array([block], pa.binary())], schema=EXCHANGE)

        for b in batches:
            for d, text, ps in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                raw = (text or "").encode("utf-8", "surrogatepass")
                a = np.frombuffer(raw, np.uint8)
                m, v = text_anchors(a, shared.value)
                if not len(m):
                    continue
                base = text_tag(raw) << 32
                repeated = np.sort(ps.values.to_numpy() & 0xFFFFFFFF)
                start = np.nonzero(np.concatenate([[True], m[1:] != m[:-1]]))[0]
                stop = np.concatenate([start[1:], [len(m)]]) - 1
                at = np.minimum(np.searchsorted(repeated, m[start]), len(repeated) - 1)
                hit = repeated[at] == m[start]
                for s, e, k, val in zip(start[hit].tolist(), stop[hit].tolist(), m[start][hit].tolist(), v[start][hit].tolist()):
                    string = suffix_string(val, raw, s, e, k)
                    mine = (d, base | s)
                    other = best.setdefault(string, mine)
                    if other is not mine:
                        late = max(mine, other)
                        best[string] = min(mine, other)
                        if late != other or mine != other:
                            found.append((late[0], late[1], late[1] + e - s + WINDOW))
                if len(best) >= RUN_SUFFIXES:
                    yield from flush()
                    best, runs = {}, runs + 1
                if len(found) >= 100_000:
                    yield _spans(found)
                    found = []
        if best:
            yield from flush()
        if found:
            yield _spans(found)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[tuple[int, bytes]]] = {}
        for b in batches:
            kind = b.column(1).to_numpy()
            other = np.nonzero(kind == SPAN)[0]
            if len(other):
                yield b.take(pa.array(other))
            for i in np.nonzero(kind == RUN)[0].tolist():
                blocks.setdefault(b.column(2)[i].as_py(), []).append((b.column(0)[i].as_py(), b.column(6)[i].as_py()))
        if not blocks:
            return
        streams = [decode_run([x for _, x in sorted(v, key=lambda t: t[0])]) for v in blocks.values()]
        blocks = {}
        group: list[tuple[bytes, int, int, int]] = []
        found: list[tuple[int, int, int]] = []
        for s, lcp, d, p in LoserTree(streams):
            if group and lcp < 8 + KMER:
                if len(group) > 1:
                    found += repeated_windows(group)
                group = []
            if group and lcp == len(s) == len(group[-1][0]):
                _, shared_, d0, p0 = group[-1]
                late = max((d, p), (d0, p0))
                if (d, p) != (d0, p0):
                    found.append((late[0], late[1], late[1] + len(s) - 12))
                    group[-1] = (s, shared_, *min((d, p), (d0, p0)))
            else:
                group.append((s, lcp, d, p))
            if len(found) >= 100_000:
                yield _spans(found)
                found = []
        if len(group) > 1:
            found += repeated_windows(group)
        if found:
            yield _spans(found)

    return docs.mapInArrow(trimmed(emit), EXCHANGE_DDL).repartition(n, "route").mapInArrow(trimmed(merge), EXCHANGE_DDL).select("d", "p", "e")


def _with_text(docs: DataFrame, keyed: DataFrame) -> DataFrame:
    """Join texts to facts by (d, h); a checked number of ids is broadcast first, so that only their
    texts are shuffled."""
    ids = keyed.select("d").distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    some = docs.join(F.broadcast(ids), "d", "left_semi") if few else docs
    return some.withColumn("h", F.crc32("text").bitwiseAND(0x7FFFFFFF)).join(keyed.hint("merge"), ["d", "h"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row.

    A byte is removed when a WINDOW-byte string that covers it also starts earlier: in a row of a
    smaller id, or earlier in the same text. Rows of one id are documents of their own, in the order
    of their texts' tags; rows equal throughout are one document and get one result. Null ids come
    before all others, null texts are empty, and texts shorter than the window lose nothing. ``kept``
    holds what is left, only where something was removed and something is left.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("d"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shared = rows.sparkSession.sparkContext.broadcast(hot_kmers(rows))
    found = materialize(anchor_rows(rows, shared), "repeat-anchors")
    high = F.shiftright("p", 32)
    every = found.where(F.col("kind") == ROW).select("d", high.alias("h"), F.col("n").alias("n_bytes"), F.lower(F.hex("name")).alias("sha"))
    every = materialize(attach_groups(every, "sha", {"first": F.min("d")}, "repeat-texts"), "repeat-rows")
    copies = every.where("first < d")
    listed = found.where(F.col("kind") == ANCHOR).select("d", high.alias("h"), "p").join(copies.select("d", "h").distinct(), ["d", "h"], "left_anti")
    listed = materialize(listed.groupBy("d", "h").agg(F.collect_set("p").alias("ps")), "repeat-lists")
    spans = materialize(repeated_spans(_with_text(rows, listed).select("d", "text", "ps"), shared), "repeat-spans")
    merged = spans.groupBy("d", F.shiftright("p", 32).alias("h")).agg(F.collect_list(F.struct("p", "e")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column(2).to_pylist(), b.column(3)):
                raw = text.encode("utf-8", "surrogatepass")
                flat = spans.values.flatten()
                s, e = (np.sort(x.to_numpy() & 0xFFFFFFFF) for x in flat)
                step = np.zeros(len(raw) + 1, np.int64)
                np.add.at(step, s, 1)
                np.add.at(step, e, -1)
                gone = np.cumsum(step[:-1]) > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.binary())], ["d", "h", "r", "s", "k", "kept"])

    cutout = _with_text(rows, materialize(merged, "repeat-merged")).select("d", "h", "text", "spans").mapInArrow(trimmed(cut), "d bigint, h bigint, r bigint, s bigint, k string, kept binary").dropDuplicates(["d", "h"])
    joined = every.join(cutout, ["d", "h"], "left")
    whole = (F.col("first") < F.col("d")) & (F.col("n_bytes") >= WINDOW)
    zero = F.lit(0).cast("long")
    return joined.select(
        F.when(F.col("d") != NULL_ID, F.col("d")).alias(id_col), "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("r", zero)).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("s", zero)).alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("k", "sha")).alias("kept_sha256"),
        F.when(whole, F.lit(None)).otherwise(F.col("kept")).alias("kept"),
    )


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")
