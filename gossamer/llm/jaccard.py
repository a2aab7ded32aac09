"""N-gram Jaccard join by universe partition and the pigeonhole principle.

Sets are put into bands by size; a band's largest possible symmetric difference k of two linked
sets is known. Each band splits the universe of shingles into segments by a hash. Two sets that
differ in at most k shingles agree on all but k segments, so when each puts its segments in one
order and indexes the first k + 1, the two share an indexed segment. The order is by cost: segments
of shingles that many documents hold come last. Where a band is small and full, half as many
segments are indexed with their one-deletion neighbourhoods instead: a segment then bears one
difference, and (k + 1) / 2 segments suffice. What meets in a bucket is verified exactly.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from gossamer.llm.bytesets import mix64, shingle_sets, slices, text_column, word_hashes
from gossamer.llm.groups import attach_groups
from gossamer.operators.components import connected_components
from gossamer.session import bounded_batches, materialize, table, trimmed

#: Segments beyond the k + 1 that are indexed, as a share of them: room to leave costly ones out.
SPARE = 0.5
#: Slots of the table of frequent shingles: 2 ** HOT_BITS counters, whatever the input.
HOT_BITS = 20
#: A slot is hot when its count is so many standard deviations of a chance count above the mean.
HOT_SIGMAS = 6
#: Up to this many sets of a bucket are paired at once; a larger bucket takes the two-step way.
SMALL_BUCKET = 8
#: A task sorts and sends its index rows when it holds so many.
SETTLE_KEYS = 400_000
#: Cells of a set's sketch.
CELLS = 256
#: Sets of a block, and columns of a block's matrix that are held at once.
BLOCK_SETS = 512
MATRIX_COLUMNS = 2048
#: Cost of one index row against one expected pair that fails verification.
PAIR_COST = 20.0
#: So many candidate ids are broadcast at most (8 bytes each); beyond it the join is shuffled.
BROADCAST_IDS = 2_000_000


class Bands:
    """Size bands and what each indexes, for links of num/den Jaccard similarity or more."""

    def __init__(self, num: int, den: int, counts: dict[int, int] | None = None):
        self.num, self.den = num, den
        self.counts = counts or {}
        self.edges: list[tuple[int, int]] = []
        self.layouts: dict[int, tuple[int, int, bool]] = {}
        self._grow(1)

    def _grow(self, size: int) -> None:
        while not self.edges or self.edges[-1][1] < size:
            lo = self.edges[-1][1] + 1 if self.edges else 1
            self.edges.append((lo, max(lo, lo * self.den // self.num)))

    def band(self, size: int) -> int:
        self._grow(size * 2)
        lo, hi = 0, len(self.edges) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            if self.edges[mid][1] < size:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def largest_difference(self, band: int) -> int:
        """Largest symmetric difference of two linked sets of at most the band's size."""
        self._grow(self.edges[-1][1] * 2 if band >= len(self.edges) else 1)
        while band >= len(self.edges):
            self._grow(self.edges[-1][1] + 1)
        top = self.edges[band][1]
        return 2 * top * (self.den - self.num) // (self.den + self.num)

    def prefix(self, size: int, band: int) -> int:
        """Segments a set must index in a band: one more than it can differ from a linked set there."""
        largest = min(self.edges[band][1], size * self.den // self.num)
        return (size + largest) * (self.den - self.num) // (self.den + self.num) + 1

    def layout(self, band: int) -> tuple[int, int, bool]:
        if band not in self.layouts:
            self.layouts[band] = self._layout(band)
        return self.layouts[band]

    def _layout(self, band: int) -> tuple[int, int, bool]:
        """(segments, how many are indexed, with one-deletion neighbourhoods?) by expected cost.

        Cost is index rows plus expected pairs of unrelated sets. Those agree on a segment mainly
        where both are empty (Poisson); the order puts empty segments last, so an exact layout
        indexes only as many as exceed the spare ones. A segment with one deletion meets another
        where both hold one shingle or none.
        """
        k = self.largest_difference(band)
        if k == 0:
            return 1, 1, False
        n = self.counts.get(band, 0) + self.counts.get(band - 1, 0)
        size = sum(self.edges[band]) / 2
        keep = k + 1
        spare = math.ceil(SPARE * keep)
        total = keep + spare
        q = math.exp(-size / total)
        over = sum((j - spare) * math.exp(math.lgamma(total + 1) - math.lgamma(j + 1) - math.lgamma(total - j + 1) + j * math.log(q) + (total - j) * math.log1p(-q)) for j in range(spare + 1, total + 1))
        exact = keep + PAIR_COST * n / 2 * over**2 / total
        half = (k + 2) // 2
        wide = size / half
        deletion = half + size + PAIR_COST * n / 2 * half * (math.exp(-wide) * (1 + wide)) ** 2
        return (half, half, True) if deletion < exact else (total, keep, False)


def signatures(s: np.ndarray, bands: Bands, hot: np.ndarray) -> np.ndarray:
    """Index keys of one sorted set: for its own band, and for the next, where larger sets look."""
    out = []
    own = bands.band(len(s))
    for band in (own, own + 1):
        total, keep, deletions = bands.layout(band)
        if band > own and len(s) * bands.den // bands.num < bands.edges[band][0]:
            continue  # no linked set is that large
        if keep < total:
            keep = bands.prefix(len(s), band)
        salt = np.uint64((band + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        h = mix64(s + salt)
        seg = ((h >> np.uint64(32)) * np.uint64(total) >> np.uint64(32)).astype(np.int64)
        sums = np.zeros(total, np.uint64)
        order = np.argsort(seg, kind="stable")
        sorted_seg = seg[order]
        starts = np.nonzero(np.concatenate([[True], sorted_seg[1:] != sorted_seg[:-1]]))[0]
        sums[sorted_seg[starts]] = np.add.reduceat(mix64(h ^ salt)[order], starts)
        name = mix64(np.arange(total, dtype=np.uint64) + salt)
        keys = mix64(sums ^ name)
        if deletions:
            out += [keys, mix64((sums[seg] - mix64(h ^ salt)) ^ name[seg])]
        elif keep < total:
            cheap = np.zeros(total, np.int64)
            rare = seg[~hot[(s >> np.uint64(64 - HOT_BITS)).astype(np.int64)]]
            cheap[rare] = 1
            out.append(keys[np.lexsort((keys, -cheap))[:keep]])
        else:
            out.append(keys)
    return np.concatenate(out)


def set_name(s: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    a = np.add.reduce(mix64(s + np.uint64(1))) if len(s) else np.uint64(0)
    b = np.bitwise_xor.reduce(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))) if len(s) else np.uint64(0)
    return int(a).to_bytes(8, "little") + int(b).to_bytes(8, "little")


def sets_of(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    data, offsets = text_column(batch.column(1))
    for lo, hi in slices(offsets):
        words, at = word_hashes(data, offsets[lo : hi + 1])
        for i, s in enumerate(shingle_sets(words, at, k)):
            yield lo + i, s


def survey(docs: DataFrame, k: int, bands: Bands) -> tuple[np.ndarray, dict[int, int]]:
    """Slots of shingles that are more frequent than chance, and documents by band.

    Every task sends one table of 2**HOT_BITS counters; the sums are as large for any input.
    """
    rows = 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.zeros(1 << HOT_BITS, np.int64)
        sizes: dict[int, int] = {}
        for b in batches:
            held, n = [], 0
            for _, s in sets_of(b, k):
                if len(s):
                    held.append(s)
                    n += len(s)
                    band = bands.band(len(s))
                    sizes[band] = sizes.get(band, 0) + 1
                if n > 500_000:
                    t += np.bincount((np.concatenate(held) >> np.uint64(64 - HOT_BITS)).astype(np.int64), minlength=len(t))
                    held, n = [], 0
            if held:
                t += np.bincount((np.concatenate(held) >> np.uint64(64 - HOT_BITS)).astype(np.int64), minlength=len(t))
        if t.any():
            parts = np.minimum(t, 65535).astype("<u2").reshape(rows, -1)
            # a count over the limit is hot in any case
            yield pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "counts"])
            yield pa.RecordBatch.from_arrays([pa.array([-1 - x for x in sizes], pa.int32()), pa.array([int(v).to_bytes(8, "little") for v in sizes.values()], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = np.frombuffer(c, "<u2").astype(np.int64) if p >= 0 else np.frombuffer(c, "<i8")
                sums[p] = sums[p] + v if p in sums else v
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())], ["part", "counts"])

    got = docs.mapInArrow(trimmed(count), "part int, counts binary").repartition(rows, "part").mapInArrow(trimmed(add), "part int, counts binary").collect()
    table_ = np.zeros((rows, (1 << HOT_BITS) // rows), np.int64)
    sizes = {}
    for p, c in got:
        if p >= 0:
            table_[p] = np.frombuffer(c, "<i8")
        else:
            sizes[-1 - p] = int.from_bytes(c, "little")
    flat = table_.ravel()
    mean = flat.mean()
    return flat > mean + HOT_SIGMAS * mean**0.5 + 16, sizes


ROW, BUCKET, PAIR, MEMBER = 0, 1, 2, 3
WIDE = pa.schema([("route", pa.int64()), ("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("name", pa.binary())])
WIDE_DDL = "route bigint, kind byte, a bigint, b bigint, n bigint, name binary"


def _rows(kind: int, route, a, b, n, name=None) -> pa.RecordBatch:
    size = len(a)
    return pa.RecordBatch.from_arrays([pa.array(route, pa.int64()), pa.array(np.full(size, kind, np.int8)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64()), pa.array(name, pa.binary()) if name is not None else pa.nulls(size, pa.binary())], schema=WIDE)


#: Key ranges a shuffle partition gets on average.
RANGES_EACH = 6


def pack_rows(key: np.ndarray, doc: np.ndarray, size: np.ndarray) -> bytes:
    """Rows of one range of keys: 48 bits of each key, ids from their least, sizes; about 11 bytes a row."""
    base = int(doc.min())
    rest = (doc - base).astype(np.uint64)
    width = 4 if int(rest.max()) < 1 << 32 else 8
    docs = zlib.compress(rest.astype(f"<u{width}").tobytes(), 1)
    sizes = zlib.compress(size.astype("<i4").tobytes(), 1)
    k = key.view(np.uint64) >> np.uint64(16)
    return b"".join([struct.pack("<IBqI", len(key), width, base, len(docs)), (k & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), (k >> np.uint64(32)).astype("<u2").tobytes(), docs, sizes])


def unpack_rows(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, width, base, size = struct.unpack_from("<IBqI", raw)
    at = struct.calcsize("<IBqI")
    k = np.frombuffer(raw, "<u4", n, at).astype(np.uint64) | np.frombuffer(raw, "<u2", n, at + 4 * n).astype(np.uint64) << np.uint64(32)
    at += 6 * n
    docs = np.frombuffer(zlib.decompress(raw[at : at + size]), f"<u{width}").astype(np.int64) + base
    return (k << np.uint64(16)).view(np.int64), docs, np.frombuffer(zlib.decompress(raw[at + size :]), "<i4").astype(np.int64)


def _buckets(key: np.ndarray, doc: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows sorted by (key, doc) without repeats, each with its bucket's start and length."""
    order = np.lexsort((doc, key))
    key, doc, size = key[order], doc[order], size[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc, size = key[fresh], doc[fresh], size[fresh]
    start = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0] if len(key) else np.zeros(0, np.int64)
    length = np.diff(np.concatenate([start, [len(key)]]))
    return key, doc, size, start, length


def _close(x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
    """Can sets of these sizes be linked at all?"""
    return den * np.minimum(x, y) >= num * np.maximum(x, y)


def _pairs(doc, size, start, length, num, den) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within buckets of up to SMALL_BUCKET sets."""
    lo, hi = [], []
    for m in range(2, SMALL_BUCKET + 1):
        s = start[length == m]
        for i in range(m if len(s) else 0):
            for j in range(i + 1, m):
                ok = _close(size[s + i], size[s + j], num, den)
                lo.append(doc[s + i][ok])
                hi.append(doc[s + j][ok])
    if not lo:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo, hi = np.concatenate(lo), np.concatenate(hi)
    order = np.lexsort((hi, lo))
    lo, hi = lo[order], hi[order]
    fresh = np.ones(len(lo), bool)
    fresh[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    return lo[fresh], hi[fresh]


def index_rows(docs: DataFrame, k: int, bands: Bands, hot) -> DataFrame:
    """Rows of every document, candidate pairs, and members of large buckets; one shuffle.

    A task indexes a set once, however many copies it holds, and sends one row for a key that
    more than SMALL_BUCKET of its sets share: what the others need is found within the task.
    """
    num, den = bands.num, bands.den
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_ranges = RANGES_EACH * n
    shared = docs.sparkSession.sparkContext.broadcast((bands, hot))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, hot = shared.value
        seen: set[bytes] = set()
        keys, ids, sizes = [], [], []
        pending = 0

        def settle() -> Iterator[pa.RecordBatch]:
            reps = [n for n, _ in sizes]
            key, doc, size, start, length = _buckets(np.concatenate(keys), np.repeat(np.array(ids, np.int64), reps), np.repeat(np.array([n for _, n in sizes], np.int64), reps))
            few = np.repeat(length <= SMALL_BUCKET, length)
            first = np.zeros(len(key), bool)
            first[start] = True
            big = np.repeat(length > SMALL_BUCKET, length)
            send = few | first
            # the sign of n says that the task has more sets of this key
            kk, d, z = key[send], doc[send], np.where(big, -size, size)[send]
            where = ((kk.view(np.uint64) >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            kk, d, z, where = kk[order], d[order], z[order], where[order]
            cuts = [0, *(np.nonzero(np.diff(where))[0] + 1).tolist(), len(where)]
            for at in range(0, len(cuts) - 1, 64):
                spans = list(zip(cuts[at : at + 64], cuts[at + 1 : at + 65]))
                none = [None] * len(spans)
                yield _rows(BUCKET, [int(where[s]) for s, _ in spans], none, none, none, [pack_rows(kk[s:e], d[s:e], z[s:e]) for s, e in spans])
            if big.any():
                mk, md, ms = key[big & ~first], doc[big & ~first], size[big & ~first]
                yield _rows(MEMBER, mix64(md.view(np.uint64) ^ mk.view(np.uint64)).view(np.int64), mk, md, ms)

        for b in batches:
            doc = b.column(0).to_pylist()
            rows: list[tuple] = []
            for i, s in sets_of(b, k):
                name = set_name(s) if len(s) else None
                rows.append((doc[i], len(s), name))
                if name is None or doc[i] is None or name in seen:
                    continue
                seen.add(name)
                sig = (signatures(s, bands, hot) & ~np.uint64(0xFFFF)).view(np.int64)  # 48 bits tell buckets apart
                keys.append(sig)
                ids.append(doc[i])
                sizes.append((len(sig), len(s)))
                pending += len(sig)
            yield _rows(ROW, mix64(np.arange(len(rows), dtype=np.uint64) + np.uint64(len(ids))).view(np.int64), [r[0] for r in rows], [None] * len(rows), [r[1] for r in rows], [r[2] for r in rows])
            if pending > SETTLE_KEYS:
                yield from settle()
                keys, ids, sizes, pending = [], [], [], 0
        if keys:
            yield from settle()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed: dict[int, list[bytes]] = {}
        for b in batches:
            kind = b.column(1).to_numpy()
            other = np.nonzero(kind != BUCKET)[0]
            if len(other):
                yield b.take(pa.array(other))
            for i in np.nonzero(kind == BUCKET)[0].tolist():
                packed.setdefault(b.column(0)[i].as_py(), []).append(b.column(5)[i].as_py())
        # one range of keys at a time; the others stay packed
        for route in sorted(packed):
            got = [unpack_rows(x) for x in packed.pop(route)]
            key, doc, size, start, length = _buckets(*[np.concatenate([g[i] for g in got]) for i in range(3)])
            del got
            more = np.add.reduceat((size < 0).astype(np.int64), start) > 0
            size = np.abs(size)
            a, c = _pairs(doc, size, start[~more], length[~more], num, den)
            if len(a):
                yield _rows(PAIR, a, a, c, np.zeros(len(a), np.int64))
            large = np.repeat((length > SMALL_BUCKET) | more, length)
            if large.any():
                yield _rows(MEMBER, key[large], key[large], doc[large], size[large])

    return docs.mapInArrow(trimmed(emit), WIDE_DDL).repartition(n, "route").mapInArrow(trimmed(meet), WIDE_DDL).drop("route")


def sketch(s: np.ndarray) -> bytes:
    """How many elements fall into each of CELLS cells, 255 at most."""
    return np.minimum(np.bincount((s >> np.uint64(8)).astype(np.int64) & (CELLS - 1), minlength=CELLS), 255).astype(np.uint8).tobytes()


def document_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, n, set, sketch) of the documents with these ids."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    side = F.broadcast(ids) if few else ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(len(s), s.tobytes(), sketch(s)) for _, s in sets_of(b, k)]
            n, sets, marks = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(marks, pa.binary())], ["id", "n", "set", "sketch"])

    chosen = docs.withColumnRenamed(docs.columns[0], "id").join(side, "id", "left_semi")
    return chosen.mapInArrow(trimmed(run), "id bigint, n bigint, set binary, sketch binary")


def narrowed(sets: DataFrame, rows: DataFrame, col: str) -> DataFrame:
    """The sets that ``rows`` name in a column; a checked number of ids is broadcast, so the others
    are not shuffled."""
    ids = rows.select(F.col(col).alias("id")).distinct()
    return sets.join(F.broadcast(ids), "id", "left_semi") if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else sets


def plausible(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sketches allow a link: sets differ at least by the sum of their cells'
    differences (a full cell tells nothing). Only sketches are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int64) for i in (2, 3))
            apart = np.where((x < 255) & (y < 255), np.abs(x - y), 0).sum(1)
            total = b.column(4).to_numpy() + b.column(5).to_numpy()
            keep = pa.array(np.nonzero(apart * (den + num) <= (den - num) * total)[0])
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep)], ["a", "b"])

    sa, sb = (sets.select(F.col("id").alias(i), F.col("sketch").alias("s" + i), F.col("n").alias("n" + i)) for i in ("a", "b"))
    joined = pairs.join(sb, "b").join(sa, "a").select("a", "b", "sa", "sb", "na", "nb")
    return materialize(joined.mapInArrow(trimmed(run), "a bigint, b bigint"), "jaccard-plausible")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are linked, by exact counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(y, x)
                at[at == len(y)] = len(y) - 1
                both = int((y[at] == x).sum())
                if den * both >= num * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), b.column(1).take(pa.array(keep, pa.int64()))], ["a", "b"])

    pairs = plausible(pairs, sets, num, den)
    sa, sb = (narrowed(sets, pairs, i).select(F.col("id").alias(i), F.col("set").alias("set_" + i)) for i in ("a", "b"))
    return pairs.join(sb, "b").join(sa, "a").select("a", "b", "set_a", "set_b").mapInArrow(trimmed(run), "a bigint, b bigint")


def jaccard_classes(docs: DataFrame, num: int = 85, den: int = 100, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): classes of documents linked at num/den similarity or more.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered, shingles are k words (64-bit hashes). Texts
    with fewer words are one shingle, texts without words (or null) are linked with nothing. Rows
    with one id are one node: they get the smallest class of theirs. A row with a null id has a
    null class. Exact copies meet through the name of their set, so no pair of them is formed.

    Large buckets are never paired in full. Each set is verified against the smallest id it meets,
    which joins near copies; where classes remain, all sets of the bucket are compared in blocks, as
    differences from its smallest set (see ``block_links``), which leaves no linked pair out.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    plain = Bands(num, den)
    hot, counts = survey(rows, k, plain)
    bands = Bands(num, den, counts)
    found = materialize(index_rows(rows, k, bands, hot), "jaccard-index")
    nodes = found.where(F.col("kind") == ROW).select(F.col("a").alias("id"), F.col("n").alias("n_shingles"), F.hex("name").alias("name"))
    named = materialize(attach_groups(nodes, "name", {"first_id": F.min("id")}, "jaccard-names"), "jaccard-nodes")
    copies = named.where("first_id is not null and id is not null and first_id <> id").select(F.col("first_id").alias("a"), F.col("id").alias("b"))
    pairs = materialize(found.where(F.col("kind") == PAIR).select("a", "b").distinct(), "jaccard-pairs")
    members = materialize(found.where(F.col("kind") == MEMBER).select(F.col("a").alias("key"), F.col("b").alias("id"), "n").distinct(), "jaccard-members")
    least = members.groupBy("key").agg(F.min("id").alias("a"))
    stars = members.join(least, "key").where("a < id").groupBy(F.col("id").alias("b")).agg(F.min("a").alias("a"))
    one = materialize(pairs.select("a", "b").unionByName(stars).groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "jaccard-first")
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(members.select("id")).distinct(), "jaccard-ids")
    sets = materialize(document_sets(rows, ids, k), "jaccard-sets")
    base = materialize(ids.unionByName(copies.select(F.explode(F.array("a", "b")).alias("id"))).distinct(), "jaccard-base")
    cls = base.withColumn("component", F.col("id"))
    cls = merge_classes(cls, verified(one, sets, num, den).unionByName(copies))

    def with_class(df: DataFrame, col: str, out: str) -> DataFrame:
        return df.join(cls.select(F.col("id").alias(col), F.col("component").alias(out)), col)

    def mixed_members() -> DataFrame:
        """Members of large buckets that hold several classes."""
        placed = materialize(with_class(members, "id", "c"), "jaccard-placed")
        mixed = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
        return materialize(placed.join(mixed, "key"), "jaccard-mixed")

    live = mixed_members()
    pivots = live.groupBy("key").agg(F.min("id").alias("p"))
    held = materialize(live.join(pivots, "key").select("p", "id", "c", "n").distinct(), "jaccard-held")
    rest = with_class(with_class(pairs.join(one, ["a", "b"], "left_anti"), "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b")
    near = block_links(held, sets, num, den)
    cls = merge_classes(cls, near.unionByName(verified(materialize(rest.distinct(), "jaccard-rest"), sets, num, den)))
    out = named.select("id", "n_shingles").join(cls, "id", "left")
    return out.select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))


def spanning(a: list[int], b: list[int]) -> list[int]:
    """Places of the links that join two trees when taken in order."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top.get(x, x) != x:
            top[x] = x = top.get(top[x], top[x])
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a, b)):
        x, y = find(x), find(y)
        if x != y:
            top[max(x, y)] = min(x, y)
            keep.append(i)
    return keep


def block_links(held: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between different classes among the sets that share a pivot, by exact counts.

    ``held`` is (p, id, c, n): a set, its class and size, and the pivot of a large bucket it is in.
    A set is held as D(x), its symmetric difference from the pivot: near copies have short ones, and
    x and y differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)| shingles. Sets of one pivot are dealt to
    blocks of about BLOCK_SETS, and each pair of blocks is one task's matrix product; a task sends
    a spanning forest of its classes, so fewer links than it has sets. No pair is ever a row.
    """

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, y in zip(b.column(4), b.column(5)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                out.append(np.setxor1d(x, y, True).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out, pa.binary())], ["p", "id", "c", "n", "d"])

    def links(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, c, n, block = (t.column(x).to_numpy() for x in ("id", "c", "n", "block"))
        parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("d")]
        size = np.array([len(x) for x in parts])
        values, place = np.unique(np.concatenate(parts), return_inverse=True)
        often = np.bincount(place, minlength=len(values)) > 1
        column = np.where(often, np.cumsum(often) - 1, -1)[place]
        row = np.repeat(np.arange(len(ids)), size)
        keep = column >= 0
        row, column = row[keep], column[keep]
        lo = block == block.min()
        left, right = np.nonzero(lo)[0], np.nonzero(~lo)[0] if not lo.all() else np.nonzero(lo)[0]
        shared = np.zeros((len(left), len(right)), np.float32)
        for at in range(0, int(often.sum()), MATRIX_COLUMNS):
            part = (column >= at) & (column < at + MATRIX_COLUMNS)
            m = np.zeros((len(ids), MATRIX_COLUMNS), np.float32)
            m[row[part], column[part] - at] = 1
            shared += m[left] @ m[right].T
        differ_by = size[left][:, None] + size[right][None, :] - 2 * shared.astype(np.int64)
        ok = (differ_by * (den + num) <= (den - num) * (n[left][:, None] + n[right][None, :])) & (c[left][:, None] != c[right][None, :])
        i, j = np.nonzero(ok)
        a, b = left[i], right[j]
        _, first = np.unique(np.stack([np.minimum(c[a], c[b]), np.maximum(c[a], c[b])], 1), axis=0, return_index=True)
        first = first[spanning(c[a][first].tolist(), c[b][first].tolist())]
        return pa.table({"a": pa.array(ids[a][first]), "b": pa.array(ids[b][first])})

    sx, sp = narrowed(sets, held, "id").select("id", F.col("set").alias("x")), narrowed(sets, held, "p").select(F.col("id").alias("p"), F.col("set").alias("y"))
    rows = materialize(held.join(sx, "id").join(sp, "p").select("p", "id", "c", "n", "x", "y").mapInArrow(trimmed(differ), "p bigint, id bigint, c bigint, n bigint, d binary"), "jaccard-differences")
    sizes = held.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SETS).cast("int").alias("blocks"))
    own = rows.join(sizes, "p").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["p", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")]
    return dealt.groupBy(*key).applyInArrow(links, "a bigint, b bigint")


def merge_classes(cls: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) after joining the classes of linked ids; ids outside ``cls`` are ignored."""
    links = materialize(links, "jaccard-links")
    for col in ("a", "b"):
        links = links.join(cls.select(F.col("id").alias(col), F.col("component").alias("c" + col)), col)
    up = connected_components(links.select("ca", "cb"), "ca", "cb").select(F.col("node").alias("component"), F.col("component").alias("top"))
    return materialize(cls.join(up, "component", "left").select("id", F.coalesce("top", "component").alias("component")), "jaccard-classes")


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_classes(docs).withColumnRenamed("id", "doc_id")
