"""Benchmark decontamination: q-gram lemma filtering in diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gossamer.llm.groups import numbered, quoted
from gossamer.session import bounded_batches, table, trimmed

#: Length of the q-grams of items of 40 bytes or more; shorter items have shorter ones (``gram_size``).
Q = 8
#: A benchmark item is searched in pieces of this many normalised bytes, one every STRIDE bytes:
#: a verbatim quote of PIECE bytes lacks at most STRIDE / 2 bytes of a piece, within its budget.
PIECE = 96
STRIDE = 16
#: Edits allowed per byte of a piece.
EDIT_SHARE = 0.1
#: Items, and bytes of items, that a pass over the documents holds at once, and so broadcasts; more items take more passes.
SLICE_ITEMS = 20_000
SLICE_BYTES = 16 << 20
_HASH_BITS = 22
#: So many regions of an item are verified at a time; what is found may make the others needless.
ROUND = 8


def normalise(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode("utf-8", "surrogatepass")


def grams(raw: bytes, q: int = Q) -> np.ndarray:
    """Every q-gram of a byte string as an integer, at its start."""
    n = len(raw) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if q == 8:
        return np.ndarray((n,), "<u8", raw, 0, (1,))
    return np.ndarray((n,), "<u8", raw + bytes(8 - q), 0, (1,)) & np.uint64((1 << 8 * q) - 1)


def budget(m: int) -> int:
    """Edits a piece of m bytes may have: a tenth."""
    return int(m * EDIT_SHARE)


def gram_size(m: int) -> int:
    """The longest q-gram, up to Q bytes, of which a piece of m bytes shares one at least with all that is within its budget."""
    return min(Q, m // (budget(m) + 1))


def pieces(raw: bytes) -> list[tuple[int, int]]:
    """Starts and ends of an item's pieces; the last one is flush with its end."""
    n = len(raw)
    if n < Q:
        return []
    if n <= PIECE:
        return [(0, n)]
    starts = [*range(0, n - PIECE, STRIDE), n - PIECE]
    return [(s, s + PIECE) for s in starts]


class Index:
    """Items by length: one ``Grams`` for each length under 40 bytes and one for all others, so that
    short items, which need few common q-grams, do not weaken the filter of the rest."""

    def __init__(self, items: list[tuple[int, str]]):
        raws = [(i, normalise(t)) for i, t in items]
        groups: dict[int, list[tuple[int, bytes]]] = {}
        for i, r in raws:
            if len(r) >= Q:
                groups.setdefault(min(len(r), 5 * Q), []).append((i, r))
        self.groups = [Grams(g, gram_size(n)) for n, g in sorted(groups.items())]


class Grams:
    """Q-grams of items with their places, and a bit table that tells most others apart."""

    def __init__(self, raws: list[tuple[int, bytes]], q: int):
        self.q = q
        self.ids = np.array([i for i, _ in raws], np.int64)
        self.raws = [r for _, r in raws]
        g = [grams(r, q) for r in self.raws]
        values = np.concatenate(g)
        item = np.repeat(np.arange(len(g)), [len(x) for x in g]).astype(np.int64)
        at = np.concatenate([np.arange(len(x)) for x in g])
        order = np.argsort(values, kind="stable")
        self.item, self.at = item[order], at[order]
        self.values, self.first, self.count = np.unique(values[order], return_index=True, return_counts=True)
        self.bits = np.zeros(1 << _HASH_BITS, bool)
        self.bits[self.slot(self.values)] = True
        self.of_item = [[(s, e, budget(e - s)) for s, e in pieces(r)] for r in self.raws]
        each = [p for ps in self.of_item for p in ps]
        self.length = np.array([len(r) for r in self.raws], np.int64)
        self.need = np.array([min(self.shared(*p) for p in ps) for ps in self.of_item], np.int64)
        self.least = int(self.need.min())
        self.span = max(e - s + b for s, e, b in each)
        self.band = max(b for *_, b in each) + 1

    def shared(self, s: int, e: int, b: int) -> int:
        """Q-grams that a piece shares at least with all that is within its budget."""
        return e - s + 1 - self.q * (b + 1)

    @staticmethod
    def slot(v: np.ndarray) -> np.ndarray:
        return ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _HASH_BITS)).astype(np.int64)

    def places(self, at: np.ndarray) -> np.ndarray:
        """Indexes into ``item`` and ``at`` of all places of some values."""
        n = self.count[at]
        return np.repeat(self.first[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def common(raw: bytes, index: Grams) -> tuple[np.ndarray, np.ndarray]:
    """(place in the text, index of the value) of the q-grams that items have, where they are dense enough."""
    g = grams(raw, index.q)
    none = np.zeros(0, np.int64)
    hit = index.bits[index.slot(g)]
    if int(hit.sum()) < index.least:
        return none, none
    c = np.concatenate([[0], np.cumsum(hit)])
    # a hit stays if some window of the longest region around it has enough hits
    w = index.span
    hi = np.minimum(np.arange(len(g)) + w, len(g))
    dense = c[hi] - c[:-1] >= index.least
    if not dense.any():
        return none, none
    d = np.concatenate([[0], np.cumsum(dense)])
    lo = np.maximum(np.arange(len(g)) - w + 1, 0)
    pos = np.nonzero(hit & (d[1:] - d[lo] > 0))[0]
    at = np.searchsorted(index.values, g[pos])
    at[at == len(index.values)] = 0
    real = index.values[at] == g[pos]
    return pos[real], at[real]


#: A region to be verified: item, piece (start, end, budget), first diagonal of the band, last one, shared q-grams.
Region = tuple[int, int, int, int, int, int, int]


def candidates(pos: np.ndarray, at: np.ndarray, index: Grams, n: int) -> list[Region]:
    """Regions of a text of n q-grams that share enough of them with a piece.

    Bands cover 2B diagonals and start every B, B above every budget: an alignment drifts over at
    most B diagonals, so one band holds it whole, with at least m + 1 - q(k + 1) shared q-grams. Shared q-grams of a band are
    counted in the cheaper of two ways, item by item: by pairs of equal q-grams, or, where text and item repeat
    the same ones so often that pairs multiply, by sums over diagonals, which take time like the
    item times the text whatever repeats.
    """
    if not len(at):
        return []
    seen, first, times = np.unique(at, return_index=True, return_counts=True)
    place = index.places(seen)
    reps = index.count[seen]
    pairs = np.bincount(index.item[place], np.repeat(times, reps), len(index.raws))
    there = np.bincount(index.item[place], minlength=len(index.raws))
    live = there >= index.need
    many = live & (pairs > index.length * (16 + n // 256))
    out: list[Region] = []
    if many.any():
        order = np.argsort(at, kind="stable")
        ends = np.cumsum(times)
        of_value = {int(v): pos[order[e - t : e]] for v, e, t in zip(seen, ends, times)}
        value_at = np.repeat(seen, reps)
        for k in np.nonzero(many)[0].tolist():
            own = index.item[place] == k
            out += by_diagonals(k, index.at[place][own], value_at[own], of_value, index, n)
    light = live & ~many
    if light.any():
        # values of wanted items only, before their places in the text are multiplied out
        keep = np.logical_or.reduceat(light[index.item], index.first)[at]
        out += by_pairs(pos[keep], at[keep], index, light)
    return out


def by_pairs(pos: np.ndarray, at: np.ndarray, index: Grams, wanted: np.ndarray) -> list[Region]:
    place = index.places(at)
    item, ipos, tpos = index.item[place], index.at[place], np.repeat(pos, index.count[at])
    keep = wanted[item]
    item, ipos, tpos = item[keep], ipos[keep], tpos[keep]
    if not len(item):
        return []
    width = index.band
    b = (tpos - ipos) // width + (1 << 20)
    keys = np.concatenate([(item << 40) | b, (item << 40) | (b - 1)])
    both = np.concatenate([np.arange(len(item))] * 2)
    uniq, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    enough = counts >= index.least
    if not enough.any():
        return []
    keep = enough[inverse]
    inverse, both = inverse[keep], both[keep]
    order = np.argsort(inverse, kind="stable")
    inverse, both = inverse[order], both[order]
    out = []
    cuts = np.nonzero(np.diff(inverse))[0] + 1
    for part in np.split(np.arange(len(inverse)), cuts):
        key = int(uniq[inverse[part[0]]])
        k, start = key >> 40, ((key & ((1 << 40) - 1)) - (1 << 20)) * width
        places = np.sort(ipos[both[part]])
        for s, e, bud in index.of_item[k]:
            shared = int(np.searchsorted(places, e - index.q, "right") - np.searchsorted(places, s, "left"))
            if shared >= index.shared(s, e, bud):
                out.append((k, s, e, bud, start, start + 2 * width, shared))
    return out


def by_diagonals(k: int, places: np.ndarray, values: np.ndarray, of_value: dict[int, np.ndarray], index: Grams, n: int) -> list[Region]:
    """As ``by_pairs``, for one item: a 1 for each place of a value in the text, shifted by its place in the item, and summed."""
    width, length = index.band, int(index.length[k])
    marks: dict[int, np.ndarray] = {}
    for v in set(values.tolist()):
        marks[v] = np.zeros(n, np.int16)
        marks[v][of_value[v]] = 1
    # diagonals from -low on, low a multiple of the bands' width
    low = -(-length // width) * width
    total = low + n + 3 * width
    out: list[Region] = []
    for s, e, bud in index.of_item[k]:
        on = np.zeros(total - total % width, np.int32)
        inside = (places >= s) & (places <= e - index.q)
        for i, v in zip(places[inside].tolist(), values[inside].tolist()):
            on[low - i : low - i + n] += marks[v]
        cells = on.reshape(-1, width).sum(1)
        shared = cells[:-1] + cells[1:]
        for c in np.nonzero(shared >= index.shared(s, e, bud))[0].tolist():
            out.append((k, s, e, bud, c * width - low, (c + 2) * width - low, int(shared[c])))
    return out


def banded(pieces: list[bytes], regions: list[bytes], limits: list[int]) -> np.ndarray:
    """Smallest edit distance of each piece to any substring of its region; -1 above its limit.

    The pieces have one length. Regions are padded with a value that no byte equals.
    """
    a = np.array([np.frombuffer(p, np.uint8) for p in pieces], np.int16)
    n = max(map(len, regions))
    b = np.full((len(regions), n), -1, np.int16)
    for k, r in enumerate(regions):
        b[k, : len(r)] = np.frombuffer(r, np.uint8)
    out = np.full(len(a), -1)
    live, limit = np.arange(len(a)), np.array(limits)
    row = np.zeros((len(a), n + 1), np.int32)
    steps = np.arange(n + 1, dtype=np.int32)
    for i in range(a.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        np.minimum(row[:, :-1] + (b != a[:, i, None]), row[:, 1:] + 1, out=new[:, 1:])
        new -= steps
        row = np.minimum.accumulate(new, axis=1)
        row += steps
        if i % 8 == 7:
            ok = row.min(1) <= limit
            if not ok.all():
                a, b, row, live, limit = a[ok], b[ok], row[ok], live[ok], limit[ok]
                if not len(live):
                    return out
    best = row.min(1)
    out[live] = np.where(best <= limit, best, -1)
    return out


def find_items(text: str | None, index: Index) -> list[tuple[int, int, int]]:
    """(item id, start, edits) of each item with a verified piece; the best piece of each."""
    raw = normalise(text)
    return sorted(x for g in index.groups for x in find_grams(raw, g))


def find_grams(raw: bytes, index: Grams) -> list[tuple[int, int, int]]:
    """As ``find_items``, for one length of q-grams.

    Beside an exact piece of an item no other can be the best. Other regions are verified by falling number of shared q-grams, which
    bounds their edits from below (each edit spoils at most q), until no region that is left can be better.
    """
    pos, at = common(raw, index)
    best: dict[int, tuple[int, int]] = {}
    of_piece: dict[tuple[int, int], list[Region]] = {}
    for r in candidates(pos, at, index, max(0, len(raw) - index.q + 1)):
        of_piece.setdefault((r[0], r[1]), []).append(r)
    waiting: dict[int, list[tuple[int, int, int, Region]]] = {}
    for (k, s), regions in of_piece.items():
        piece = index.raws[k][s : regions[0][2]]
        found = raw.find(piece)
        if found >= 0:
            best[k] = min(best.get(k, (0, found)), (0, found))
            continue
        tried: set[tuple[int, int]] = set()
        for r in regions:
            _, _, e, bud, start, stop, shared = r
            lo, hi = max(0, s + start - bud), min(len(raw), e + stop + bud)
            if hi > lo and (lo, hi) not in tried:
                tried.add((lo, hi))
                # no piece is there exactly
                least = max(1, -(-(e - s + 1 - index.q - shared) // index.q))
                waiting.setdefault(k, []).append((least, lo, hi, r))
    for k in [k for k in waiting if k in best]:
        del waiting[k]
    for rows in waiting.values():
        rows.sort(reverse=True)
    while waiting:
        jobs: dict[int, list[tuple[int, int, int, bytes, bytes]]] = {}
        for k, rows in waiting.items():
            for _ in range(min(ROUND, len(rows))):
                _, lo, hi, (_, s, e, bud, *_) = rows.pop()
                jobs.setdefault(e - s, []).append((k, lo, bud, index.raws[k][s:e], raw[lo:hi]))
        for some in jobs.values():
            for x in range(0, len(some), 256):
                part = some[x : x + 256]
                edits = banded([j[3] for j in part], [j[4] for j in part], [j[2] for j in part])
                for (k, lo, *_), n in zip(part, edits.tolist()):
                    if n >= 0:
                        best[k] = min(best.get(k, (n, lo)), (n, lo))
        waiting = {k: rows for k, rows in waiting.items() if rows and (k not in best or rows[-1][0] < best[k][0])}
    return [(int(index.ids[k]), at, edits) for k, (edits, at) in best.items()]


HITS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("edits", T.IntegerType())]))
_HITS_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("edits", pa.int32())]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", out_col: str = "hits", slice_items: int = SLICE_ITEMS, keep: list[str] | None = None) -> DataFrame:
    """Adds ``hits``: the benchmark items a text holds, each with where and with how many edits.

    Texts and items are compared in lower case with white space collapsed, as bytes. A text holds
    an item if one of the item's pieces (96 bytes every 16, or the whole of a shorter item) is within
    a tenth of its length in edits of a stretch of the text. Items of fewer than 8 such bytes, null
    items and items with a null id match nothing; null texts are empty. Whole texts, however long, are
    searched in one narrow pass for each slice of the benchmark (``slice_items``, ``SLICE_BYTES``);
    only a slice is ever broadcast. Rows that are repeated are searched as often as they occur, and
    repeated items count once. ``docs`` may have any other columns; a column ``out_col`` is replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_slices = max(1, -(-n // slice_items), -(-size // SLICE_BYTES))
    names = [c for c in (docs.columns if keep is None else keep) if c != out_col or c == text_col]
    where = names.index(text_col)
    out = numbered(docs.select(*[quoted(c) for c in names]))
    for k in range(n_slices):
        part = items if n_slices == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_slices)) == k)
        shared = spark.sparkContext.broadcast([(r[0], r[1]) for r in part.orderBy("item_id", "text").collect()])

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=f"hits{k}") -> Iterator[pa.RecordBatch]:
            index = Index(shared.value)
            for b in batches:
                hits = [[{"item_id": i, "start": s, "edits": e} for i, s, e in find_items(t, index)] for t in b.column(where).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hits, _HITS_ARROW)], [*b.schema.names, name])

        out = out.mapInArrow(trimmed(run), T.StructType([*out.schema.fields, T.StructField(f"hits{k}", HITS)]))
    merged = F.array_sort(F.concat(*[F.col(f"hits{k}") for k in range(n_slices)]))
    rest = [(i, c) for i, c in enumerate(names) if c != out_col]
    return out.select(*[F.col(f"c{i}") for i, _ in rest], merged).toDF(*[c for _, c in rest], out_col)


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").alias("n_items"), F.col("hits.item_id").alias("item_ids"), F.col("hits.edits").alias("edits"))
