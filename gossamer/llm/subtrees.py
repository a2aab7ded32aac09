"""Removal of word windows that an earlier document has, by suffix trees of groups of suffixes.

A window is 50 consecutive words, its anchor the place in it where the next 8 words have the smallest
hash. Equal windows have equal anchors, so a window whose anchor's 8 words are in no other document is in
none itself. The suffixes that matter start at the windows left over. They are dealt to groups by a
prefix of variable length: from an anchor on 8 words, as long as few documents have these, else all the
words of the window. Consecutive windows with one anchor travel as one string of word codes, once for every
task and string. A group is what a task holds at a time: the suffixes of its strings are
sorted, the tree is built from their shared prefixes, and its nodes of 50 words or deeper are the repeats.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.llm.bytesets import hash_pieces, mix64, slices, text_column, word_starts
from gossamer.llm.groups import attach_groups, quoted
from gossamer.session import bounded_batches, materialize, table, trimmed

WINDOW, PREFIX = 50, 8
#: Anchors that more documents have are cut into windows of their own, so that no group has more strings.
MANY_DOCUMENTS = 256
#: A task keeps at most so many distinct strings before it passes them on.
HELD_STRINGS = 60_000
#: So many (id, tag) keys are broadcast at most; beyond it the join is shuffled.
BROADCAST_IDS = 500_000
NULL_ID = -(1 << 63)
#: Bytes of a word in a string.
CODE = 8

_GRAM = mix64(np.arange(1, PREFIX + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_PLACE_BITS = 24


def text_tag(raw: bytes) -> int:
    """31 bits of a text's crc32, which tell rows of one id apart."""
    return zlib.crc32(raw) & 0x7FFFFFFF


def coded_words(a: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of the words of consecutive texts, and the texts' offsets into them."""
    if not len(a):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    solid, begins = word_starts(a, off)
    starts = np.nonzero(begins)[0]
    return hash_pieces(a, solid, starts), np.searchsorted(starts, off)


def prefix_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of the PREFIX words from every place on."""
    n = len(words) - PREFIX + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n] * _GRAM[0]
    for i in range(1, PREFIX):
        h = h + words[i : n + i] * _GRAM[i]
    return mix64(h)


def anchors(h: np.ndarray) -> np.ndarray:
    """For the window at each place, the place of its anchor: the first of the smallest hashes."""
    width = WINDOW - PREFIX + 1
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = h, np.arange(len(h))
    span = 1
    while span < width:
        step = min(span, width - span)
        later = best[step:] < best[:-step]
        best, at = np.where(later, best[step:], best[:-step]), np.where(later, at[step:], at[:-step])
        span += step
    return at


ROW, ANCHOR = 0, 1
FACTS = pa.schema([("kind", pa.int8()), ("d", pa.int64()), ("tag", pa.int64()), ("h", pa.int64()), ("p", pa.int64()), ("name", pa.binary())])
FACTS_DDL = "kind byte, d bigint, tag bigint, h bigint, p bigint, name binary"


def facts(docs: DataFrame) -> DataFrame:
    """A ROW of every document (p: words, name: digest of the words joined by one space) and a row of each of
    its ANCHORs (h: hash, p: place). ``docs`` is (d, text) without nulls."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_column(b.column(1))
            ids = b.column(0).to_numpy()
            for lo, hi in slices(offsets):
                off = offsets[lo : hi + 1] - offsets[lo]
                a = data[offsets[lo] : offsets[hi]]
                raws = [a[off[i] : off[i + 1]].tobytes() for i in range(hi - lo)]
                tags = np.array([text_tag(r) for r in raws], np.int64)
                names = [hashlib.sha256(b" ".join(r.split())).digest() for r in raws]
                words, at = coded_words(a, off)
                n = hi - lo
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, ROW, np.int8)), pa.array(ids[lo:hi]), pa.array(tags), pa.nulls(n, pa.int64()), pa.array(np.diff(at)), pa.array(names, pa.binary())], schema=FACTS)
                h = prefix_hashes(words)
                m = anchors(h)
                start = np.arange(len(m))
                row = np.searchsorted(at, start, "right") - 1
                m = np.unique(m[start + WINDOW <= at[row + 1]])
                row = np.searchsorted(at, m, "right") - 1
                n = len(m)
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, ANCHOR, np.int8)), pa.array(ids[lo + row]), pa.array(tags[row]), pa.array(h[m].view(np.int64)), pa.array(m - at[row]), pa.nulls(n, pa.binary())], schema=FACTS)

    return docs.mapInArrow(trimmed(emit), FACTS_DDL)


# -- suffix trees ---------------------------------------------------------------------------------


def deep_nodes(strings: list[bytes], depth: int = WINDOW * CODE) -> Iterator[list[tuple[int, int]]]:
    """The topmost nodes of at least ``depth`` bytes in the suffix tree of strings of word codes.

    A node comes as its leaves (string, word that the suffix starts with). Suffixes of fewer than
    ``depth`` bytes are in no such node and are left out of the tree.
    """
    suffixes = sorted((s[i:], k, i // CODE) for k, s in enumerate(strings) for i in range(0, len(s) - depth + 1, CODE))
    leaves: list[tuple[int, int]] = []
    before = b""
    for s, k, i in suffixes:
        # neighbours in order share the path down to where they part; a node of depth ends where they part earlier
        if leaves and s[:depth] != before[:depth]:
            if len(leaves) > 1:
                yield leaves
            leaves = []
        leaves.append((k, i))
        before = s
    if len(leaves) > 1:
        yield leaves


def repeats_of_group(strings: dict[bytes, tuple[int, list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(document, place, end) of the windows of a group that an earlier document has.

    ``strings`` has for each string its earliest document and the string's places in it.
    """
    names = list(strings)
    owners = [strings[s][0] for s in names]
    gone: dict[int, list[int]] = {}
    for leaves in deep_nodes(names):
        first = min(owners[k] for k, _ in leaves)
        for k, i in leaves:
            if owners[k] > first:
                gone.setdefault(k, []).append(i)
    for k, starts in gone.items():
        for s, e in joined(sorted(set(starts))):
            for p in strings[names[k]][1]:
                yield owners[k], p + s, p + e + WINDOW


def joined(numbers: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges (first, last) of consecutive numbers."""
    first = last = numbers[0]
    for x in numbers[1:]:
        if x != last + 1:
            yield first, last
            first = x
        last = x
    yield first, last


STRING, SPAN = 0, 1
DEALT = pa.schema([("kind", pa.int8()), ("grp", pa.int64()), ("d", pa.int64()), ("p", pa.int64()), ("e", pa.int64()), ("string", pa.binary()), ("places", pa.list_(pa.int64()))])
DEALT_DDL = "kind byte, grp bigint, d bigint, p bigint, e bigint, string binary, places array<bigint>"


def _spans(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    d, p, e = (np.array(x, np.int64) for x in zip(*found))
    n = len(d)
    route = mix64((d * 31 + p).view(np.uint64)).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, SPAN, np.int8)), pa.array(route), pa.array(d), pa.array(p), pa.array(e), pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.int64()))], schema=DEALT)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(d, p, e): spans of words that an earlier document has. ``docs`` is (d, text, anchors) with the places
    of its repeated anchors and whether many documents have them. Places bear the text's tag in their high
    half. Spans may overlap."""
    spark = docs.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], tuple[int, list[int]]] = {}
        found: list[tuple[int, int, int]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = list(held.items())
            for i in range(0, len(rows), 5000):
                part = rows[i : i + 5000]
                n = len(part)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, STRING, np.int8)), pa.array([k for (k, _), _ in part], pa.int64()), pa.array([d for _, (d, _) in part], pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
                    pa.array([s for (_, s), _ in part], pa.binary()), pa.array([p for _, (_, p) in part], pa.list_(pa.int64())),
                ], schema=DEALT)

        def add(key: int, string: bytes, size: int, d: int, place: int) -> None:
            mine = held.setdefault((key, string), (d, []))
            if mine[0] < d:
                found.append((d, place, place + size))
                return
            if mine[0] > d:
                found.extend((mine[0], p, p + size) for p in mine[1])
                mine = held[key, string] = (d, [])
            mine[1].append(place)

        for b in batches:
            data, offsets = text_column(b.column(1))
            for i, d in enumerate(b.column(0).to_pylist()):
                a = data[offsets[i] : offsets[i + 1]]
                words, _ = coded_words(a, np.array([0, len(a)]))
                base = text_tag(a.tobytes()) << 32
                codes = words.astype(">u8").tobytes()
                h = prefix_hashes(words)
                m = anchors(h)
                marks = b.column(2)[i].values
                many = dict(zip(marks.field("p").to_pylist(), marks.field("many").to_pylist()))
                start = np.nonzero(np.concatenate([[True], m[1:] != m[:-1]]))[0]
                stop = np.concatenate([start[1:], [len(m)]])
                for s, e, k, key in zip(start.tolist(), stop.tolist(), m[start].tolist(), h[m[start]].view(np.int64).tolist()):
                    if k not in many:
                        continue
                    if many[k]:
                        # the prefix is the whole window: equal ones only are in a group, and their digest tells them apart
                        for w in range(s, e):
                            name = hashlib.blake2b(codes[w * CODE : (w + WINDOW) * CODE], digest_size=16).digest()
                            add(int.from_bytes(name[:8], "big", signed=True), name, WINDOW, d, base | w)
                    else:
                        add(key, codes[s * CODE : (e - 1 + WINDOW) * CODE], e - s - 1 + WINDOW, d, base | s)
                if len(held) >= HELD_STRINGS:
                    yield from flush()
                    held = {}
                if len(found) >= 100_000:
                    yield _spans(found)
                    found = []
        if held:
            yield from flush()
        if found:
            yield _spans(found)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group: one group at a time is in memory, and of equal strings one."""
        group: dict[bytes, tuple[int, list[int]]] = {}
        now, found = None, []
        for b in batches:
            kind = b.column(0).to_numpy()
            other = np.nonzero(kind == SPAN)[0]
            if len(other):
                yield b.take(pa.array(other))
            own = b.take(pa.array(np.nonzero(kind == STRING)[0]))
            for key, d, s, places in zip(own.column(1).to_pylist(), own.column(2).to_pylist(), own.column(5).to_pylist(), own.column(6).to_pylist()):
                if key != now:
                    if len(group) > 1:
                        found += repeats_of_group(group)
                    group, now = {}, key
                size = len(s) // CODE if len(s) > 16 else WINDOW
                first = group.get(s)
                if first is None:
                    group[s] = (d, places)
                elif first[0] == d:
                    group[s] = (d, first[1] + places)
                else:
                    late, group[s] = ((d, places), first) if first[0] < d else (first, (d, places))
                    found += [(late[0], p, p + size) for p in late[1]]
                if len(found) >= 100_000:
                    yield _spans(found)
                    found = []
        if len(group) > 1:
            found += repeats_of_group(group)
        if found:
            yield _spans(found)

    dealt = docs.mapInArrow(trimmed(emit), DEALT_DDL).repartition(n_parts, "grp").sortWithinPartitions("grp")
    return dealt.mapInArrow(trimmed(meet), DEALT_DDL).select("d", "p", "e")


def _with_text(docs: DataFrame, keyed: DataFrame) -> DataFrame:
    """Join texts to facts by (d, tag); a checked number of ids is broadcast first, so that only their
    texts are shuffled."""
    ids = keyed.select("d").distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    some = docs.join(F.broadcast(ids), "d", "left_semi") if few else docs
    return some.withColumn("tag", F.crc32("text").bitwiseAND(0x7FFFFFFF)).join(keyed.hint("merge"), ["d", "tag"])


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept) of every row.

    A word is removed when one of the windows of 50 words that cover it also starts in a row with a smaller
    id; what repeats only within a document, or among rows of one id, stays. Rows of one id are documents
    of their own; rows equal throughout get one result each. Null ids come before all others, null texts have
    no words, and texts of fewer than 50 words lose none. Texts of any length are taken whole; an empty
    table gives an empty one, and no other column is looked at. ``kept`` has the words left, joined by one
    space, only where some went and some are left.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(quoted(id_col).cast("long"), F.lit(NULL_ID)).alias("d"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))
    known = materialize(facts(rows), "window-anchors")
    every = known.where(F.col("kind") == ROW).select("d", "tag", F.col("p").alias("n_words"), F.lower(F.hex("name")).alias("sha"))
    every = materialize(attach_groups(every, "sha", {"first": F.min("d")}, "window-texts"), "window-rows")
    copies = every.where("first < d").select("d", "tag").distinct()
    marks = known.where(F.col("kind") == ANCHOR).select("d", "tag", F.col("h").cast("string").alias("h"), "p").join(copies, ["d", "tag"], "left_anti")
    marks = attach_groups(marks, "h", {"n": F.count(F.lit(1)), "low": F.min("d"), "high": F.max("d")}, "window-prefixes").where("low < high")
    listed = materialize(marks.groupBy("d", "tag").agg(F.collect_set(F.struct("p", (F.col("n") > MANY_DOCUMENTS).alias("many"))).alias("anchors")), "window-lists")
    spans = materialize(repeated_spans(_with_text(rows, listed).select("d", "text", "anchors")), "window-spans")
    merged = spans.groupBy("d", F.shiftright("p", 32).alias("tag")).agg(F.collect_set(F.struct("p", "e")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column(2).cast(pa.large_binary()), b.column(3)):
                words = text.as_py().split()
                s, e = (np.sort(x.to_numpy() & 0xFFFFFFFF) for x in spans.values.flatten())
                step = np.zeros(len(words) + 1, np.int64)
                np.add.at(step, s, 1)
                np.add.at(step, e, -1)
                gone = np.cumsum(step[:-1]) > 0
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                out.append((int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
            cols = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], ["d", "tag", "r", "k", "kept"])

    cutout = _with_text(rows, materialize(merged, "window-merged")).select("d", "tag", "text", "spans").mapInArrow(trimmed(cut), "d bigint, tag bigint, r bigint, k string, kept string").dropDuplicates(["d", "tag"])
    joined_ = every.join(cutout, ["d", "tag"], "left")
    whole = F.coalesce((F.col("first") < F.col("d")) & (F.col("n_words") >= WINDOW), F.lit(False))
    return joined_.select(
        F.when(F.col("d") != NULL_ID, F.col("d")).alias(id_col), "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("r", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("k", "sha")).alias("kept_sha256"),
        F.when(~whole, F.col("kept")).alias("kept"),
    )


def op13_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


OP13_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 48, 1)::BIGINT)) AS i FROM w),
g AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM s),
f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM g JOIN f USING (h) WHERE first < doc_id),
all_words AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words)::BIGINT + 1)) AS i FROM w),
kept AS (SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.i) AS text, count(*) AS n FROM all_words a ANTI JOIN gone USING (doc_id, i) GROUP BY a.doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, len(w.words)::BIGINT - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM w LEFT JOIN kept k USING (doc_id)"""
