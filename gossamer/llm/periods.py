"""Periodic runs of words, found by matching aligned blocks of a text against the whole text.

A run of period q that is four periods long holds a whole block of B words, aligned to a multiple of
B, whose copy q words on is in the run as well, if B is at most 1.5 q. So for B = 2, 4, 8 ... the
blocks of a text become keys of an automaton (sequences of word numbers), the text is searched
once (the halves' numbers from the search before stand for them), and copies at a distance of 2/3 B to 4/3 B are seeds: extended to both sides, word by word, as far as
words a distance apart are equal. A block can only occur again if both its halves do, so that keys
die out after a few sizes in ordinary texts. Blocks with three copies in reach are periodic themselves with a
short period; all their seeds but those that set the ends of two such stretches on each other lie
within runs of that period, so that one word a million times over is no quadratic case.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.llm.groups import quoted
from gossamer.session import bounded_batches, table, trimmed

#: A run has at least so many words and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4


def agree_right(a: np.ndarray, i: int, j: int) -> int:
    """How many words are equal from i and from j > i on."""
    n, got, step = len(a) - j, 0, 32
    while got < n:
        m = min(step, n - got)
        differ = a[i + got : i + got + m] != a[j + got : j + got + m]
        if differ.any():
            return got + int(differ.argmax())
        got += m
        step *= 4
    return n


def agree_left(a: np.ndarray, i: int, j: int) -> int:
    """How many words are equal before i and before j > i."""
    got, step = 0, 32
    while got < i:
        m = min(step, i - got)
        differ = (a[i - got - m : i - got] != a[j - got - m : j - got])[::-1]
        if differ.any():
            return got + int(differ.argmax())
        got += m
        step *= 4
    return i


def has_smaller_period(a: np.ndarray, start: int, period: int) -> bool:
    """Does a stretch of at least two periods have a smaller one? It then divides the period."""
    root = a[start : start + period]
    rest, f = period, 2
    while rest > 1:
        if f * f > rest:
            f = rest
        if rest % f == 0:
            q = period // f
            if (root[q:] == root[:-q]).all():
                return True
            while rest % f == 0:
                rest //= f
        f += 1
    return False


class Stretches:
    """Maximal stretches in which words a distance apart are equal; the last one of each distance is kept."""

    def __init__(self, a: np.ndarray):
        self.a = a
        self.last: dict[int, tuple[int, int]] = {}

    def around(self, x: int, d: int, known: int) -> tuple[int, int, bool]:
        """(start, end, is it new) of the stretch of distance d that holds x to x + d + known."""
        s, e = self.last.get(d, (0, 0))
        if s <= x and x + d + known <= e:
            return s, e, False
        s = x - agree_left(self.a, x, x + d)
        e = x + d + known + agree_right(self.a, x + known, x + d + known)
        self.last[d] = (s, e)
        return s, e, True


def search(machine: ahocorasick.Automaton, half: np.ndarray, h: int) -> np.ndarray:
    """(place, key) of every copy of a key of two halves: numbers h places apart are read side by side,
    so that the automaton is as deep for long blocks as for short ones."""
    n = len(half)
    wide = -(-n // h)
    lanes = np.zeros((h, wide + 1), np.int64)
    lanes[:, :wide] = np.concatenate([half, np.zeros(wide * h - n, np.int64)]).reshape(wide, h).T
    hits = np.array(list(machine.iter(tuple(lanes.ravel().tolist()))), np.int64).reshape(-1, 2)
    lane, at = np.divmod(hits[:, 0] - 1, wide + 1)
    return np.stack([at * h + lane, hits[:, 1]], 1)


def find_runs(a: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of word numbers, by start, then period."""
    n = len(a)
    if n < LEAST_WORDS:
        return []
    runs: set[tuple[int, int, int]] = set()
    found, inner = Stretches(a), Stretches(a)
    # the number of the string of half the size at each place, 0 if it is no key or occurs once
    half = np.where(np.bincount(a)[a] > 1, a + 1, 0)
    size = 2
    # a run of the smallest period that a size stands for has four of them
    while LEAST_PERIODS * (size * 2 // 3 + 1) <= n or (size == 2 and n >= LEAST_WORDS):
        h, blocks = size // 2, n // size
        first, second = half[0 : blocks * size : size], half[h : blocks * size : size]
        live = np.nonzero((first > 0) & (second > 0))[0]
        if not len(live):
            break
        keys: dict[tuple[int, int], int] = {}
        name = [keys.setdefault(k, len(keys)) for k in zip(first[live].tolist(), second[live].tolist())]
        live = live * size
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for key, k in keys.items():
            machine.add_word(key, k)
        machine.make_automaton()
        hits = search(machine, half, h)
        # copies of each key side by side, in the order of their places
        code = np.sort(hits[:, 1] * (n + 1) + hits[:, 0])
        base = np.array(name, np.int64) * (n + 1)
        low, high = size * 2 // 3 + 1 if size > 2 else 1, (size * 4 - 1) // 3
        first = np.searchsorted(code, base + np.minimum(live + low, n))
        stop = np.searchsorted(code, base + np.minimum(live + high, n), "right")
        half = np.zeros(n, np.int64)
        half[hits[:, 0]] = np.where(np.bincount(hits[:, 1]) > 1, np.arange(len(keys)) + 1, 0)[hits[:, 1]]
        for at in np.nonzero(stop > first)[0].tolist():
            x = int(live[at])
            d = (code[first[at] : stop[at]] - base[at] - x).tolist()
            if len(d) > 2:
                d = break_distances(inner, x, size, d)
            for q in d:
                s, e, new = found.around(x, q, size)
                if new and e - s >= max(LEAST_WORDS, LEAST_PERIODS * q) and not has_smaller_period(a, s, q):
                    runs.add((s, e - s, q))
        size *= 2
    return sorted(runs, key=lambda r: (r[0], r[2]))


def break_distances(inner: Stretches, x: int, size: int, ds: list[int]) -> list[int]:
    """Which of many seeds of one block can make a run that no shorter period explains.

    Three copies within less than a block's length mean that the block has the period p between
    neighbours. A run with a longer period holds an end of the stretch of period p around the block, and, a
    period on, the same end of the stretch around the copy.
    """
    p = ds[1] - ds[0]
    s, e, _ = inner.around(x, p, size - p)
    out, at = [], 0
    # the copy's stretch is extended apart, so that the block's stays the last one of its distance
    while at < len(ds):
        y = x + ds[at]
        if y + size <= e:
            at += 1
            continue
        s2 = y - agree_left(inner.a, y, y + p)
        e2 = y + size + agree_right(inner.a, y + size - p, y + size)
        out += [d for d in {e2 - e, s2 - s} if ds[0] <= d <= ds[-1] and d in ds]
        while at < len(ds) and x + ds[at] + size <= e2:
            at += 1
    return sorted(set(out))


FOUND = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def word_numbers(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run has after its first period."""
    if not runs:
        return b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    for s, length, q in runs:
        step[s + q] += 1
        step[s + length] -= 1
    keep = np.cumsum(step[:-1]) == 0
    return b" ".join(w for w, k in zip(words, keep.tolist()) if k)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed) of every row.

    ``runs`` are all stretches of consecutive words with smallest period q and at least max(6, 4 q)
    words that no neighbouring word extends, by start, then period; ``collapsed`` is the text's words
    joined by one space without those that a run repeats. Null texts have no words; ids, null or repeated,
    go with their rows and are not looked at. Texts of any length are taken whole, a row at a time, in
    memory and time that follow their length. An empty table gives an empty one, other columns are left out.
    """
    bounded_batches(docs.sparkSession)
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count, found, texts = [], [], []
            for text in b.column(1).cast(pa.large_binary()):
                words = (text.as_py() or b"").split()
                runs = find_runs(word_numbers(words))
                count.append(len(words))
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                texts.append(collapse(words, runs).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count, pa.int64()), pa.array(found, run_type), pa.array(texts, pa.string())], ["id", "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text"))
    return rows.mapInArrow(trimmed(look), f"id {kind}, {FOUND}").withColumnRenamed("id", id_col)


def with_planted_tails(docs: DataFrame) -> DataFrame:
    """The query's texts: of every tenth id's checksum the words from one on repeat with one period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), 0)
    some = docs.withColumn("h", h).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    some = some.withColumn("a", F.when(n > 0, a)).withColumn("p", F.when(n > 0, p))
    tail = F.transform(F.slice("w", F.col("a") + 1, n - F.col("a")), lambda _, i: F.get("w", F.col("a") + i % F.col("p")))
    made = F.array_join(F.concat(F.slice("w", 1, F.col("a")), tail), " ")
    return some.select("doc_id", F.when(F.col("p").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def op11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_tails(table(spark, sf_dir, "documents").select("doc_id", "text")))
    # greatest length, then smallest start, then smallest period
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r.length).alias("l"), r.start.alias("s"), r.period.alias("q")))), 1)
    line = F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n")))
    rows = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.q").alias("period"),
        F.floor(-1000 * F.col("best.l") / F.col("best.q")).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
