"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gossamer.llm.groups import numbered
from gossamer.session import bounded_batches, materialize, table, trimmed

#: At most about this many labelled rows are used for fitting (drawn by a hash of the id).
MAX_FIT_ROWS = 30_000
THRESHOLD = 0.3
N_BINS = 64
N_TREES = 100
DEPTH = 5
RATE = 0.1
L2 = 1.0
MIN_HESSIAN = 1.0

_PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _classes() -> np.ndarray:
    """256 x C membership of byte values in the classes that are counted."""
    m = np.zeros((256, 8 + len(_PUNCT)), np.float64)
    m[97:123, 0] = 1
    m[65:91, 1] = 1
    m[48:58, 2] = 1
    m[[32, 9, 11, 12, 13], 3] = 1
    m[10, 4] = 1
    m[128:192, 5] = 1
    m[192:, 6] = 1
    m[[*range(9), *range(14, 32), 127], 7] = 1
    for i, c in enumerate(_PUNCT):
        m[c, 8 + i] = 1
    return m


_CLASSES = _classes()
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Word ends are told apart by: lower, upper, digit, other high byte, stop marks, other marks.
_ENDS = np.zeros((256, 6))
_ENDS[97:123, 0] = _ENDS[65:91, 1] = _ENDS[48:58, 2] = _ENDS[128:, 3] = 1
for _c in _PUNCT:
    _ENDS[_c, 4 if _c in b".,;:?" else 5] = 1
N_STATS = _CLASSES.shape[1] + 12 + 13


def document_stats(text: str | None) -> np.ndarray:
    """Statistics of one whole text; all zeros for an empty or null one."""
    out = np.zeros(N_STATS, np.float32)
    if not text:
        return out
    raw = text.encode("utf-8", "surrogatepass")
    a = np.frombuffer(raw, np.uint8)
    n = len(a)
    counts = np.bincount(a, minlength=256)
    k = _CLASSES.shape[1]
    out[:k] = (counts @ _CLASSES) / n
    space = _SPACE[a]
    ends = np.bincount(a[:-1][space[1:] & ~space[:-1]], minlength=256) if n > 1 else np.zeros(256)
    begins = np.bincount(a[1:][space[:-1] & ~space[1:]], minlength=256) if n > 1 else np.zeros(256)
    out[k : k + 6] = (ends @ _ENDS) / max(1, ends.sum())
    out[k + 6 : k + 12] = (begins @ _ENDS) / max(1, begins.sum())
    words = raw.lower().split()
    w = len(words)
    p = counts[counts > 0] / n
    lines = [x for x in raw.split(b"\n") if x]
    rest = out[k + 12 :]
    rest[0] = np.log1p(n)
    rest[1] = -(p * np.log2(p)).sum()
    if w:
        lens = np.fromiter(map(len, words), np.int64, w)
        rest[2] = lens.mean()
        rest[3] = lens.std()
        rest[4] = lens.max()
        rest[5] = len(set(words)) / w
        rest[6] = len(set(zip(words, words[1:]))) / max(1, w - 1)
        rest[7] = (lens <= 3).mean()
        rest[8] = (lens >= 14).mean()
    if lines:
        rest[9] = len(set(lines)) / len(lines)
        rest[10] = n / len(lines)
        rest[11] = np.log1p(len(lines))
    rest[12] = np.log1p(w)
    return out


@dataclass
class Trees:
    """Complete binary trees of one depth, flattened: node i has children 2i+1 and 2i+2."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1; all trees go down one level at a time."""
        n, t = len(x), len(self.feature)
        out = np.full(n, self.base)
        rows = np.arange(n)[:, None]
        trees = np.arange(t)[None, :]
        at = np.zeros((n, t), np.int64)
        depth = int(np.log2(self.leaf.shape[1])) if t else 0
        for _ in range(depth):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        if t:
            out += self.leaf[trees, at - (self.leaf.shape[1] - 1)].sum(1)
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = N_TREES, depth: int = DEPTH) -> Trees:
    """Boost on the logistic loss; splits are found on histograms of N_BINS quantile bins."""
    inner, leaves = 2**depth - 1, 2**depth
    mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(mean / (1 - mean)))
    if len(y) < 2 or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, N_BINS + 1)[1:-1])) for j in range(d)]
    bins = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)], 1)
    cells = bins + np.arange(d) * N_BINS
    raw = np.full(n, base)
    feature, threshold, leaf = np.zeros((n_trees, inner), np.int64), np.full((n_trees, inner), np.inf), np.zeros((n_trees, leaves))
    for t in range(n_trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width = 2**level
            flat = (node[:, None] * (d * N_BINS) + cells).ravel()
            size = width * d * N_BINS
            hg = np.bincount(flat, np.repeat(g, d), size).reshape(width, d, N_BINS).cumsum(2)
            hh = np.bincount(flat, np.repeat(h, d), size).reshape(width, d, N_BINS).cumsum(2)
            tg, th = hg[:, :1, -1:], hh[:, :1, -1:]
            rg, rh = tg - hg, th - hh
            gain = hg**2 / (hh + L2) + rg**2 / (rh + L2) - tg**2 / (th + L2)
            gain[(hh < MIN_HESSIAN) | (rh < MIN_HESSIAN)] = -1
            best = gain.reshape(width, -1).argmax(1)
            f, b = best // N_BINS, best % N_BINS
            ok = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            at = width - 1 + np.arange(width)
            cut = np.array([edges[f[i]][b[i]] if ok[i] and b[i] < len(edges[f[i]]) else np.inf for i in range(width)])
            feature[t, at], threshold[t, at] = f, cut
            node = 2 * node + (x[np.arange(n), f[node]] > cut[node])
        sg, sh = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        leaf[t] = -RATE * sg / (sh + L2)
        raw += leaf[t][node]
    return Trees(feature, threshold, leaf, base)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats binary): float32 statistics of every whole text, one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = [document_stats(t).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(stats, pa.binary())], ["id", "stats"])

    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(trimmed(run), T.StructType([T.StructField("id", kind), T.StructField("stats", T.BinaryType())]))


def fit_quality(stats: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> Trees:
    """Fit on labelled ids whose crc32 modulo 5 is not 0; null labels and ids are left out, and an id
    with several labels counts with their mean.

    The driver gets at most about ``max_rows`` fixed-width rows, however many labels there are.
    """
    text_id = F.col("id").cast("string")
    usable = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y")).where("y in (0, 1)").where(F.pmod(F.crc32(text_id), F.lit(5)) != 0)
    n = usable.count()
    draw = F.conv(F.substring(F.md5(text_id), 1, 8), 16, 10).cast("double") / 4294967296.0
    if n > max_rows:
        usable = usable.where(draw < max_rows / n)
    got = stats.join(usable.groupBy("id").agg(F.avg("y").alias("y")), "id").select("id", "stats", "y").orderBy("id", "stats").select("stats", "y").toPandas()
    x = np.frombuffer(b"".join(got["stats"]), np.float32).reshape(-1, N_STATS) if len(got) else np.zeros((0, N_STATS), np.float32)
    return fit(x.astype(np.float64), got["y"].to_numpy(np.float64))


def score_stats(stats: DataFrame, model: Trees) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(-1, N_STATS)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x.astype(np.float64)))], ["id", "score"])

    return stats.mapInArrow(trimmed(run), T.StructType([stats.schema["id"], T.StructField("score", T.DoubleType())]))


def score_documents(docs: DataFrame, model: Trees, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of each whole text, in one pass (no shuffle).

    Null and empty texts have all statistics 0 and the score that the trees give that; every row comes
    back with a score of its own, also repeated ones; an empty table gives no rows. A column of
    ``docs`` that is named ``score_col`` is an error: name another.
    """
    if score_col in docs.columns:
        raise ValueError(f"the documents have a column {score_col} already")

    bounded_batches(docs.sparkSession)
    where, rows = docs.columns.index(text_col), numbered(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([document_stats(t) for t in b.column(where).to_pylist()]) if b.num_rows else np.zeros((0, N_STATS), np.float32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x.astype(np.float64)))], [*b.schema.names, "score"])

    return rows.mapInArrow(trimmed(run), T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])).toDF(*docs.columns, score_col)


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialize(features(table(spark, sf_dir, "documents").select("doc_id", "text")), "stats")
    model = fit_quality(stats, table(spark, sf_dir, "labels"))
    scored = score_stats(stats, model).withColumnRenamed("id", "doc_id")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
