"""The classifier's statistics, its fit and its query against plain loops."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gossamer.llm import quality

PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SF = "/root/testdata/sf0.001"


def byte_class(c: int) -> int | None:
    """Lower, upper, digit, white space, line end, continuation byte, leading byte, control; then each mark."""
    if 97 <= c <= 122:
        return 0
    if 65 <= c <= 90:
        return 1
    if 48 <= c <= 57:
        return 2
    if c in (32, 9, 11, 12, 13):
        return 3
    if c == 10:
        return 4
    if c >= 128:
        return 5 if c < 192 else 6
    return 8 + PUNCT.index(chr(c)) if chr(c) in PUNCT else 7


def end_class(c: int) -> int | None:
    kind = byte_class(c)
    if kind in (0, 1, 2):
        return kind
    if kind in (5, 6):
        return 3
    return None if kind in (3, 4, 7) else 4 if chr(c) in ".,;:?" else 5


def plain_stats(text):
    out = [0.0] * (8 + len(PUNCT) + 25)
    if not text:
        return out
    raw = text.encode()
    n, k, space = len(raw), 8 + len(PUNCT), b" \t\n\x0b\x0c\r"
    for c in raw:
        if byte_class(c) is not None:
            out[byte_class(c)] += 1 / n
    ends = [a for a, b in zip(raw, raw[1:]) if b in space and a not in space]
    begins = [b for a, b in zip(raw, raw[1:]) if a in space and b not in space]
    for base, found in ((k, ends), (k + 6, begins)):
        for c in found:
            if end_class(c) is not None:
                out[base + end_class(c)] += 1 / len(found)
    rest = k + 12
    words, lines = raw.lower().split(), [x for x in raw.split(b"\n") if x]
    out[rest] = math.log(1 + n)
    out[rest + 1] = -sum(raw.count(bytes([c])) / n * math.log2(raw.count(bytes([c])) / n) for c in set(raw))
    if words:
        lens = [len(w) for w in words]
        mean = sum(lens) / len(lens)
        pairs = set(zip(words, words[1:]))
        out[rest + 2 : rest + 9] = [mean, math.sqrt(sum((x - mean) ** 2 for x in lens) / len(lens)), max(lens), len(set(words)) / len(words), len(pairs) / max(1, len(words) - 1), sum(x <= 3 for x in lens) / len(lens), sum(x >= 14 for x in lens) / len(lens)]
    if lines:
        out[rest + 9 : rest + 12] = [len(set(lines)) / len(lines), n / len(lines), math.log(1 + len(lines))]
    out[rest + 12] = math.log(1 + len(words))
    return out


@pytest.mark.parametrize("text", [None, "", "a", " ", "\n\n", "Hello, World!\nHello, World!\n", "é中𝄞 tab\there. 12 AB?\x01\x7f", "one\ttwo  three\r\n\x0bfour", "x" * 40 + " y" * 7])
def test_statistics_equal_plain_loops(text):
    assert np.allclose(quality.document_stats(text), plain_stats(text), atol=1e-4)


def plain_fit(x, y, trees, depth):
    """Boosting with loops: every split of every node is tried."""
    mean = min(max(sum(y) / len(y), 1e-3), 1 - 1e-3)
    base = math.log(mean / (1 - mean))
    raw, d = [base] * len(y), len(x[0])
    cuts = [np.unique(np.quantile([r[j] for r in x], np.linspace(0, 1, quality.N_BINS + 1)[1:-1])).tolist() for j in range(d)]
    for _ in range(trees):
        p = [1 / (1 + math.exp(-r)) for r in raw]
        nodes = {0: list(range(len(y)))}
        for _ in range(depth):
            after = {}
            for name, rows in nodes.items():
                best = None
                tg, th = sum(p[i] - y[i] for i in rows), sum(p[i] * (1 - p[i]) for i in rows)
                for j in range(d):
                    for c in cuts[j]:
                        lg = sum(p[i] - y[i] for i in rows if x[i][j] <= c)
                        lh = sum(p[i] * (1 - p[i]) for i in rows if x[i][j] <= c)
                        if lh < quality.MIN_HESSIAN or th - lh < quality.MIN_HESSIAN:
                            continue
                        gain = lg**2 / (lh + quality.L2) + (tg - lg) ** 2 / (th - lh + quality.L2) - tg**2 / (th + quality.L2)
                        if gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                            best = (gain, j, c)
                right = [i for i in rows if best and x[i][best[1]] > best[2]]
                after[2 * name], after[2 * name + 1] = [i for i in rows if i not in set(right)], right
            nodes = after
        for rows in nodes.values():
            value = -quality.RATE * sum(p[i] - y[i] for i in rows) / (sum(p[i] * (1 - p[i]) for i in rows) + quality.L2)
            for i in rows:
                raw[i] += value
    return [1 / (1 + math.exp(-r)) for r in raw]


def test_fit_equals_plain_boosting():
    rng = random.Random(6)
    x = [[rng.random(), rng.random(), rng.choice([0.0, 1.0, 2.0])] for _ in range(160)]
    y = [int(r[0] + 0.3 * r[2] + rng.gauss(0, 0.2) > 0.8) for r in x]
    model = quality.fit(np.array(x), np.array(y, float), 4, 3)
    assert np.allclose(model.score(np.array(x)), plain_fit(x, y, 4, 3), atol=1e-9)


def walk(model, row):
    raw = model.base
    for f, cut, leaf in zip(model.feature, model.threshold, model.leaf):
        at = 0
        while at < len(f):
            at = 2 * at + 1 + int(row[f[at]] > cut[at])
        raw += leaf[at - len(f)]
    return 1 / (1 + math.exp(-raw))


def test_query_equals_a_plain_version(spark):
    docs = {r.doc_id: np.array(plain_stats(r.text), np.float32) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    labels: dict[int, list[int]] = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        if r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5:
            labels.setdefault(r.doc_id, []).append(r.quality)
    ids = sorted(i for i in labels if i in docs)
    # the statistics are rounded to what the operator keeps, so that equal ones stay equal
    stats = {i: quality.document_stats(t).astype(float) for i, t in ((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())}
    assert all(np.allclose(stats[i], docs[i], atol=1e-3) for i in docs)
    model = quality.fit(np.array([stats[i] for i in ids]), np.array([sum(labels[i]) / len(labels[i]) for i in ids]))
    got = {r.doc_id: r for r in quality.op4_query(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for i, r in got.items():
        assert r.score == pytest.approx(walk(model, stats[i]), abs=1e-9)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)


def test_an_empty_table_has_no_statistics_and_no_labels_give_a_half(spark):
    none = spark.createDataFrame([], "doc_id long, text string, quality int")
    stats = quality.features(none)
    assert stats.collect() == []
    model = quality.fit_quality(stats, none)
    assert quality.score_documents(spark.createDataFrame([(1, "x")], "doc_id long, text string"), model).first().score == pytest.approx(0.5)
