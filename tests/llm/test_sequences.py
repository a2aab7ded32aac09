"""Fill-in-the-middle, periodic runs and repeated word windows against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gossamer.llm import infill, periods, subtrees

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, n long, h long, d long, tag long, p long, id long, output string, runs string, kept string, `a.b` string"


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, 6, "x", "x", "x", "x") for i, t in rows], COLUMNS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdéß中𝄞") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, line = say(70), say(12)
    long = say(6000)
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "  lead"), (6, "trail \x0b\x0c"), (7, "holds <M> inside"), (8, say(49)), (9, say(50)), (10, say(30) + " " + shared + "\n" + say(30)),
        (11, shared), (12, say(10) + "\t" + shared), (13, long), (14, long.replace(" ", "\n")), (15, " ".join(["a"] * 3000)), (16, " ".join(["a"] * 2000)), (17, " ".join([line] * 40)), (18, " ".join([line] * 41)),
        (None, shared + " " + say(5)), (20, "same id " + shared), (20, "other text " + shared), (9, "again"), (21, "no break spaces here"), (22, " ".join(["x y z"] * 5 + ["q"] + ["x y z"] * 5)),
    ]
    rows += [(30, rows[9][1])] * 2
    return rows + [(100 + i, say(rng.randint(1, 90)) + " " + (line if i % 3 else shared)) for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return table_of(spark, texts).repartition(5)


# -- fill in the middle ---------------------------------------------------------------------------


def plain_infill(doc_id, text):
    """Units by hand, one character after the other."""
    units, space = [], " \t\n\x0b\x0c\r"
    for c in text:
        if not units or (units[-1][-1] not in space and c in space):
            units.append(c)
        else:
            units[-1] += c
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_infill_equals_a_plain_version_and_can_be_undone(docs, texts):
    made = infill.infill(docs).withColumn("back", infill.restored(F.col("output"), F.col("form")))
    got = sorted((tuple(r) for r in made.collect()), key=repr)
    want = []
    for i, t in texts:
        x = plain_infill(i, t or "")
        want.append((i, *x, hashlib.sha256(x[4].encode()).hexdigest(), t or ""))
    assert got == sorted(want, key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_infill_restores_texts_full_of_almost_marks(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("<>PSM \n") for _ in range(rng.randint(0, 40)))) for i in range(400)]
    out = infill.infill(table_of(spark, rows), rate=100, spm_rate=50)
    out = out.select("doc_id", "form", infill.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert {r.doc_id: r.back for r in out} == dict(rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_infill_of_an_empty_table(spark):
    assert infill.infill(table_of(spark, [])).collect() == []


# -- periodic runs --------------------------------------------------------------------------------


def plain_runs(a):
    out = set()
    for q in range(1, len(a) // 4 + 1):
        i = 0
        while i + q < len(a):
            s = i
            while i + q < len(a) and a[i] == a[i + q]:
                i += 1
            e = i + q
            if i > s and e - s >= max(6, 4 * q):
                w = a[s:e]
                if next(p for p in range(1, q + 1) if all(x == y for x, y in zip(w, w[p:]))) == q:
                    out.add((s, e - s, q))
            i = max(i, s + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_a_plain_version_on_random_sequences():
    rng = random.Random(1)
    for _ in range(1500):
        k = rng.choice([1, 2, 2, 3, 5, 20])
        a = [rng.randrange(k) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 4)):
            root = [rng.randrange(k) for _ in range(rng.randint(1, 12))] if rng.random() < 0.5 else [0] * rng.randint(1, 15) + [1] * rng.randint(0, 15)
            at = rng.randint(0, len(a))
            a[at:at] = (root * 8)[: rng.randint(len(root), 7 * len(root))]
        assert periods.find_runs(np.array(a, np.int64)) == plain_runs(a), a


@pytest.mark.parametrize("a", [[0] * 100_000, [0, 1] * 50_000, [x for i in range(1500) for x in [0] * (50 + i % 37) + [1 + i % 3]]], ids=["one word", "two words", "broken runs of one word"])
def test_runs_of_few_words_are_no_quadratic_case(a):
    import time

    began = time.time()
    assert periods.find_runs(np.array(a, np.int64))
    assert time.time() - began < 15


def test_periodic_runs_of_a_table(docs, texts):
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periods.periodic_runs(docs).collect()), key=repr)
    want = []
    for i, t in texts:
        words = WORD.findall(t or "")
        runs = plain_runs(words) if len(words) < 1000 else periods.find_runs(periods.word_numbers([w.encode() for w in words]))
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((i, len(words), runs, " ".join(w for k, w in enumerate(words) if k not in gone)))
    assert got == sorted(want, key=repr)
    assert sum(len(r[2]) > 0 for r in got) >= 5


def test_periodic_runs_of_an_empty_table(spark):
    assert periods.periodic_runs(table_of(spark, [])).collect() == []


def test_query_of_periodic_runs(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in periods.op11_query(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    planted = 0
    for doc_id, text in rows:
        w = WORD.findall(text or "")
        n, h = len(w), zlib.crc32(str(doc_id).encode())
        if n and h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
            planted += 1
        runs = plain_runs(w)
        best = min(((-x[1], x[0], x[2]) for x in runs), default=None)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        r = got[doc_id]
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
    assert planted


# -- repeated windows -----------------------------------------------------------------------------


def plain_windows(texts, size=50):
    first: dict[tuple, float] = {}
    low = lambda i: float("-inf") if i is None else i
    split = [(i, WORD.findall(t or "")) for i, t in texts]
    for i, w in split:
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, float("inf")), low(i))
    out = []
    for i, w in split:
        gone = {x for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < low(i) for x in range(k, k + size)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("many", [256, 3, 0])
def test_windows_equal_a_plain_version(docs, texts, monkeypatch, many):
    monkeypatch.setattr(subtrees, "MANY_DOCUMENTS", many)
    got = sorted((tuple(r) for r in subtrees.remove_repeated_windows(docs).drop("kept").collect()), key=repr)
    want = plain_windows(texts)
    assert got == want
    assert sum(0 < r[2] < r[1] for r in want) > 10


def test_the_text_kept_has_the_digest(docs):
    rows = subtrees.remove_repeated_windows(docs).where("kept is not null").collect()
    assert rows and all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in rows)


def test_windows_of_an_empty_table(spark):
    assert subtrees.remove_repeated_windows(table_of(spark, [])).collect() == []


def test_deep_nodes_are_the_sets_of_equal_windows():
    rng = random.Random(2)
    depth = 4 * subtrees.CODE
    for _ in range(200):
        strings = list({b"".join(rng.choice([b"\0" * 8, b"\1" * 8]) for _ in range(rng.randint(4, 12))) for _ in range(rng.randint(1, 5))})
        sets: dict[bytes, list] = {}
        for k, s in enumerate(strings):
            for i in range(0, len(s) - depth + 1, 8):
                sets.setdefault(s[i : i + depth], []).append((k, i // 8))
        got = sorted(sorted(x) for x in subtrees.deep_nodes(strings, depth))
        assert got == sorted(sorted(x) for x in sets.values() if len(x) > 1)


def test_windows_of_different_strings_are_found_by_the_tree(monkeypatch):
    word = lambda k: k.to_bytes(8, "big")
    shared = b"".join(map(word, range(52)))
    group = {word(900) + shared + word(901): (7, [100]), word(902) * 2 + shared: (3, [5]), word(903) + shared[8:]: (9, [40, 60])}
    # windows 0 to 2 of the shared words are in 3 and 7, windows 1 and 2 in 9
    assert sorted(subtrees.repeats_of_group(group)) == [(7, 101, 153), (9, 41, 92), (9, 61, 112)]
    monkeypatch.setattr(subtrees, "deep_nodes", lambda strings: iter(()))
    assert list(subtrees.repeats_of_group(group)) == []


def test_planted_tails_of_odd_texts(spark):
    """Ids whose checksum plants a tail, with texts of no, one and some words, and a null id."""
    ids = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 10 == 0][:40]
    kinds = [None, "", " \n", "one", "a b", "a\tb  c d e f g h"]
    rows = [(i, kinds[k % len(kinds)]) for k, i in enumerate(ids)] + [(None, "a b c"), (next(i for i in range(50) if i not in ids), "kept  as it\nis")]
    got = {r.doc_id: r.text for r in periods.with_planted_tails(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        w = WORD.findall(t or "")
        if i in ids and w:
            g = zlib.crc32(str(i).encode()) // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            assert got[i] == " ".join(w[a + (k - a) % p] if k >= a else x for k, x in enumerate(w))
        else:
            assert got[i] == t
