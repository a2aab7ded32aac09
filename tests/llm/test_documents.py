"""The operators over documents: brute force, round trips, and the odd cases that tables hold."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gossamer.llm import bytesets, decontaminate, jaccard, mixing, mixlm, quality, suffixes, tokenbin, webp

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, rate double, kept boolean, hits string, n_tokens long, key long, id long, d long, h long, _n long"


def rows_of(texts):
    return [(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), 0.5, 0.5, True, "x", 1, 1, 1, 1, 1, 1) for i, t in texts]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, near copies, and clashing columns."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    near = list(base)
    near[60] = "changed"
    long = " ".join(rng.choice(words) for _ in range(20_000))
    texts = [
        (1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (4, None), (5, ""), (6, "   \n\t"), (7, "one"), (8, "One"), (9, "a b c"), (10, long), (11, long[:50_000] + " tail " + long[50_000:]),
        (12, "x" * 5000), (13, " ".join(rng.choice(words) for _ in range(300))), (14, "é" * 300), (15, " ".join(base[:60] + [rng.choice(words) for _ in range(200)])), (None, " ".join(base)), (7, "one"), (20, "same id first"), (20, "same id second text"),
    ]
    return spark.createDataFrame(rows_of(texts), DOCS), texts


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# -- word hashing ---------------------------------------------------------------------------------


def test_word_hashes_tell_words_apart():
    texts = ["A b\x0bc", None, "", "x" * 9000 + " y", "ab a b é É", " lead", "trail "]
    data, off = bytesets.text_column(pa.array(texts))
    h, at = bytesets.word_hashes(data, off)
    seen = {}
    for i, t in enumerate(texts):
        for w, v in zip((t or "").encode().lower().split(), h[at[i] : at[i + 1]].tolist(), strict=True):
            assert seen.setdefault(w, v) == v
    assert len(set(seen.values())) == len(seen)


# -- 9: n-gram Jaccard join -----------------------------------------------------------------------


def brute_classes(texts, k, num, den):
    sets = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    ids = [i for i, _ in texts]
    parent = {i: i for i in ids if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if ids[a] is None or ids[b] is None or not sets[a] or not sets[b]:
                continue
            both = len(sets[a] & sets[b])
            if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(ids[a]), find(ids[b])
                parent[max(x, y)] = min(x, y)
    return collections.Counter((i, len(s), None if i is None else find(i)) for i, s in zip(ids, sets))


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80), (2, 50)])
def test_jaccard_classes_match_brute_force(spark, odd, k, num):
    df, texts = odd
    got = collections.Counter(tuple(r) for r in jaccard.jaccard_classes(df, num, 100, k).collect())
    assert got == brute_classes(texts, k, num, 100)


def test_jaccard_large_mixed_groups(spark):
    """Many near copies around the threshold, so that buckets hold several classes."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(80)] = f"v{rng.randrange(12)}"
        texts.append((i, " ".join(w)))
    df = spark.createDataFrame(rows_of(texts), DOCS)
    got = collections.Counter(tuple(r) for r in jaccard.jaccard_classes(df).collect())
    want = brute_classes(texts, 4, 85, 100)
    assert got == want and len({c for _, _, c in want}) > 3


def test_jaccard_layouts_and_signatures_cover_linked_sets():
    """Sets within the threshold share a key, in exact and in one-deletion layouts."""
    rng = np.random.default_rng(1)
    hot = np.zeros(1 << jaccard.HOT_BITS, bool)
    for counts in ({}, {b: 10**9 for b in range(60)}):
        bands = jaccard.Bands(85, 100, counts)
        for _ in range(150):
            n = int(rng.integers(1, 90))
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            drop = int(rng.integers(0, max(1, len(x) // 8)))
            y = np.unique(np.concatenate([x[drop:], rng.integers(0, 2**63, int(rng.integers(0, max(1, n // 10)))).astype(np.uint64)]))
            both = len(np.intersect1d(x, y))
            if 100 * both >= 85 * (len(x) + len(y) - both):
                assert set(jaccard.signatures(x, bands, hot).tolist()) & set(jaccard.signatures(y, bands, hot).tolist())
    assert any(jaccard.Bands(85, 100, {b: 10**9 for b in range(60)}).layout(b)[2] for b in range(20))


def test_jaccard_empty_table(nothing):
    assert jaccard.jaccard_classes(nothing).count() == 0


def test_pack_rows_round_trip():
    key = (np.arange(50, dtype=np.uint64) << np.uint64(40)).view(np.int64)
    doc = np.arange(50) * (1 << 33) - 7
    k, d, n = jaccard.unpack_rows(jaccard.pack_rows(key, doc, -np.arange(50)))
    assert (k == key).all() and (d == doc).all() and (n == -np.arange(50)).all()


# -- 10: repeated substrings ----------------------------------------------------------------------


def brute_repeats(texts):
    order = sorted({(i is not None, i or 0, suffixes.text_tag((t or "").encode()), i, t or "") for i, t in texts}, key=lambda x: x[:3])
    seen, out = set(), {}
    for _, _, _, i, t in order:
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[(i, t)] = (i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return collections.Counter(out[(i, t or "")] for i, t in texts)


def test_repeats_match_brute_force(spark, odd):
    df, texts = odd
    got = collections.Counter(tuple(r) for r in suffixes.remove_repeats(df).drop("kept").collect())
    assert got == brute_repeats(texts)


def test_repeats_across_many_documents(spark):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcde ") for _ in range(160))
    texts = [(i, "".join(rng.choice("abcde ") for _ in range(rng.randint(0, 200))) + (passage[: rng.randint(90, 160)] if i % 2 else "") + "".join(rng.choice("abcde ") for _ in range(80))) for i in range(60)]
    df = spark.createDataFrame(rows_of(texts), DOCS).repartition(5)
    got = collections.Counter(tuple(r) for r in suffixes.remove_repeats(df).drop("kept").collect())
    assert got == brute_repeats(texts)


def group_of(stretches):
    """Merged order with shared prefixes, as the tree gives it: (text, anchor offset, document, place)."""
    strings = {}
    for text, anchor, d, p in stretches:
        s = suffixes.suffix_string(7, text, 0, len(text) - suffixes.WINDOW, anchor)
        strings[s] = min(strings.get(s, (d, p)), (d, p))
    out, before = [], b""
    for s in sorted(strings):
        out.append((s, suffixes.shared_prefix(before, s, 0), *strings[s]))
        before = s
    return out


@pytest.mark.parametrize("few", [0, 10, 1000])
def test_repeats_are_decided_by_shared_prefixes(monkeypatch, few):
    monkeypatch.setattr(suffixes, "FEW", few)
    rng = random.Random(few)
    for trial in range(60):
        base = bytes(rng.choice(b"ab") for _ in range(60)) + b"0123456789abcdef" + bytes(rng.choice(b"ab") for _ in range(84))
        stretches = []
        for d in range(rng.choice([2, 3, 9, 14])):
            left, right = rng.randint(0, 60), rng.randint(60, 84)
            text = bytearray(base[60 - left : 76 + right])
            for _ in range(rng.choice([0, 0, 1, 2])):
                k = rng.choice([*range(0, max(1, left - 20)), *range(left + 60, len(text))])
                if not left <= k < left + 16 and k < len(text):
                    text[k] ^= 1
            if len(text) >= suffixes.WINDOW:
                stretches.append((bytes(text), left, d, 1000 * d))
        group = group_of(stretches)
        if len(group) < 2:
            continue
        seen, want = set(), set()
        for s, _, d, p in sorted(group, key=lambda g: g[2:]):
            n, back = suffixes.sides(s)
            text = back[::-1] + s[8 : 8 + n]
            for i in range(len(text) - 99):
                want |= {(d, p + i + j) for j in range(100)} if text[i : i + 100] in seen else set()
                seen.add(text[i : i + 100])
        got = {(d, x) for d, s, e in suffixes.repeated_windows(group) for x in range(s, e)}
        assert got == want
        # without the merge's shared prefixes nothing would be found
        assert list(suffixes.repeated_windows([(s, 8, d, p) for s, _, d, p in group])) == []


def test_repeats_empty_table(nothing):
    assert suffixes.remove_repeats(nothing).count() == 0


def test_loser_tree_merges_without_comparing_known_prefixes():
    rng = random.Random(2)
    pool = [b"common-prefix-" * 6 + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(400)]
    runs = [sorted(set(pool[i::7])) for i in range(7)]
    blocks = [[suffixes.front_code(r[a : a + 20], np.arange(len(r[a : a + 20])), np.arange(len(r[a : a + 20]))) for a in range(0, len(r), 20)] for r in runs]
    tree = suffixes.LoserTree([suffixes.decode_run(b) for b in blocks])
    out = list(tree)
    assert [x[0] for x in out] == sorted(x for r in runs for x in r)
    for a, b in zip(out, out[1:]):
        assert b[1] == suffixes.shared_prefix(a[0], b[0], 0)
    assert tree.compared < sum(len(x[0]) for x in out)


def test_anchors_depend_on_the_window_alone():
    a = np.frombuffer(random.Random(1).randbytes(400), np.uint8)
    m = suffixes.anchors(suffixes.kmer_hashes(a)) - np.arange(301)
    b = np.concatenate([np.zeros(37, np.uint8), a])
    n = suffixes.anchors(suffixes.kmer_hashes(b)) - np.arange(338)
    assert (n[37:] == m).all()


# -- 7: token files -------------------------------------------------------------------------------


def test_bit_packing_round_trip_and_random_access():
    for bits in (1, 5, 13, 16, 17, 20, 32):
        ids = np.random.default_rng(bits).integers(0, 2**bits, 10_001).astype("<u4")
        s = tokenbin.Shard(tokenbin.write_shard([1, None], [1, 10_000], ids, bits, block=64))
        assert (s.ids(0, len(ids)) == ids).all() and (s.ids(4_000, 333) == ids[4_000:4_333]).all()
        assert len(s.data) <= (len(ids) * bits + 7) // 8 + 1 and s.nulls.tolist() == [0, 1]


def test_token_files_match_the_tokenizer(spark, odd):
    from tokenizers import Tokenizer

    df, texts = odd
    t = Tokenizer.from_file(tokenbin.default_tokenizer())
    ids = {x: [*t.encode(x or "", add_special_tokens=False).ids, 2] for _, x in texts}
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for i, x in order:
        want.append((i, at, len(ids[x]), zlib.crc32(np.array(ids[x], "<u4").tobytes())))
        at += len(ids[x])
    got = tokenbin.tokenize_to_files(df, tokenbin.default_tokenizer(), 2).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert collections.Counter(tuple(r) for r in got) == collections.Counter(want)


def test_small_shards_and_empty_table(spark, odd, nothing, tmp_path):
    df, texts = odd
    tokenbin.write_tokens(df, f"file://{tmp_path}/a", tokenbin.default_tokenizer(), 2, shard_ids=50)
    got = tokenbin.with_starts(tokenbin.read_tokens(spark, f"file://{tmp_path}/a", with_ids=True)).collect()
    whole = tokenbin.tokenize_to_files(df, tokenbin.default_tokenizer(), 2).collect()
    assert sorted((r["start"], r["ids_crc32"]) for r in got) == sorted((r["start"], r["ids_crc32"]) for r in whole)
    assert all(len(r["ids"]) == r["n_tokens"] for r in got)
    assert tokenbin.tokenize_to_files(nothing, tokenbin.default_tokenizer(), 2).count() == 0


def test_word_encoder_agrees_on_odd_words():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenbin.default_tokenizer())
    texts = ["it's don't 'tis THE,THE. x!!", "<|endoftext|> <|ENDOFTEXT|>", "école CAFÉ İ a̸= 1234,56 ß… a….", " a b\x1cc\x85d", "", None, "µm ª ﬁ hello!!!'' abc's'd", "\U0001f600!! z̈."]
    enc = tokenbin.WordEncoder(tokenbin.default_tokenizer())
    want = [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts, 2)] == want
    for part in (texts, [x for x in texts if not x or "<|" not in x]):
        flat = [i for ids, _ in enc.encode_column(pa.array(part), 2) for i in ids.tolist()]
        assert flat == [i for x in part for i in want[texts.index(x)]]


# -- 3: language model ----------------------------------------------------------------------------


class PlainModel:
    """The context-mixing model with dictionaries and loops, from the same definitions."""

    def __init__(self, texts):
        self.train = [(i, t or "") for i, t in texts if not mixlm.held_out(i)]
        self.c, self.slots, self.pairs, self.gaps, self.cases = (collections.Counter() for _ in range(5))
        self.after = collections.defaultdict(dict)
        hashes = [self.tokens(t) for _, t in self.train]
        for h in hashes:
            self.c.update(h)
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.escape = (sum(x == 1 for x in self.c.values()) + 1) / (self.n + 2)
        self.frequent = {h for h, c in self.c.items() if c * mixlm.FREQUENT >= self.n and h != int(mixlm.END_HASH)}
        self.tree = collections.Counter()
        for h, c in self.c.items():
            for k in range(mixlm.BITS + 1):
                self.tree[self.code(h) >> k] += c
        for d, (h, (_, t)) in enumerate(zip(hashes, self.train)):
            for k in range(len(h)):
                for j, ctx in enumerate(self.contexts(h, k)):
                    if ctx is not None:
                        for s, bit, _ in self.path(ctx, h[k]):
                            self.slots[j, s, bit] += 1
            seen = {}
            for k, key in self.anchors(h):
                seen.setdefault(key, self.following(h, k))
            for key, f in seen.items():
                self.after[key][d] = f
            raw = bytes(mixlm._FOLD[np.frombuffer(t.encode(), np.uint8)].astype(np.uint8))
            self.pairs.update((x, y) for x, y in zip(raw, raw[1:]) if (x, y) != (32, 32))
            gaps, cases = self.forms(t)
            self.gaps.update((g[:3]) for g in gaps)
            self.cases.update((c[:2]) for c in cases)

    def tokens(self, t):
        data, off = bytesets.text_column(pa.array([t]))
        return [*bytesets.word_hashes(data, off)[0].tolist(), int(mixlm.END_HASH)]

    def code(self, h):
        return (h >> (64 - mixlm.BITS)) | mixlm.NODES

    def contexts(self, h, k):
        w = (1 << 64) - 1
        c1, c2, c3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
        f = [x for x in reversed(h[:k]) if x in self.frequent][:2] + [0, 0]
        one = k >= 1 and h[k - 1] in self.frequent
        two = one and k >= 2 and h[k - 2] in self.frequent
        return [h[k - 1] * c1 & w if one else None, (f[0] * c2 + f[1] * c3 + 1) & w if f[0] else None, (h[k - 1] * c3 + h[k - 2] * c1 + 7) & w if two else None]

    def path(self, ctx, h):
        """(slot, bit, node) of each level."""
        code, out = self.code(h), []
        for level in range(mixlm.BITS):
            start = level - level % 4
            x = (ctx ^ ((code >> (mixlm.BITS - start)) * 0x165667B19E3779F9)) * 0xC2B2AE3D27D4EB4F & ((1 << 64) - 1)
            x ^= x >> 32
            x = (x * 0x9E3779B97F4A7C15 & ((1 << 64) - 1)) >> (64 - mixlm.TABLE_BITS + 4)
            node = code >> (mixlm.BITS - level)
            within = 1 << (level - start) | node & ((1 << (level - start)) - 1)
            out.append((x * 16 + within, code >> (mixlm.BITS - 1 - level) & 1, node))
        return out

    def anchors(self, h):
        for k in range(2, len(h)):
            if h[k] != int(mixlm.END_HASH):
                x = np.array([h[k] * 0x9E3779B97F4A7C15 + h[k - 1] * 0xC2B2AE3D27D4EB4F + h[k - 2] * 0x165667B19E3779F9 & ((1 << 64) - 1)], np.uint64)
                key = int(bytesets.mix64(x)[0])
                if key % mixlm.ANCHOR_EVERY == 0:
                    yield k, key

    def following(self, h, k):
        c = [x >> (64 - mixlm.BITS) for x in h[k + 1 : k + 1 + mixlm.REACH]]
        c += [0] * (mixlm.REACH - len(c))
        return tuple(c[:5]), tuple(c[5:])

    def forms(self, t):
        gaps, cases = [], []
        raw = t.encode()
        pieces = re.split(rb"([ \t-\r]+)", raw)
        words = [(raw_at, x) for raw_at, x in enumerate(pieces) if raw_at % 2 == 0 and x]
        kind = lambda g: {b" ": 0, b"\n": 1, b"\n\n": 2, b"": 3}.get(g, 4)
        before, opens = 3, True
        for n, (at, x) in enumerate(words):
            g = pieces[at - 1] if at else b""
            gaps.append((0 if n == 0 else 1, before, kind(g), len(g) if kind(g) == 4 else 0))
            before = kind(g)
            letters, ups = re.findall(rb"[A-Za-z]", x), re.findall(rb"[A-Z]", x)
            case = 0 if not ups else 1 if len(ups) == 1 and x[:1].isupper() else 2 if len(ups) == len(letters) else 3
            cases.append((int(opens), case, len(letters) if case == 3 else 0))
            opens = x[-1:] in b".!?"
        tail = (pieces[-1] or pieces[-2] if len(pieces) > 1 and not pieces[-1] else b"") if words else raw
        gaps.append((2, before, kind(tail), len(tail) if kind(tail) == 4 else 0))
        return gaps, cases

    def score(self, i, t):
        """(symbol score, spelled score, log10 probability of the whole text)."""
        t = t or ""
        h, held = self.tokens(t), mixlm.held_out(i)
        own, guess, run = {}, {}, {}
        for k, key in self.anchors(h):
            own.setdefault(key, self.following(h, k))
        for k, key in self.anchors(h):
            f = list(self.after.get(key, {}).values())
            if len(f) > (0 if held else 1):
                c = []
                for half in range(2):
                    lo, hi = min(x[half] for x in f), max(x[half] for x in f)
                    c += hi if not held and lo == own[key][half] else lo
                for r, x in enumerate(c):
                    if k + 1 + r >= len(h):
                        break
                    guess[k + 1 + r], run[k + 1 + r] = x, r
                    if x != h[k + 1 + r] >> (64 - mixlm.BITS):
                        break
        weights = {(g, j): float(mixlm.START[g % 3][j]) for g in range(mixlm.GATES) for j in range(5)}
        centres = np.linspace(-8, 8, mixlm.APM_BINS)
        apm = (1 / (1 + np.exp(-centres))).tolist()
        grad, hits = collections.Counter(), collections.defaultdict(list)
        total, fresh = 0.0, 0
        words = t.encode().lower().split()
        spelled = 0.0
        for k, x in enumerate(h):
            if k in (1, 2, 4, 8, 16, 32) or (k and k % 64 == 0):
                for w, g in grad.items():
                    weights[w] += min(0.1, max(-0.1, mixlm.LEARN * g))
                for b, bits in hits.items():
                    apm[b] += (sum(bits) - len(bits) * apm[b]) / (len(bits) + 60)
                grad, hits = collections.Counter(), collections.defaultdict(list)
            p = min(1 - 1e-9, max(1e-9, (fresh + mixlm.ESCAPE_PRIOR * self.escape) / (k + mixlm.ESCAPE_PRIOR)))
            if x not in self.c:
                total += math.log10(p)
                fresh += 1
                raw = b" " + words[k] + b" "
                spelled += sum(math.log10((self.pairs[a, b] + 0.05) / (sum(self.pairs[a, z] for z in range(256)) + 12.8)) for a, b in zip(raw, raw[1:]))
                continue
            total += math.log10(1 - p) + math.log10(self.c[x]) - math.log10(self.tree[self.code(x)])
            paths = [None if ctx is None else self.path(ctx, x) for ctx in self.contexts(h, k)]
            code, right = self.code(x), 1.0
            for level in range(mixlm.BITS):
                node, bit = code >> (mixlm.BITS - level), code >> (mixlm.BITS - 1 - level) & 1
                q = (self.tree[2 * node + 1] + 0.02) / (self.tree[node] + 0.04)
                xs, grades = [min(12, max(-12, math.log(q / (1 - q))))], []
                for j, path in enumerate(paths):
                    n1, n0 = (self.slots[j, path[level][0], b] if path else 0 for b in (1, 0))
                    first = sum(self.slots[j, path[level - level % 4][0], b] for b in (0, 1)) if path else 0
                    grades.append((first >= 3) + (first >= 40))
                    q = (n1 + 0.1) / (n1 + n0 + 0.2)
                    xs.append(round(min(10, max(-10, math.log(q / (1 - q)))) * mixlm.SCALE) / mixlm.SCALE if n1 + n0 >= 3 else 0.0)
                agree = lambda n: k in guess and (guess[k] | mixlm.NODES) >> (mixlm.BITS - n) == code >> (mixlm.BITS - n)
                xs.append(((guess[k] >> (mixlm.BITS - 1 - level) & 1) * 2 - 1) * (2 + min(run[k], 4)) if agree(level) else 0.0)
                gate = grades[0] * 9 + max(grades[1:]) * 3 + ((2 if run[k] >= 2 else 1) if agree(level - level % 4) else 0)
                z = min(12, max(-12, sum(weights[gate, j] * v for j, v in enumerate(xs))))
                p1 = 1 / (1 + math.exp(-z))
                cell = min(mixlm.APM_BINS - 1.001, max(0, (z + 8) * (mixlm.APM_BINS - 1) / 16))
                low, frac = int(cell), cell - int(cell)
                final = 0.6 * p1 + 0.4 * (apm[low] * (1 - frac) + apm[low + 1] * frac)
                right *= min(1, max(1e-7, final if bit else 1 - final))
                for j, v in enumerate(xs):
                    grad[gate, j] += (bit - p1) * v
                hits[low + (frac > 0.5)].append(bit)
            total += math.log10(right)
        gaps, cases = self.forms(t)
        form = 0.0
        for place, before, g, n in gaps:
            form += math.log10((self.gaps[place, before, g] + 0.5) / (sum(self.gaps[place, before, x] for x in range(5)) + 2.5)) - n * math.log10(12)
        for o, c, n in cases:
            form += math.log10((self.cases[o, c] + 0.5) / (sum(self.cases[o, x] for x in range(4)) + 2)) - n * math.log10(2)
        return total, total + spelled, total + spelled + form


def test_lm_scores_match_a_plain_model(spark, odd, monkeypatch):
    monkeypatch.setattr(mixlm, "FREQUENT", 200)
    _, texts = odd
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    write = lambda n: "".join(rng.choice([w, w, w.title(), w.upper(), w[:1] + w[1:].upper()]) + rng.choice([" ", " ", " ", ". ", "\n", "\n\n", " \t"]) for w in (rng.choice(words) for _ in range(n)))
    quoted = write(60)
    small = [(i, t) for i, t in texts if len(t or "") < 3000 and (i or 0) < 16]
    more = [(100 + k, write(rng.choice([1, 3, 20, 70, 150]))) for k in range(36)] + [(200 + k, write(5) + quoted + write(6)) for k in range(6)] + [(300, quoted), (301, quoted), (302, write(20))]
    texts = small + more
    plain = PlainModel(texts)
    got = mixlm.score_corpus(spark.createDataFrame(rows_of(texts), DOCS)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    have = sorted(((r["doc_id"], r["n_tokens"], r["score"], r["spelled_score"], -r["bits_per_byte"] * max(1, r["n_bytes"]) / math.log2(10)) for r in got), key=key)
    want = sorted(((i, len(plain.tokens(t or "")), *plain.score(i, t)) for i, t in texts), key=key)
    assert len(have) == len(want) > 50
    for a, b in zip(have, want):
        assert a[:2] == b[:2] and np.allclose(a[2:], b[2:], rtol=1e-4, atol=1e-4)
    # the quoted texts are known from others, also the ones held out
    bits = {r["doc_id"]: r["bits_per_byte"] for r in got}
    assert max(bits[300], bits[301]) < 0.8 * bits[302]


def test_lm_every_place_may_match(monkeypatch):
    """Anchors are at every place; parts, ranges and blocks give what one dictionary gives."""
    monkeypatch.setattr(mixlm, "HELD_KEYS", 40)
    rng = np.random.default_rng(3)
    vocabulary = bytesets.mix64(np.arange(1, 6, dtype=np.uint64))
    blocks = [[(bool(rng.random() < 0.7), np.append(vocabulary[rng.integers(0, 5, rng.integers(0, 60))], mixlm.END_HASH)) for _ in range(5)] for _ in range(3)]
    after = collections.defaultdict(dict)
    for d, (trains, h) in enumerate(x for b in blocks for x in b):
        for k in range(3, len(h)):
            if trains:
                after[tuple(h[k - 3 : k])].setdefault(d, int(h[k]) >> (64 - mixlm.BITS))
    n_parts, laid, asked = 5, [], []
    for block, texts in enumerate(blocks):
        h, off = np.concatenate([t for _, t in texts]), np.cumsum([0, *(len(t) for _, t in texts)])
        trains = np.array([t for t, _ in texts])
        at, key = mixlm.anchors(h, off)
        assert at.tolist() == [int(s) + k for s, (_, t) in zip(off, texts) for k in range(2, len(t) - 1)]
        row = np.searchsorted(off, at, "right") - 1
        laid.append((h, off, trains, np.unique(key)))
        asked += mixlm.asked_rows(block, n_parts, np.unique(h), mixlm.sorted_sums(key, row, mixlm.buckets(h[at + 1]), trains[row]))
    asked = pa.Table.from_batches(asked)
    words = np.sort(np.append(vocabulary, mixlm.END_HASH))
    facts = pa.table({"h": words.view(np.int64), "c": np.arange(1, 7)})
    got = pa.concat_tables([mixlm.answers(facts, asked.filter(pa.compute.equal(asked["part"], p))) for p in range(n_parts)])
    d = predicted = 0
    for block, (h, off, trains, keys) in enumerate(laid):
        own = np.unique(h)
        counts, known = mixlm.answered(got.filter(pa.compute.equal(got["block"], block)), len(own), keys, n_parts)
        assert counts.tolist() == [words.tolist().index(x) + 1 for x in own.tolist()]
        guess, run = mixlm.matched(h, off, trains, known)
        for r in range(len(trains)):
            for k in range(off[r], off[r + 1]):
                others = after[tuple(h[k - 3 : k])] if k - off[r] >= 3 else {}
                mine = others.get(d)
                want = -1 if len(others) <= trains[r] else max(others.values()) if min(others.values()) == mine else min(others.values())
                assert guess[k] == want and run[k] == 0
                predicted += want >= 0
            d += 1
    assert predicted > 100


def test_lm_large_arrays_are_not_hashed_value_by_value(monkeypatch):
    """Words and anchors are made distinct by sorting; sums of pieces, byte tables and counted slots are those of plain loops."""
    unique = np.unique

    def watched(x, **more):
        assert more, "np.unique without counts hashes every value"
        return unique(x, **more)

    rng = np.random.default_rng(5)
    h = bytesets.mix64(rng.integers(0, 300, 1000).astype(np.uint64))
    with monkeypatch.context() as m:
        m.setattr(np, "unique", watched)
        assert mixlm.asked_words([h[:600], h[600:]], np.sort(h[:1])).tolist() == sorted({*h.tolist()} - {int(h[0])})
        assert mixlm.distinct(h[:0]).tolist() == [] and mixlm.distinct(h[[3, 3]]).tolist() == [h[3]]
    a = rng.integers(0, 256, 500).astype(np.uint8)
    assert bytesets.lowered(a).tolist() == list(bytes(a).lower()) and bytesets.lowered(a[:0]).tolist() == []
    assert bytesets.word_starts(np.arange(256, dtype=np.uint8), np.array([0, 256]))[0].tolist() == [x not in b" \t\n\x0b\x0c\r" for x in range(256)]
    for starts in ([0], [0, 1, 7, 499], [3, 4, 250]):
        ends = [*starts[1:], 500]
        assert bytesets.piece_sums(a > 99, np.array(starts)).tolist() == [int((a[s:e] > 99).sum()) for s, e in zip(starts, ends)]
        big = a.astype(np.uint64) << np.uint64(56)
        assert bytesets.piece_sums(big, np.array(starts)).tolist() == [sum(big[s:e].tolist()) % 2**64 for s, e in zip(starts, ends)]
    bucket = mixlm.buckets(h)
    assert (mixlm.counted(h, bucket) == (mixlm.slots(h, bucket) * 2 + mixlm._BIT[:, bucket].reshape(mixlm.GROUPS, mixlm.NIBBLE, -1)).ravel()).all()


def test_lm_counts_base_and_normal_scores(spark, odd, nothing):
    df, texts = odd
    got = mixlm.score_corpus(df).collect()
    assert len(got) == len(texts)
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    c = collections.Counter()
    for i, t in texts:
        if not mixlm.held_out(i):
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    want = collections.Counter((i, len(tokens(t)), sum(w in c for w in tokens(t)), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in texts)
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 and r["held_out"] == mixlm.held_out(r["doc_id"]) and r["spelled_score"] <= r["score"] + 1e-9 for r in got)
    assert mixlm.score_corpus(nothing).count() == 0


def test_lm_bucket_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    counts = rng.integers(1, 50, mixlm.NODES)
    alls = rng.integers(0, 60, (mixlm.CONTEXTS, 1 << mixlm.TABLE_BITS))
    first = bytesets.mix64(np.arange(1, 9, dtype=np.uint64))
    model = mixlm.Model(int(counts.sum()), 100, 5, counts, (np.sort(first), np.ones(8)), (alls * rng.random(alls.shape)).astype(int), alls, np.ones((256, 256)), np.ones(75), np.ones(8))
    for guess in (-1, 1234):
        total = 0.0
        for b in range(mixlm.NODES):
            h = np.concatenate([first, [np.uint64(b) << np.uint64(64 - mixlm.BITS)]]).astype(np.uint64)
            total += 10 ** mixlm.mixed_bits(model, h, np.array([0, 9]), np.zeros(9, np.int64), np.ones(9, bool), np.array([-1] * 8 + [guess]), np.full(9, 3))[-1]
        assert abs(total - 1) < 1e-4


def test_lm_learns_from_the_first_token(monkeypatch):
    rng = np.random.default_rng(5)
    h = np.unique(rng.integers(1, 1 << 63, 40, dtype=np.uint64))
    text = h[rng.integers(0, len(h), 100)]
    off, row = np.array([0, 100]), np.zeros(100, np.int64)
    other = text.copy()
    other[[10, 30]] = h[0], h[1]
    same = [a[0][12] == b[0][12] for a, b in zip(mixlm.contexts(text, off, h), mixlm.contexts(other, off, h))]
    assert same == [True, False, False] and mixlm.BITS >= 12
    assert mixlm.steps(np.arange(200)).tolist() == [0, 1, 2, 2, 3, 3, 3, 3, *[4] * 8, *[5] * 16, *[6] * 32, *[7] * 64, *[8] * 64, *[9] * 8]
    alls = rng.integers(0, 60, (mixlm.CONTEXTS, 1 << mixlm.TABLE_BITS))
    model = mixlm.Model(1000, 100, 5, np.ones(mixlm.NODES, np.int64), (h, np.ones(len(h))), alls // 3, alls, np.ones((256, 256)), np.ones(75), np.ones(8))
    run = lambda: mixlm.mixed_bits(model, text, off, row, np.ones(100, bool), np.full(100, -1), np.zeros(100, int))
    learnt = run()
    monkeypatch.setattr(mixlm, "LEARN", 0.0)
    rest = run()
    assert learnt[0] == rest[0] and (learnt[1:4] != rest[1:4]).any() and (learnt[4:64] != rest[4:64]).sum() > 30


def test_lm_beats_the_base_on_held_out_texts(spark):
    from gossamer.session import table

    got = mixlm.op3_query(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert got[2] > 50 and got[0] > got[1] and table(spark, "/root/testdata/sf0.01", "documents").count() == 1000


# -- 4: quality -----------------------------------------------------------------------------------


def test_quality_held_out_accuracy(spark):
    from gossamer.session import table

    sf = "/root/testdata/sf0.01"
    got = quality.op4_query(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    assert len(got) > 40 and sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.95


def test_quality_odd_rows(spark, odd, nothing):
    df, texts = odd
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 16)] + [(None, 1, 0), (3, None, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    stats = quality.features(df)
    model = quality.fit_quality(stats, labels)
    got = quality.score_documents(df, model, score_col="_s").collect()
    assert len(got) == len(texts) and all(0 <= r["_s"] <= 1 for r in got) and got[0]["score"] == 0.5
    none = quality.fit_quality(stats, labels.where("quality = 5"))
    assert none.score(np.zeros((2, quality.N_STATS))).tolist() == [0.5, 0.5]
    assert quality.score_documents(nothing, model, score_col="_s").count() == 0


def test_several_labels_of_one_id_count_with_their_mean(spark, odd):
    df, _ = odd
    stats = quality.features(df)
    a = [(i, i % 2, 0) for i in range(1, 16)] + [(2, 1, 0)]
    one, two = (quality.fit_quality(stats, spark.createDataFrame(x, "doc_id long, quality int, toxic int").repartition(n)) for x, n in ((a, 1), (a[::-1], 3)))
    assert (one.leaf == two.leaf).all() and one.base == two.base
    with pytest.raises(ValueError):
        quality.score_documents(df, one)


def test_trees_fit_and_flat_traversal_matches_a_walk():
    rng = np.random.default_rng(0)
    x = rng.random((800, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    m = quality.fit(x, y, 40, 3)
    assert ((m.score(x) > 0.5) == y).mean() > 0.97
    for r in x[:20]:
        raw = m.base
        for f, t, leaf in zip(m.feature, m.threshold, m.leaf):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + int(r[f[at]] > t[at])
            raw += leaf[at - len(f)]
        assert abs(1 / (1 + math.exp(-raw)) - m.score(r[None])[0]) < 1e-12


# -- 8: decontamination ---------------------------------------------------------------------------


def edit_distance_in(piece: bytes, text: bytes) -> int:
    row = [0] * (len(text) + 1)
    for i, c in enumerate(piece):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_every_verbatim_quote_of_a_piece_is_found():
    rng = random.Random(8)
    item = "".join(rng.choice("abcdefghij") for _ in range(240))
    index = decontaminate.Index([(7, item), (8, item[:140])])
    pad = "".join(rng.choice("klmnopq") for _ in range(200))
    assert [i for i, *_ in decontaminate.find_items(pad + item[20:120] + pad, index)] == [7, 8]
    for at in range(0, 240 - decontaminate.PIECE + 1):
        assert decontaminate.find_items(pad + item[at : at + decontaminate.PIECE] + pad, index)
    assert decontaminate.find_items(pad + item[20:80] + pad, index) == []


def test_contamination_matches_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 8, 25, 40])))) for i in range(12)]
    texts = []
    for k in range(40):
        body = list(" ".join(word() for _ in range(30)))
        if k % 2:
            _, it = items[k % 12]
            cut = list(it.upper() if k % 3 else it)
            for _ in range(rng.choice([0, 2, 6, 14])):
                p = rng.randrange(len(cut))
                cut[p : p + 1] = rng.choice([[], ["z"], [cut[p], "q"]])
            body[50:50] = [" ", *cut, " "]
        texts.append((k, "".join(body)))
    texts += [(100, None), (101, ""), (None, items[5][1])]
    items += [(30 + n, "".join(rng.choice("abcdefghij") for _ in range(n))) for n in (8, 10, 13, 19, 20, 21, 27, 30, 39, 40, 47)]
    for k, (_, it) in enumerate(items[12:]):
        for edits in range(3):
            cut = list(it)
            for _ in range(edits):
                cut[rng.randrange(len(cut))] = rng.choice("klmno")
            texts.append((200 + 3 * k + edits, "zz " * 9 + "".join(cut) + " zz" * 5))
    index = decontaminate.Index(items)
    for _, t in texts:
        raw = decontaminate.normalise(t)
        want = set()
        for (i, _), item in zip(items, (decontaminate.normalise(x) for _, x in items)):
            if any(edit_distance_in(item[s:e], raw) <= decontaminate.budget(e - s) for s, e in decontaminate.pieces(item)):
                want.add(i)
        assert {h[0] for h in decontaminate.find_items(t, index)} == want
    df = spark.createDataFrame(rows_of(texts), DOCS)
    bench = spark.createDataFrame([*items, (50, None), (None, "x" * 100), (51, "tiny")], "item_id long, text string")
    assert [(i, e) for i, _, e in decontaminate.find_items("... the quiek brawn foxes ...", decontaminate.Index([(1, "the quick brown foxes")]))] == [(1, 2)]
    one = decontaminate.find_contamination(df, bench).select("doc_id", "hits.item_id").collect()
    many = decontaminate.find_contamination(df, bench, slice_items=3).select("doc_id", "hits.item_id").collect()
    key = lambda rows: collections.Counter((r[0], tuple(sorted(r[1]))) for r in rows)
    assert key(one) == key(many) and len(one) == len(texts)
    assert decontaminate.find_contamination(df.limit(0), bench).count() == 0 and decontaminate.find_contamination(df, bench.limit(0)).where(F.size("hits") > 0).count() == 0


def test_repeated_letters_are_no_quadratic_case():
    import time

    items = [(i, "a" * (60 + i)) for i in range(60)]
    index = decontaminate.Index(items)
    began = time.time()
    assert len(decontaminate.find_items("a" * 2000, index)) == 60
    assert time.time() - began < 0.5


@pytest.mark.parametrize("n, size, seconds", [(60, 2048, 0.6), (60, 8192, 1.0), (600, 2048, 3.0)])
def test_nearly_repeated_letters_are_no_quadratic_case(n, size, seconds):
    """One other letter in each item, so that none is there exactly; all are within their budget."""
    import time

    items = [(k, "".join("a" if i != 7 + k % 50 else "bcdefgh"[k % 7] for i in range(60 + k % 37))) for k in range(n)]
    index = decontaminate.Index(items)
    text = "a" * (size // 2) + "b" + "a" * 300 + "cc" + "a" * (size // 2 - 303)
    for t in ("a" * size, text):
        began = time.time()
        got = decontaminate.find_items(t, index)
        assert time.time() - began < seconds
        assert len(got) == n
        if size == 2048 and n == 60:
            raws = {k: decontaminate.normalise(x) for k, x in items}
            for k, _, edits in got[::6]:
                assert edits == min(edit_distance_in(raws[k][s:e], t.encode()) for s, e in decontaminate.pieces(raws[k]))


def test_both_ways_of_counting_find_the_same_regions():
    rng = random.Random(8)
    for _ in range(60):
        items = [(k, "".join(rng.choice("ab" if rng.random() < 0.9 else "abc") for _ in range(rng.randint(45, 200)))) for k in range(4)]
        grams = decontaminate.Grams([(k, decontaminate.normalise(t)) for k, t in items], 8)
        text = "".join(rng.choice("ab") for _ in range(300)) + items[0][1][:120] + "".join(rng.choice("ab") for _ in range(100))
        g = decontaminate.grams(text.encode())
        at = np.searchsorted(grams.values, g)
        at[at == len(grams.values)] = 0
        pos = np.nonzero(grams.values[at] == g)[0]
        at = at[pos]
        pairs = decontaminate.by_pairs(pos, at, grams, np.ones(4, bool))
        place = grams.places(np.unique(at))
        value = np.repeat(np.unique(at), grams.count[np.unique(at)])
        of_value = {int(v): pos[at == v] for v in np.unique(at)}
        sums = [r for k in range(4) for r in decontaminate.by_diagonals(k, grams.at[place][grams.item[place] == k], value[grams.item[place] == k], of_value, grams, len(g))]
        assert sorted(pairs) == sorted(sums)


def test_contamination_takes_any_columns_and_repeated_rows(spark):
    df = spark.createDataFrame([("x" * 3, "the benchmark passage number one is here", 1, 2), ("y", None, 1, 2), ("y", None, 1, 2), ("z", "w" * 200_000 + " the benchmark passage number one is here", 3, 4)], "`a.b` string, text string, hits int, _hits_0 int")
    bench = spark.createDataFrame([(5, "benchmark passage number one"), (5, "benchmark passage number one")], "item_id long, text string")
    got = decontaminate.find_contamination(df, bench)
    assert got.columns == ["a.b", "text", "_hits_0", "hits"]
    assert sorted((r[0], r[2], [h["item_id"] for h in r["hits"]]) for r in got.collect()) == [("xxx", 2, [5]), ("y", 2, []), ("y", 2, []), ("z", 4, [5])]


# -- 2: mixing ------------------------------------------------------------------------------------


def test_raking_meets_its_marginals(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, f"s{rng.choice([0, 0, 0, 1, 2])}", rng.choice(["en", "fr", None]), rng.choice("ab"), rng.randint(1, 50)) for i in range(3000)], "doc_id long, source string, lang string, topic string, n_tokens long")
    cells = docs.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").cast("double").alias("tokens"))
    out = mixing.rake(cells, mixing.EXPONENTS).toPandas()
    tokens = cells.toPandas()
    for d, x in mixing.EXPONENTS.items():
        have = out.groupby(d, dropna=False).weight.sum()
        share = (tokens.groupby(d, dropna=False).tokens.sum() / tokens.tokens.sum()) ** x
        assert np.allclose(have, share / share.sum(), atol=1e-4)
    mixed = mixing.mix(docs)
    got = mixed.agg(F.sum("n_tokens"), F.sum(F.expr("n_tokens * rate")), F.sum(F.expr("if(kept, n_tokens, 0)")), F.max("rate")).first()
    assert abs(got[1] / got[0] - mixing.BUDGET) < 1e-6 and abs(got[2] / got[0] - mixing.BUDGET) < 0.05 and got[3] <= 1


def test_marginals_tell_what_a_sample_misses(spark):
    docs = spark.createDataFrame([(1, "a", "x", "p", 900), (2, "b", "x", "p", 50), (3, "b", "y", "p", 50)], "doc_id long, source string, lang string, topic string, n_tokens long")
    got = {(r["dimension"], r["value"]): r for r in mixing.marginals(docs).collect()}
    a, b = 0.9**0.5, 0.1**0.5
    assert abs(got["source", "b"]["target"] - b / (a + b)) < 1e-6
    # both cells of b are taken whole and a fills the budget
    assert got["source", "b"]["whole"] == got["source", "b"]["cells"] == 2 and got["source", "a"]["whole"] == 0
    assert abs(got["source", "b"]["reached"] - 100 / 800) < 1e-9 and abs(got["source", "b"]["observed"] - 0.1) < 1e-9
    low = {(r["dimension"], r["value"]): r for r in mixing.marginals(docs, budget=0.2).collect()}
    assert all(abs(r["reached"] - r["target"]) < 1e-6 for r in low.values() if r["dimension"] == "source")


def test_raking_meets_given_targets(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, f"s{rng.choice([0, 0, 0, 1, 2])}", rng.choice(["en", "fr"]), rng.choice("ab"), rng.randint(1, 50)) for i in range(2000)], "doc_id long, source string, lang string, topic string, n_tokens long")
    targets = {"source": {"s0": 0.2, "s1": 0.2, "s2": 0.4, "gone": 9.0}, "lang": {"en": 3.0, "fr": 1.0}}
    got = {(r["dimension"], r["value"]): r for r in mixing.marginals(docs, budget=0.2, targets=targets).collect()}
    assert all(abs(got["source", s]["target"] - w) < 1e-6 for s, w in (("s0", 0.25), ("s1", 0.25), ("s2", 0.5)))
    assert abs(got["lang", "en"]["target"] - 0.75) < 1e-6 and all(abs(r["residual"] - r["target"] + r["reached"]) < 1e-12 for r in got.values())
    assert mixing.mix(docs, budget=0.2, targets=targets).count() == 2000


def test_mixing_odd_rows(spark, odd, nothing):
    df, texts = odd
    rows = df.withColumn("topic", F.lit(None).cast("string")).withColumn("source", F.when(F.col("doc_id") > 3, F.col("source"))).withColumn("n_tokens", mixing.n_words(F.col("text")))
    got = mixing.mix(rows).collect()
    assert len(got) == len(texts) and all(0 <= r["rate"] <= 1 for r in got)
    assert mixing.mix(nothing.withColumn("topic", F.lit("a"))).count() == 0


# -- 5: lossless WebP -----------------------------------------------------------------------------


@pytest.mark.parametrize("transforms", [(), (2,), (0,), (1,), (3,), (2, 0), (0, 1, 2), (1, 0), (3, 0)])
def test_webp_round_trip(transforms):
    r = np.random.default_rng(7)
    for mode in range(-1, 14) if 0 in transforms else [11]:
        for cache in (0, 1, 6, 11):
            h, w = int(r.integers(1, 30)), int(r.integers(1, 40))
            colours = r.integers(0, 2**32, int(r.choice([1, 2, 3, 5, 17, 200])))
            a = colours[r.integers(0, len(colours), (h, w))] if 3 in transforms or mode % 2 else r.integers(0, 2**32, (h, w))
            a = np.repeat(a, 3, 1)[:, :w]
            raw = webp.riff([(webp.encode_frame(a, cache, transforms, mode, block_bits=int(r.integers(2, 5))), w, h)])
            assert (webp.decode_files([raw])[0][0] == a).all()


def test_webp_back_references_and_meta_codes():
    """A frame written bit by bit: two groups of codes, copies by neighbour and by distance."""
    w = webp.Writer()
    for v, n in ((0x2F, 8), (15, 14), (3, 14), (1, 1), (0, 3), (0, 1), (0, 1), (1, 1), (0, 3)):
        w.put(v, n)
    webp.write_image(w, np.array([0, 1 << 8, 0, 1 << 8]), 0, False)  # groups 0, 1, 0, 1 of 4 x 4 blocks
    lengths = np.zeros(280, np.int64)
    lengths[[7, 256 + 4]] = 1  # literal 7, or a copy of length 5 and one extra bit
    one = lambda s, n: np.eye(n, dtype=np.int64)[s]
    for green in (lengths, one(9, 280)):
        for x in (green, one(1, 256), one(2, 256), one(255, 256), one(1, 40)):
            webp.write_code(w, x)
    code = webp.canonical(lengths)
    out = []
    while len(out) < 64:
        x = len(out) % 16
        if (x >> 2) & 1:
            out.append(255 << 24 | 1 << 16 | 9 << 8 | 2)
        elif len(out) >= 16 and x == 0:
            w.put(int(code[260]), 1)
            w.put(1, 1)
            for _ in range(6):
                out.append(out[-1])
        else:
            w.put(int(code[7]), 1)
            out.append(255 << 24 | 1 << 16 | 7 << 8 | 2)
    raw = webp.riff([(w.done() + b"\0\0", 16, 4)])
    assert webp.decode_files([raw, raw])[1][0].ravel().tolist() == out


def test_webp_copies_match_a_plain_decoder():
    src = np.array([1, 2, 3, 4] * 8)
    w = webp.Writer()
    for v, n in ((0x2F, 8), (7, 14), (3, 14), (1, 1), (0, 3), (0, 1), (0, 1), (0, 1)):
        w.put(v, n)
    green = np.zeros(280, np.int64)
    for s, n in ((1, 3), (2, 3), (3, 3), (4, 3), (256 + 9, 1)):
        green[s] = n  # 9: lengths 25 to 32
    dist = np.zeros(40, np.int64)
    dist[13] = 1  # codes 97 to 128; 124 is a distance of 4
    for x in (green, *[np.eye(256, dtype=np.int64)[0]] * 3, dist):
        webp.write_code(w, x)
    codes = webp.canonical(green)
    for v in (1, 2, 3, 4):
        w.put(int(codes[v]), 3)
    w.put(int(codes[265]), 1)
    w.put(28 - 25, 3)
    w.put(124 - 97, 5)
    raw = webp.riff([(w.done() + b"\0\0", 8, 4)])
    assert ((webp.decode_files([raw])[0][0].ravel() >> 8) & 255).tolist() == src.tolist()


def webp_texts():
    """Texts for which another step of the method is the shortest."""
    r = np.random.default_rng(11)
    text = lambda planes: np.stack(planes, 1).astype(np.uint8).tobytes().decode("ascii")
    g = r.integers(1, 127, 1600)
    walk = lambda: 60 + np.abs(np.cumsum(r.integers(-1, 2, 1600)) % 100 - 50)
    quote = "".join(r.choice(list("abcdefghijklmnop"), 400))
    return {
        "green": text([np.full(1600, 65), g, g, g]),
        "cross": text([np.full(1600, 65), g >> 1, g, g >> 2]),
        "predictor": text([walk() for _ in range(4)]),
        "palette": "".join(r.choice(["abcd", "Zq9!", "#~05", "k(X}", "@W;2"], 40)),
        "split": "".join(r.choice(list("ABCDEFGH"), 4000)) + "".join(r.choice(list("01234567"), 4000)),
        "copies": quote + "".join(r.choice(list("0123456789"), 400)) + quote,
        "own": "".join(r.choice(list("{}[]^~"), 3000)),
        "text": "the same old story is told in other words",
    }


def test_webp_query_files_use_every_step(spark):
    texts = webp_texts()
    got = webp.media_features(spark.createDataFrame([(i, t) for i, t in enumerate(texts.values())], "doc_id bigint, text string"), keep_media=True).collect()
    used, plain = {}, webp.text_codes()
    for name, r in zip(texts, sorted(got, key=lambda r: r["doc_id"])):
        raw = texts[name].encode()
        payload = raw + bytes(-len(raw) % 64)
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["n_bytes"] == len(raw)
        frames = [webp.Frame(x) for x in webp.frames_of(bytes(r["media"]))]
        used[name] = {t[0] for f in frames for t in f.transforms}
        f, px = frames[0], np.frombuffer(payload, ">u4").astype(np.int64)[: webp.FRAME_PIXELS]
        own = not all((a == b).all() for a, b in zip(f.image.groups[0], plain.lengths) if len(a) == len(b))
        assert own == (name != "text")
        assert (f.image.meta is not None) == (name == "split")
        if name == "copies":
            _, kind, length, distance = webp.plan_symbols(px, webp.CACHE_BITS)
            assert 100 in length[kind == 2] and 200 in distance[kind == 2]
            far = webp.prefix_code(webp.distance_codes(np.array([200]), webp.ROW_PIXELS))[0][0]
            assert f.image.groups[0][4][far] > 0  # a code by counts has the symbols that occur
        if own:
            before = webp.repeats(px, np.zeros(len(px), np.int64))
            assert len(webp.frames_of(bytes(r["media"]))[0]) < len(webp.encode_way(px, before, "text"))
    steps = {"green": webp.SUBTRACT_GREEN, "cross": webp.CROSS_COLOUR, "predictor": webp.PREDICTOR, "palette": webp.PALETTE}
    del used["copies"]  # copies go with any transform
    assert used == {name: {steps[name]} if name in steps else set() for name in used}


def test_webp_joined_bits():
    r = np.random.default_rng(2)
    n = r.integers(0, 61, 300)
    v = np.array([int(r.integers(0, 1 << 60)) & ((1 << int(k)) - 1) for k in n])
    whole = at = 0
    for x, k in zip(v.tolist(), n.tolist()):
        whole |= x << at
        at += k
    assert webp.joined([v[:7], v[7:]], [n[:7], n[7:]]) == whole.to_bytes((at + 7) // 8, "little")


def test_webp_rejects_damage():
    for n in (0, 1, 63, 64, 65, 127, 128, 129):
        assert len(webp.payload_of("x" * n)[0]) == {0: 64, 1: 64, 63: 64, 64: 64, 65: 128, 127: 128, 128: 128, 129: 192}[n]
    good = webp.encode_payloads([webp.payload_of("hello " * 50)[0]])[0]
    for bad in (b"RIFF", good[:40], good.replace(b"WEBP", b"WAVE")):
        with pytest.raises((ValueError, IndexError)):
            if not webp.decode_files([bad])[0]:
                raise ValueError("no frame")


def test_media_round_trip(spark, odd, nothing):
    df, texts = odd
    got = webp.media_features(df, keep_media=True).collect()
    assert len(got) == len(texts)
    by = collections.defaultdict(set)
    for r in got:
        by[r["payload_sha256"]].add((r["media_sha256"], r["feature"], r["tail_crc32"], r["media_bytes"]))
        assert r["payload_bytes"] % 64 == 0 and r["payload_bytes"] > r["n_bytes"] - 1 and hashlib.sha256(bytes(r["media"])).hexdigest() == r["media_sha256"]
    assert all(len(v) == 1 for v in by.values())
    # by hand: zeros up to the least of 64, 128, ... that is no less than the text
    size = lambda n: next(k for k in range(64, n + 128, 64) if k >= n)
    want = collections.Counter(hashlib.sha256((t or "").encode().ljust(size(len((t or "").encode())), b"\0")).hexdigest() for _, t in texts)
    assert collections.Counter(r["payload_sha256"] for r in got) == want
    assert webp.media_features(nothing).count() == 0


def test_webp_files_are_planned_across_arrow_batches(monkeypatch):
    """Small Arrow batches are joined up to the bounds; ids and texts stay together and in order."""
    texts = ["a" * (i % 7 * 30) for i in range(50)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 5)), pa.array(texts[i : i + 5], pa.string())], ["doc_id", "text"]) for i in range(0, 50, 5)]
    whole = list(webp.payload_batches(iter(batches)))
    assert len(whole) == 1 and whole[0][0].to_pylist() == list(range(50)) and whole[0][1] == [webp.payload_of(t) for t in texts]
    monkeypatch.setattr(webp, "BATCH_FILES", 7)
    assert [len(todo) for _, todo in webp.payload_batches(iter(batches))] == [7] * 7 + [1]
    monkeypatch.setattr(webp, "BATCH_BYTES", 300)
    parts = list(webp.payload_batches(iter(batches)))
    assert [i for ids, _ in parts for i in ids.to_pylist()] == list(range(50)) and [t for _, todo in parts for t in todo] == [webp.payload_of(t) for t in texts]
    assert all(sum(len(p) for p, _ in todo[:-1]) < 300 for _, todo in parts) and not list(webp.payload_batches(iter([])))


def test_webp_tables_and_codes_are_those_of_plain_rules():
    """Prefix codes from a table, bytes that wrap around, runs that are written once, and shortest codes."""
    v = np.array([1, 2, 4, 5, 6, 99, 4096, 8191])
    far = [x.tolist() for x in webp.prefix_code(np.append(v, 1 << 20))]
    assert [x.tolist() for x in webp.prefix_code(v)] == [x[:-1] for x in far]
    for value, code, extra, n in zip([*v.tolist(), 1 << 20], *far):
        assert value == (code + 1 if code < 4 else ((2 + (code & 1)) << n) + extra + 1)
    assert [p.tolist() for p in webp.byte_planes(np.array([0x01020304, 0xFF000000], "<u4"))] == [[1, 255], [2, 0], [3, 0], [4, 0]]
    for run in range(1, 300):
        for value in (0, 9):
            out = []
            for x in webp.run_symbols(value, run):
                s, more = x & 31, x >> 5 & 127
                out += [out[-1]] * (3 + more) if s == 16 else [0] * (3 + more) if s == 17 else [0] * (11 + more) if s == 18 else [s]
            assert out == [value] * run
    rng = np.random.default_rng(8)
    for n in (2, 3, 40, 280):
        counts = rng.integers(0, 50, n) ** 2 + 1
        heap, bits = counts.tolist(), 0
        while len(heap) > 1:
            heap.sort()
            heap = [heap[0] + heap[1], *heap[2:]]
            bits += heap[0]
        assert int((counts * webp.code_lengths(counts, 40)).sum()) == bits
