"""64-bit FNV-1a and SimHash, bands and distances."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gossamer.session import bounded_batches, trimmed

#: Fixed values of FNV-1a with 64 bits.
FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211
_WORD = re.compile(r"[A-Za-z0-9_]+")
BANDS = 4


def fnv1a(tokens: list[str]) -> np.ndarray:
    """Hashes over UTF-16 code units, all tokens at once."""
    raw = [t.encode("utf-16-le") for t in tokens]
    n = np.array([len(r) // 2 for r in raw], np.int64)
    h = np.full(len(raw), FNV_OFFSET, np.uint64)
    if not len(raw):
        return h
    units = np.frombuffer(b"".join(raw), "<u2").astype(np.uint64)
    start = np.concatenate([[0], np.cumsum(n)[:-1]])
    order = np.argsort(-n, kind="stable")
    n, start, live = n[order], start[order], h[order]
    for i in range(int(n[0])):
        k = int(np.searchsorted(-n, -i, "left"))  # tokens longer than i come first
        live[:k] = (live[:k] ^ units[start[:k] + i]) * np.uint64(FNV_PRIME)
    h[order] = live
    return h


def simhashes(texts: list[str | None], cap: int | None = None) -> np.ndarray:
    """Signed 64 bits of each text; a bit is set if more tokens (with repeats) have it than not.

    Every distinct token of the batch is hashed once. ``cap`` cuts texts to so many characters.
    """
    found = [_WORD.findall((t or "")[:cap].lower()) for t in texts]
    sizes = np.array([len(f) for f in found], np.int64)
    out = np.zeros(len(texts), np.int64)
    some = np.nonzero(sizes)[0]
    if not len(some):
        return out
    code, names = pd.factorize(np.array([w for f in found for w in f], object))
    bits = np.unpackbits(fnv1a(names.tolist()).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int8) * 2 - 1
    start = np.cumsum(sizes[some]) - sizes[some]
    # bounded slices: votes of many tokens would not fit memory at once
    cuts = [0, *(np.nonzero(np.diff(start // 200_000))[0] + 1).tolist(), len(some)]
    for i, j in zip(cuts, cuts[1:]):
        lo, hi = start[i], start[j] if j < len(some) else len(code)
        votes = np.add.reduceat(bits[code[lo:hi]], start[i:j] - lo, axis=0, dtype=np.int64)
        out[some[i:j]] = np.packbits(votes > 0, axis=1).view(">i8").ravel()
    return out


def simhash(text: Column | str, cap: int | None = None) -> Column:
    """Arrow-batched ``simhashes`` of whole texts (or of their first ``cap`` characters)."""
    bounded_batches(SparkSession.active())

    @F.pandas_udf("bigint")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return trimmed(hashed)(batches)

    def hashed(batches):
        for t in batches:
            yield pd.Series(simhashes(t.tolist(), cap))

    return run(text)


def fnv1a_expr(token: Column) -> Column:
    """The same hash of an ASCII token without Python: two 32-bit limbs, no overflow."""
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), F.ascii)
    m = 0xFFFFFFFF
    start = F.struct(F.lit(FNV_OFFSET >> 32).cast("bigint").alias("hi"), F.lit(FNV_OFFSET & m).cast("bigint").alias("lo"))

    def step(s: Column, c: Column) -> Column:
        lo = s.lo.bitwiseXOR(c.cast("bigint"))
        p = lo * 435
        hi = (s.hi * 435 + F.shiftright(p, 32) + F.shiftleft(lo, 8)).bitwiseAND(m)
        return F.struct(hi.alias("hi"), p.bitwiseAND(m).alias("lo"))

    return F.aggregate(codes, start, step, lambda s: F.shiftleft(s.hi, 32).bitwiseOR(s.lo))


def bands(h: Column) -> Column:
    return F.array(*[F.shiftrightunsigned(h, 16 * i).bitwiseAND(0xFFFF).cast("int") for i in range(BANDS)])


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def from_decimal(text: Column) -> Column:
    """Signed 64 bits of an unsigned decimal string."""
    d = text.cast("decimal(20,0)")
    return F.when(d > F.lit("9223372036854775807").cast("decimal(20,0)"), d - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(d).cast("bigint")


def to_decimal(h: Column) -> Column:
    d = h.cast("decimal(20,0)")
    return F.when(h < 0, d + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(d).cast("decimal(20,0)").cast("string")
