"""Weighted PageRank and HITS.

Up to LOCAL_EDGES edges (a checked count) the iterations run as array operations in one task;
beyond it each iteration is one join and one aggregation over edges that stay partitioned by source.
Both ways stop after the same round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from gossamer.session import BROADCAST_ROWS, materialize, side, spread

LOCAL_EDGES = 5_000_000
DAMPING, TOLERANCE, ROUNDS, HITS_ROUNDS = 0.85, 1e-5, 40, 20


def rank_eligible(noindex: Column, collapsed: Column, soft404: Column, canonical: Column, url: Column, status: Column) -> Column:
    """Pages that take part in PageRank."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    return ~ok(noindex) & ~ok(collapsed) & ~ok(soft404 > 0.8) & ~ok(canonical != url) & (status < 400) & (status != 0)


def hits_eligible(status: Column, redirected: Column, noindex: Column) -> Column:
    return status.isin(200, 0) & ~F.coalesce(redirected, F.lit(False)) & ~F.coalesce(noindex, F.lit(False))


def _inner(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ids = nodes.select(F.col("id").alias("_n"))
    w = F.when(F.coalesce("weight", F.lit(0.0)) > 0, F.col("weight")).otherwise(F.lit(1.0))
    ids = side(ids)
    return edges.join(ids, edges["src"] == ids["_n"], "left_semi").join(ids, F.col("dst") == ids["_n"], "left_semi").select("src", "dst", w.alias("weight"))


def _local(nodes: DataFrame, edges: DataFrame, run, schema: str) -> DataFrame:
    """Run ``run(ids, src, dst, weight)`` over dense places in one task of a checked size."""
    kind = nodes.schema["id"].dataType.simpleString()
    both = edges.unionByName(nodes.select(F.col("id").alias("src"), F.lit(None).cast(kind).alias("dst"), F.lit(None).cast("double").alias("weight")))

    def task(batches):
        parts = list(batches)
        if not parts:
            return
        df = pd.concat(parts)
        lone = df["weight"].isna()
        ids = np.sort(df.loc[lone, "src"].unique())
        e = df[~lone]
        if len(ids):
            yield run(ids, np.searchsorted(ids, e["src"].to_numpy(ids.dtype)), np.searchsorted(ids, e["dst"].to_numpy(ids.dtype)), e["weight"].to_numpy(float))

    return both.repartition(1).mapInPandas(task, f"id {kind}, {schema}")


def scaled(rank: Column, lo: Column, hi: Column, digits: int = 3) -> Column:
    """0 to 100 between the extremes; 50 where all ranks are the same."""
    g = float(10**digits)
    return F.when(hi - lo <= 1e-12, F.lit(50.0)).otherwise(F.floor(100 * (rank - lo) / (hi - lo) * g + 0.5) / g)


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS, tol: float = TOLERANCE, damping: float = DAMPING, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, rank, score): weighted ranks that sum to 1 (sinks spread evenly) and scores 0 to 100.

    ``nodes`` holds the eligible ids; edges elsewhere are ignored, self-loops count, weights that
    are null or not positive count as 1.
    """
    inner = _inner(nodes, edges).persist(StorageLevel.MEMORY_AND_DISK)
    if inner.count() <= local_edges:

        def run(ids, src, dst, w):
            n = len(ids)
            out = np.bincount(src, w, n)
            share = w / out[src]
            sink = out == 0
            r = np.full(n, 1.0 / n)
            for _ in range(rounds):
                new = (1 - damping) / n + damping * (np.bincount(dst, r[src] * share, n) + r[sink].sum() / n)
                moved = np.abs(new - r).max()
                r = new
                if moved < tol:
                    break
            return pd.DataFrame({"id": ids, "rank": r})

        ranks = materialize(_local(nodes, inner, run, "rank double"), "pagerank")
    else:
        n = nodes.count()
        total = inner.groupBy("src").agg(F.sum("weight").alias("total"))
        flow = inner.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")).repartition("src").persist(StorageLevel.MEMORY_AND_DISK)
        ranks = nodes.select("id").withColumn("rank", F.lit(1.0 / max(n, 1)))
        for _ in range(rounds):
            sent = flow.join(ranks.withColumnRenamed("id", "src"), "src").groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
            new = materialize(nodes.select("id").join(sent.withColumnRenamed("dst", "id"), "id", "left").join(ranks, "id").select("id", F.coalesce("got", F.lit(0.0)).alias("got"), F.col("rank").alias("old")), "pagerank")
            # what did not arrive was held by sinks
            lost = 1.0 - (new.agg(F.sum("got")).first()[0] or 0.0)
            ranks = new.select("id", (F.lit((1 - damping) / n) + damping * (F.col("got") + lost / n)).alias("rank"), "old")
            if tol > 0 and ranks.agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0] < tol:
                break
            ranks = ranks.drop("old")
        ranks = materialize(ranks.select("id", "rank"), "pagerank")
        flow.unpersist()
    inner.unpersist()
    return scale_column(ranks, "rank").select("id", "rank", "score")


def upper_median(df: DataFrame, column: str, *ties: str, whole: int = 1_000_000) -> float | None:
    """The value at place n // 2 of n in rising order; null of an empty table.

    Beyond ``whole`` rows only the values between two approximate quantiles around it are brought together."""
    some = df.where(F.col(column).isNotNull())
    n = some.count()
    k = n // 2
    if n > whole:
        lo, hi = some.agg(F.percentile_approx(column, [0.499, 0.501], 10_000)).first()[0]
        below = some.where(F.col(column) < lo).count()
        for value, count in some.where(F.col(column).between(lo, hi)).groupBy(column).count().orderBy(column).collect() if below <= k else ():
            below += count
            if k < below:
                return value
    got = some.orderBy(column, *ties).offset(k).limit(1).select(column).collect() if n else []
    return got[0][0] if got else None


def scale_column(df: DataFrame, column: str, out: str = "score", digits: int = 3) -> DataFrame:
    """Adds ``out``: the column from 0 to 100 between its extremes."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    return df.crossJoin(F.broadcast(ends)).withColumn(out, scaled(F.col(column), F.col("_lo"), F.col("_hi"), digits)).drop("_lo", "_hi")  # one row


def hits(nodes: DataFrame, edges: DataFrame, rounds: int = HITS_ROUNDS, local_edges: int = LOCAL_EDGES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(id, auth, hub, role): unit-norm scores after fixed rounds, self-loops left out.

    A score is high above its upper median or at its maximum (and above 1e-5); both high is power,
    one high authority or hub, else balanced (both above 1e-5) or peripheral.
    """
    inner = _inner(nodes, edges).where("src <> dst")
    inner = materialize(inner, "hits-edges")
    if inner.count() <= local_edges:

        def run(ids, src, dst, w):
            n = len(ids)
            a, h = np.ones(n), np.ones(n)
            unit = lambda v: v / (np.sqrt((v * v).sum()) or 1.0)
            for _ in range(rounds):
                a = unit(np.bincount(dst, h[src] * w, n))
                h = unit(np.bincount(src, a[dst] * w, n))
            return pd.DataFrame({"id": ids, "auth": a, "hub": h})

        out = materialize(_local(nodes, inner, run, "auth double, hub double"), "hits")
    else:
        # edges are dealt once by either end: a round moves scores to where their sums are, or, of too many nodes, partial sums
        by = {end: spread(inner, end).persist(StorageLevel.MEMORY_AND_DISK) for end in ("src", "dst")}
        small = nodes.count() <= broadcast_rows

        def step(score: DataFrame, norm: float, near: str, far: str) -> tuple[DataFrame, float]:
            """Scores over the edges from ``near`` to ``far`` and their norm; nodes without any are left out."""
            at = by[far] if small else by[near]
            score = F.broadcast(score) if small else score.hint("shuffle_hash")
            got = at.join(score.withColumnRenamed("id", near), near).groupBy(F.col(far).alias("id")).agg(F.sum(F.col("score") / F.lit(norm) * F.col("weight")).alias("score"))
            got = materialize(got, "hits")
            return got, got.agg(F.sqrt(F.sum(F.col("score") * F.col("score")))).first()[0] or 1.0

        hub, hub_norm = nodes.select("id", F.lit(1.0).alias("score")), 1.0
        for _ in range(rounds):
            auth, auth_norm = step(hub, hub_norm, "src", "dst")
            hub, hub_norm = step(auth, auth_norm, "dst", "src")
        for end in by.values():
            end.unpersist()
        unit = lambda df, norm, c: df.select("id", (F.col("score") / F.lit(norm)).alias(c)).hint("shuffle_hash")
        out = nodes.select("id").join(unit(auth, auth_norm, "auth"), "id", "left").join(unit(hub, hub_norm, "hub"), "id", "left").fillna(0.0, ["auth", "hub"])
        out = materialize(out, "hits")
    middle = {c: upper_median(out, c) or 0.0 for c in ("auth", "hub")}
    top = out.agg(F.max("auth"), F.max("hub")).first()
    high = lambda c, m, t: (F.col(c) > 1e-5) & ((F.col(c) > m) | (F.col(c) == F.lit(t)))
    a, h = high("auth", middle["auth"], top[0]), high("hub", middle["hub"], top[1])
    role = F.when(a & h, "power").when(a, "authority").when(h, "hub").when((F.col("auth") > 1e-5) & (F.col("hub") > 1e-5), "balanced").otherwise("peripheral")
    return out.select("id", "auth", "hub", role.alias("role"))
