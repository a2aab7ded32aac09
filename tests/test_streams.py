"""Limiters, sessions and counts: streams against batches, and state that goes away."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gossamer.streaming import limiter as L

T0 = dt.datetime(2024, 1, 1)


def requests(seed=3, n=400, keys="abc", steps=(0.0, 0.2, 1.0, 3.0, 12.0, 90.0)):
    rng, t, out = random.Random(seed), 0.0, []
    for i in range(n):
        t += rng.choice(steps)
        out.append((i, rng.choice(keys), T0 + dt.timedelta(seconds=round(t, 3)), rng.choice([0.0, 0.0, 2.5])))
    return out


COLUMNS = "id long, key string, ts timestamp, delay double"


def streamed(spark, tmp_path, rows, twin, parts=5):
    """The rows as so many files, one a batch."""
    src = tmp_path / "in"
    src.mkdir()
    step = -(-len(rows) // parts)
    for k in range(parts):
        pdf = pd.DataFrame(rows[k * step : (k + 1) * step], columns=["id", "key", "ts", "delay"]).astype({"ts": "datetime64[us]"})
        pdf.to_parquet(src / f"{k}.parquet")
    name = f"t{abs(hash(str(tmp_path)))}"
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = twin(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name), q


LIMITERS = {
    "rate_limit": (lambda df: L.rate_limit(df, limit=2, window_s=5), lambda df: L.rate_limit_stream(df, limit=2, window_s=5, order="id"), "allowed"),
    "throttle": (lambda df: L.throttle(df, gap_ms=2000), lambda df: L.throttle_stream(df, gap_ms=2000, order="id"), "emitted"),
    "token_bucket": (lambda df: L.token_bucket(df, rate=0.5, crawl_delay="delay"), lambda df: L.token_bucket_stream(df, rate=0.5, crawl_delay="delay", order="id"), "wait_s"),
}


@pytest.mark.parametrize("name", LIMITERS)
def test_twins_equal_their_batch_forms(spark, tmp_path, name):
    batch, twin, column = LIMITERS[name]
    rows = requests()
    want = {r["id"]: r[column] for r in batch(spark.createDataFrame(rows, COLUMNS)).collect()}
    got, _ = streamed(spark, tmp_path, rows, twin)
    assert {r["id"]: r[column] for r in got.collect()} == want
    assert len(set(want.values())) > 1


@pytest.mark.parametrize("name", LIMITERS)
def test_state_is_empty_after_idle_time(spark, tmp_path, name):
    late = T0 + dt.timedelta(days=1)
    # after the pause there is one other key; the batch behind it lets the timers fire
    rows = requests(n=40) + [(1000 + i, "z", late + dt.timedelta(hours=i), 0.0) for i in range(24)]
    _, q = streamed(spark, tmp_path, rows, LIMITERS[name][1], 8)
    state = spark.read.format("statestore").option("path", str(tmp_path / "log")).option("stateVarName", "held").load()
    assert {r.key for r in state.select("key.key").collect()} <= {"z"}


def plain_bucket(rows, rate):
    """One loop a key, without cuts."""
    out, room, keys = {}, max(1.0, rate), {}
    for i, k, ts, delay in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        t, each = (ts - T0).total_seconds(), 1 / min(rate, 1 / delay) if delay else 1 / rate
        tokens, at = keys.get(k, (room, t))
        now = max(t, at)
        tokens = min(room, tokens + (now - at) / each)
        while tokens < 1 - 1e-9:
            now, tokens = now + each, min(room, tokens + 1)
        keys[k] = (tokens - 1, now)
        out[i] = now - t
    return out


@pytest.mark.parametrize("rate", [0.05, 0.5, 3.0])
def test_buckets_are_cut_only_where_they_are_full(spark, rate):
    rows = requests(5, 1500, "ab", (0.0, 0.1, 1.0, 10.0, 100.0, 1000.0))
    got = {r["id"]: r["wait_s"] for r in L.token_bucket(spark.createDataFrame(rows, COLUMNS), rate=rate, crawl_delay="delay").collect()}
    want = plain_bucket(rows, rate)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-3 for i in want)


def test_requests_without_a_key_are_one_key(spark):
    rows = [(i, None, T0 + dt.timedelta(seconds=i), 0.0) for i in range(4)] + [(9, "k", T0, 0.0)]
    got = {r["id"]: r["allowed"] for r in L.rate_limit(spark.createDataFrame(rows, COLUMNS), limit=1, window_s=3).collect()}
    assert got == {0: True, 1: False, 2: False, 3: True, 9: True}
    assert L.rate_limit(spark.createDataFrame([], COLUMNS)).collect() == []


# -- sessions and counts --------------------------------------------------------------------------

EVENTS = [("queue:enqueue", 4), ("crawl:start", 3), ("crawl:success", 2), ("crawl:error", 1)]


def events():
    out, i = [], 0
    for run in ("r1", "r2"):
        for session in range(2):
            t = session * 3600
            for kind, n in EVENTS:
                for _ in range(n - (session if kind == "crawl:success" else 0)):
                    out.append((i, run, T0 + dt.timedelta(seconds=t), kind))
                    i, t = i + 1, t + 20
    return out


def test_sessions_count_what_a_run_has_done(spark):
    rows = L.run_sessions(spark.createDataFrame(events(), "id long, run string, ts timestamp, type string")).orderBy("run", "start").collect()
    assert [(r.run, r.events, r.enqueued, r.started, r.succeeded, r.failed, r.active, r.percent) for r in rows] == [(run, 10 - s, 4, 3, 2 - s, 1, s, 75 - 25 * s) for run in ("r1", "r2") for s in (0, 1)]
    assert [(r.start, r.end) for r in rows[:1]] == [(T0, T0 + dt.timedelta(seconds=9 * 20 + 300))]


def test_streamed_sessions_equal_the_batch_with_late_rows(spark, tmp_path):
    rows = sorted(events(), key=lambda r: r[2])
    # a row that is a little late is in its session still, one that is hours late is in none
    little = rows.pop(3)
    parts = [rows[:6], [*rows[6:12], little], rows[12:], [(99, "end", T0 + dt.timedelta(days=1), "x")], [(100, "r1", T0, "crawl:error")], [(101, "end", T0 + dt.timedelta(days=2), "x")]]
    src = tmp_path / "in"
    src.mkdir()
    for k, part in enumerate(parts):
        pd.DataFrame(part, columns=["id", "run", "ts", "type"]).astype({"ts": "datetime64[us]"}).to_parquet(src / f"{k}.parquet")
    schema = "id long, run string, ts timestamp, type string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    L.run_sessions(stream).writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    want = L.run_sessions(spark.createDataFrame([*rows, little], schema)).collect()
    got = spark.table("sessions").where("run <> 'end'").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_live_counts_of_a_stream(spark, tmp_path):
    rows = sorted(events(), key=lambda r: r[2])
    src = tmp_path / "in"
    src.mkdir()
    for k in range(3):
        pd.DataFrame(rows[k::3], columns=["id", "run", "ts", "type"]).astype({"ts": "datetime64[us]"}).to_parquet(src / f"{k}.parquet")
    schema = "id long, run string, ts timestamp, type string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    L.live_counts(stream, late="2 hours").writeStream.format("memory").queryName("live").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    last = spark.table("live").groupBy("run", "type", "start").agg(F.max("n").alias("n")).collect()
    assert sorted(map(tuple, last)) == sorted(map(tuple, L.live_counts(spark.createDataFrame(rows, schema)).collect()))
