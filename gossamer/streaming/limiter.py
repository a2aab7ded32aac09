"""Stateful limiters: batch forms over a table of requests, and their streaming twins; counts of events.

A limiter is a ``Rule``: what is remembered of a key, and what a request makes of it. Both forms apply the same rule,
one to rows in order, many keys a batch, the other to state that a timer clears.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000


@dataclass(frozen=True)
class Rule:
    """``step(state, micros, delay)`` answers a request and changes the state, a list of numbers; ``fresh`` makes one;
    from ``idle(state, delay)`` on the state is as good as a fresh one."""

    column: str
    kind: str
    fresh: Callable[[], list[float]]
    step: Callable[[list[float], int, float], object]
    idle: Callable[[list[float], float], float]


def sliding_log(limit: int, window_s: int) -> Rule:
    """At most ``limit`` accepted requests in any ``window_s``; only accepted ones count."""
    width = window_s * SECOND

    def step(held: list[float], t: int, _: float) -> bool:
        while held and held[0] <= t - width:
            held.pop(0)
        if len(held) < limit:
            held.append(t)
            return True
        return False

    return Rule("allowed", "boolean", list, step, lambda held, _: (held[-1] if held else 0) + width)


def last_emitted(gap_ms: int) -> Rule:
    def step(last: list[float], t: int, _: float) -> bool:
        if last and t - last[0] < gap_ms * 1000:
            return False
        last[:] = [t]
        return True

    return Rule("emitted", "boolean", list, step, lambda last, _: (last[0] if last else 0) + gap_ms * 1000)


def bucket(rate: float) -> Rule:
    """A bucket of ``rate`` tokens (one at least), full at first, that fills with ``rate`` a second, or one every ``delay`` seconds
    where that is less. A request without a token waits whole intervals, behind those before it."""
    room = max(1.0, rate)
    each = lambda delay: 1 / min(rate, 1 / delay) if delay > 0 else 1 / rate

    def step(state: list[float], t: int, delay: float) -> float:
        now, e = t / SECOND, each(delay)
        if state:
            tokens, at = state
            now = max(now, at)
            tokens = min(room, tokens + (now - at) / e)
        else:
            tokens = room
        while tokens < 1 - 1e-9:
            now += e
            tokens = min(room, tokens + 1)
        state[:] = [tokens - 1, now]
        return round(now - t / SECOND, 6)

    return Rule("wait_s", "double", list, step, lambda state, delay: (state[1] + room * each(delay)) * SECOND if state else 0)


def _in_order(rows: DataFrame, key: str, ts: str, order: str, rule: Rule, width_s: float, cut: Callable[[DataFrame, Window], DataFrame], delay: str | None = None) -> DataFrame:
    """Apply a rule to the rows of each key in order.

    Keys are cut into slices of time, of which counts and ends are aggregated first; ``cut`` adds to them
    whether all before a slice is forgotten by then. From one cut to the next rows are dealt, sorted and read as a
    stream, many stretches a batch, so a busy key is many stretches and none has to fit in memory.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    name = F.coalesce(F.col(key).cast("string"), F.lit("\0"))
    each = F.coalesce(F.col(delay).cast("double"), F.lit(0.0)) if delay else F.lit(0.0)
    keyed = rows.withColumns({"_key": name, "_at": micros, "_delay": each}).withColumn("_slice", F.floor(F.col("_at") / int(width_s * SECOND)))
    slices = keyed.groupBy("_key", "_slice").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_low"), F.max("_at").alias("_high"), F.max("_delay").alias("_most"))
    w = Window.partitionBy("_key").orderBy("_slice")
    fresh = F.coalesce("_cut", F.lit(True)).cast("long")
    slices = cut(slices, w).withColumn("_stretch", F.sum(fresh).over(w.rowsBetween(Window.unboundedPreceding, 0))).select("_key", "_slice", "_stretch")
    dealt = keyed.join(slices, ["_key", "_slice"]).drop("_slice")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.repartition(n, "_key", "_stretch").sortWithinPartitions("_key", "_stretch", "_at", order)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    arrow = {"boolean": pa.bool_(), "double": pa.float64()}[rule.kind]
    width = len(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, rule.fresh()
        for b in batches:
            out = []
            for k, part, t, d in zip(*(b.column(c).to_pylist() for c in ("_key", "_stretch", "_at", "_delay"))):
                if (k, part) != last:
                    last, state = (k, part), rule.fresh()
                out.append(rule.step(state, t, d))
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(out, arrow)], [*b.schema.names[:width], rule.column])

    return sorted_.select(*rows.columns, "_key", "_stretch", "_at", "_delay").mapInArrow(run, f"{kinds}, {rule.column} {rule.kind}")


def _pause(micros: int) -> Callable[[DataFrame, Window], DataFrame]:
    return lambda slices, w: slices.withColumn("_cut", F.col("_low") - F.lag("_high").over(w) >= micros)


def rate_limit(requests: DataFrame, key: str = "key", ts: str = "ts", order: str = "id", limit: int = 60, window_s: int = 60) -> DataFrame:
    """Adds ``allowed``: at most ``limit`` accepted requests of a key in any ``window_s``. Requests without a key are one key."""
    return _in_order(requests, key, ts, order, sliding_log(limit, window_s), window_s * 16, _pause(window_s * SECOND))


def throttle(events: DataFrame, key: str = "key", ts: str = "ts", order: str = "id", gap_ms: int = 200) -> DataFrame:
    """Adds ``emitted``: at most one event of a key each ``gap_ms``."""
    return _in_order(events, key, ts, order, last_emitted(gap_ms), gap_ms / 1000 * 64, _pause(gap_ms * 1000))


def token_bucket(requests: DataFrame, key: str = "key", ts: str = "ts", order: str = "id", rate: float = 1.0, crawl_delay: str | None = None) -> DataFrame:
    """Adds ``wait_s``: how long each request waits for a token, see ``bucket``.

    A key is cut where its bucket is full for sure: no queue ends later than the last request of
    some slice and, from that slice on, a whole interval for every request; and from there to the next request there is
    time to fill the bucket.
    """
    room = max(1.0, rate)

    def cut(slices: DataFrame, w: Window) -> DataFrame:
        each = F.greatest(F.lit(1 / rate), F.col("_most")) * SECOND
        upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
        work = slices.withColumns({"_each": each, "_work": F.col("_n") * each}).withColumn("_sum", F.sum("_work").over(upto))
        lead = work.withColumn("_lead", F.col("_high") - F.col("_sum") + F.col("_work"))
        ends = F.col("_sum") - F.col("_work") + F.max("_lead").over(before)
        return lead.withColumn("_cut", F.col("_low") - ends >= room * F.col("_each"))

    return _in_order(requests, key, ts, order, bucket(rate), max(60.0, 64 / rate), cut, crawl_delay)


# -- streaming twins --------------------------------------------------------------------------------


def _twin(requests: DataFrame, rule: Rule, key: str, ts: str, order: str | None, delay: str | None, late: str) -> DataFrame:
    """A rule over a stream: state a key, cleared by an event-time timer once it is as good as none.

    Rows of a batch are taken in order; rows behind the watermark are left out.
    """
    from pyspark.sql.streaming import StatefulProcessor

    spark = requests.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(provider):
        # the only store that has timers
        spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    names = [c for c in (order, key, ts) if c]
    kinds = dict(requests.dtypes)

    class Processor(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle, self.held = handle, handle.getValueState("held", "state array<double>, most double")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            state, most = ([*self.held.get()[0]], self.held.get()[1]) if self.held.exists() else (rule.fresh(), 0.0)
            pdf = pd.concat(list(rows)).sort_values([c for c in (ts, order) if c])
            times = pdf[ts].astype("datetime64[us]").astype("int64").tolist()
            delays = pdf[delay].fillna(0).tolist() if delay else [0.0] * len(pdf)
            answers = [rule.step(state, t, d) for t, d in zip(times, delays)]
            # the slowest refill seen decides how long the state is kept
            most = max(most, *delays)
            self.held.update(([float(x) for x in state], float(most)))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old if isinstance(old, int) else old[0])
            self.handle.registerTimer(max(int(rule.idle(state, most) // 1000) + 1, timerValues.getCurrentWatermarkInMs() + 1))
            yield pdf[names].assign(**{rule.column: answers})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.held.clear()
            return iter([])

        def close(self) -> None:
            pass

    out = ", ".join(f"`{c}` {kinds[c]}" for c in names) + f", {rule.column} {rule.kind}"
    return requests.withWatermark(ts, late).groupBy(key).transformWithStateInPandas(Processor(), out, "Append", "EventTime")


def rate_limit_stream(requests: DataFrame, key: str = "key", ts: str = "ts", limit: int = 60, window_s: int = 60, order: str | None = None, late: str = "0 seconds") -> DataFrame:
    """(order, key, ts, allowed) of a stream."""
    return _twin(requests, sliding_log(limit, window_s), key, ts, order, None, late)


def throttle_stream(events: DataFrame, key: str = "key", ts: str = "ts", gap_ms: int = 200, order: str | None = None, late: str = "0 seconds") -> DataFrame:
    """(order, key, ts, emitted) of a stream."""
    return _twin(events, last_emitted(gap_ms), key, ts, order, None, late)


def token_bucket_stream(requests: DataFrame, key: str = "key", ts: str = "ts", rate: float = 1.0, crawl_delay: str | None = None, order: str | None = None, late: str = "0 seconds") -> DataFrame:
    """(order, key, ts, wait_s) of a stream; a bucket that is full again is forgotten."""
    return _twin(requests, bucket(rate), key, ts, order, crawl_delay, late)


# -- counts of events -------------------------------------------------------------------------------

#: The events of a run that are counted, by what their count is called.
RUN_EVENTS = {"enqueued": "queue:enqueue", "started": "crawl:start", "succeeded": "crawl:success", "failed": "crawl:error", "limits": "crawl:limit-reached"}


def run_sessions(events: DataFrame, run: str = "run", ts: str = "ts", kind: str = "type", gap: str = "5 minutes", late: str = "1 minute", kinds: dict[str, str] = RUN_EVENTS) -> DataFrame:
    """One row for each stretch of a run's events without a pause of ``gap``: (run, start, end, events, a count of each kind, active, percent).

    active is what was started and has neither succeeded nor failed; percent is what has of the most that was queued or started.
    Over a stream a row comes once the watermark has passed the end of its stretch; rows later than that are left out.
    """
    src = events.withWatermark(ts, late) if events.isStreaming else events
    counts = src.groupBy(run, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("events"), *[F.count_if(F.col(kind) == v).alias(k) for k, v in kinds.items()])
    done = F.col("succeeded") + F.col("failed")
    most = F.greatest("enqueued", "started", done, F.lit(1))
    return counts.select(run, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", *kinds, (F.col("started") - done).alias("active"), F.least(F.lit(100), F.floor(done / most * 100 + 0.5)).alias("percent"))


def live_counts(events: DataFrame, run: str = "run", ts: str = "ts", kind: str = "type", width: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """(run, type, start, n): events of each kind in windows, for the update mode of a stream; a window's state goes with the watermark."""
    src = events.withWatermark(ts, late) if events.isStreaming else events
    return src.groupBy(run, kind, F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(run, kind, F.col("w.start").alias("start"), "n")


def event_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events of a kind in tumbling windows, for batches and, with a watermark, for streams."""
    src = events.withWatermark(ts, late) if events.isStreaming else events
    return src.groupBy(F.window(ts, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def backoff_ms(attempt, base: int = 500, draw=None, jitter: float = 0.1):
    """Delay before a retry; with a ``draw`` in [0, 1) it is given or taken the jitter."""
    delay = F.lit(base) * F.pow(F.lit(2.0), attempt)
    return delay if draw is None else F.greatest(F.lit(0.0), delay + delay * jitter * (2 * draw - 1))
