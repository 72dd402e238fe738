"""Structured Streaming forms of what follows live sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues


def follow(polls: DataFrame, key: str, sequence: str = "sequence", order: str = "poll", at: str | None = None, seconds: float | None = None, is_live: str | None = None) -> DataFrame:
    """Of a stream of polled segments those whose sequence is above all seen before for their key; zero is never new.

    State is one number for each key and whether it has stopped, so a playlist may be followed for any time; batches may hold any part of a poll.
    Stop rules as in `until_stopped`: with is_live, the first poll that ends a playlist is its last (a poll in several batches ends with the
    batch that says so); with seconds, rows at that time (column at) and later are left out.
    """
    polls = polls if seconds is None else polls.filter(F.col(at) < seconds)
    columns = [key, sequence, order]
    schema = polls.select(*columns).schema

    def newer(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        top, stopped = state.get if state.exists else (0, None)
        rows = pd.concat(list(batches)).sort_values([order, sequence], kind="stable")
        if is_live:
            ends = rows.loc[~rows["_live"].astype(bool), order]
            stopped = stopped if len(ends) == 0 else int(ends.min()) if stopped is None else min(stopped, int(ends.min()))
            rows = rows if stopped is None else rows[rows[order] <= stopped]
            if rows.empty:
                state.update((top, stopped))
                return
        before = rows[sequence].cummax().shift(1).fillna(top).clip(lower=max(top, 0))
        fresh = rows[rows[sequence] > before]
        state.update((max(top, int(rows[sequence].max())), stopped))
        yield fresh[columns]

    live = [F.col(is_live).alias("_live")] if is_live else []
    return polls.select(*columns, *live).groupBy(key).applyInPandasWithState(newer, schema, "top long, stopped long", "append", "NoTimeout")


def answered(requests: DataFrame, replies: DataFrame, timeout: str = "60 seconds", late: str = "2 minutes") -> DataFrame:
    """Requests (id, req_ts) with replies (r_id, resp_ts, outcome) in time; watermarks on both sides bound the state."""
    a, b = requests.withWatermark("req_ts", late), replies.withWatermark("resp_ts", late)
    return a.join(b, F.expr(f"id = r_id and resp_ts >= req_ts and resp_ts <= req_ts + interval {timeout}"))


def _timed(events: DataFrame, ts: str) -> DataFrame:
    """Watermarks take no times without a zone; such times count in the session's."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed_counts(events: DataFrame, ts: str, by: str, width: str = "10 minutes", step: str | None = None, late: str = "30 minutes") -> DataFrame:
    """Counts by window and kind for late data up to a watermark. An extension: what the engine follows has no event time of its own."""
    window = F.window(ts, width, step) if step else F.window(ts, width)
    return _timed(events, ts).withWatermark(ts, late).groupBy(window.alias("window"), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n")


def sessions(events: DataFrame, ts: str, by: str, gap: str = "15 minutes", late: str = "30 minutes") -> DataFrame:
    """Sessions of each key that end after a gap. An extension, as above."""
    window = F.session_window(ts, gap)
    return _timed(events, ts).withWatermark(ts, late).groupBy(window.alias("window"), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n")


class Follower(StatefulProcessor):
    """Follows one playlist: new parts go out, and a timer ends what is silent, or has been followed for its time."""

    def __init__(self, columns: list[str], silence_ms: int, most_ms: int | None) -> None:
        self.columns, self.silence_ms, self.most_ms = columns, silence_ms, most_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # State that no timer has cleared goes by itself.
        self.seen = handle.getValueState("seen", "top long, since long, stopped boolean", ttlDurationMs=100 * (self.silence_ms + (self.most_ms or 0)))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        top, since, stopped = self.seen.get() if self.seen.exists() else (0, now, False)
        if stopped:
            return
        _, sequence, order = self.columns
        polled = pd.concat(list(rows)).sort_values([order, sequence], kind="stable")
        before = polled[sequence].cummax().shift(1).fillna(top).clip(lower=max(top, 0))
        fresh = polled[polled[sequence] > before][self.columns]
        self.seen.update((max(top, int(polled[sequence].max())), since, False))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        wait = now + self.silence_ms
        self.handle.registerTimer(wait if self.most_ms is None else min(wait, since + self.most_ms))
        yield fresh.assign(ended=None)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        top, since, _ = self.seen.get() if self.seen.exists() else (0, 0, False)
        by_time = self.most_ms is not None and expiredTimerInfo.getExpiryTimeInMs() >= since + self.most_ms
        if by_time:
            self.seen.update((top, since, True))  # later polls are not followed
        else:
            self.seen.clear()
        name, sequence, order = self.columns
        yield pd.DataFrame({name: [key[0]], sequence: [None], order: [None], "ended": ["time" if by_time else "silent"]})

    def close(self) -> None:
        pass


def follow_by_time(polls: DataFrame, key: str, sequence: str = "sequence", order: str = "poll", silence_ms: int = 60_000, most_ms: int | None = None) -> DataFrame:
    """As `follow`, by the wall clock: (key, sequence, order, ended). A playlist that is not polled for ``silence_ms`` gets a row that
    says ``silent`` and its state goes, so that it may begin again; one that is followed for ``most_ms`` gets one that says ``time`` and
    is not followed on. Needs the RocksDB state store (`use_rocksdb`)."""
    kinds = dict(polls.dtypes)
    schema = f"{key} {kinds[key]}, {sequence} {kinds[sequence]}, {order} {kinds[order]}, ended string"
    return polls.select(key, sequence, order).groupBy(key).transformWithStateInPandas(statefulProcessor=Follower([key, sequence, order], silence_ms, most_ms), outputStructType=schema, outputMode="append", timeMode="processingTime")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


# --- progress -------------------------------------------------------------------------------------------------------

OBSERVED = "download"


def observed(parts: DataFrame, size: str) -> DataFrame:
    """The parts as they are; bytes and parts of each batch are told to listeners."""
    return parts.observe(OBSERVED, F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"), F.count(F.lit(1)).alias("parts"))


class Progress(StreamingQueryListener):
    """Adds up what queries over `observed` parts have handled, and tells it after every batch: tell(name, bytes, parts)."""

    def __init__(self, tell: Callable[[str | None, int, int], None] | None = None) -> None:
        self.totals: dict[str, tuple[int, int]] = {}
        self.seen: dict[str, int] = {}
        self.ended: set[str] = set()
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        m = p.observedMetrics.get(OBSERVED)
        if m is None or self.seen.get(str(p.id), -1) >= p.batchId:  # a batch may be told again
            return
        done = self.totals.get(str(p.id), (0, 0))
        self.seen[str(p.id)], self.totals[str(p.id)] = p.batchId, (done[0] + m["bytes"], done[1] + m["parts"])
        if self.tell:
            self.tell(p.name, *self.totals[str(p.id)])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.id))
