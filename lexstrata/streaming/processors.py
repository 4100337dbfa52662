"""Streaming forms of the settling window, the leased queue and idempotent delivery.

All take and return streaming DataFrames; state is keyed, so it is spread like the keys.
Events later than the watermark are dropped by Spark; a null time never settles anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampType

from ..operators.queueing import FALLBACK_MINUTES, FINAL, LEASE_SECONDS, MAX_ATTEMPTS
from ..shipping import ship_package


class SettlingProcessor(StatefulProcessor):
    """Emits a key once its first event is ``hours`` old; later events never move the start."""

    def __init__(self, hours: int = 72):
        self.hours = hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.start = handle.getValueState("start", StructType([StructField("ms", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = min((int(t.timestamp() * 1000) for batch in rows for t in batch["ts"].dropna()), default=None)
        held = self.start.get()[0] if self.start.exists() else None
        if first is not None and (held is None or first < held):
            if held is not None:
                self.handle.deleteTimer(held + self.hours * 3_600_000)
            self.start.update((first,))
            self.handle.registerTimer(first + self.hours * 3_600_000)
        yield pd.DataFrame({"key": [], "settling_started_at": pd.Series([], dtype="datetime64[ns]")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.start.exists():
            yield pd.DataFrame({"key": [key[0]], "settling_started_at": [pd.Timestamp(self.start.get()[0], unit="ms")]})
            self.start.clear()

    def close(self) -> None:
        pass


SETTLED = StructType([StructField("key", LongType()), StructField("settling_started_at", TimestampType())])


def settling_stream(events: DataFrame, key: str, ts: str, hours: int = 72, delay: str = "1 hour") -> DataFrame:
    """(key, settling_started_at) as the watermark passes the end of each window."""
    rows = events.select(F.col(key).cast("long").alias("key"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", delay)
    ship_package(rows.sparkSession)
    return rows.groupBy("key").transformWithStateInPandas(SettlingProcessor(hours), SETTLED, "Append", "EventTime")


class LeaseProcessor(StatefulProcessor):
    """Queue state of a job from its events (lease, succeed, fail, cancel, fall_back)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", StructType([StructField("attempts", IntegerType()), StructField("status", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        attempts, status = self.state.get() if self.state.exists() else (0, "pending")
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for kind in events["kind"]:
            if status in FINAL.values():
                break
            if kind == "lease":
                attempts, status = attempts + 1, "leased"
            elif kind == "fail":
                status = "failed" if attempts >= MAX_ATTEMPTS else "pending"
            else:
                status = FINAL.get(kind, status)
        self.state.update((attempts, status))
        yield pd.DataFrame({"job": [key[0]], "attempts": [attempts], "status": [status]})

    def close(self) -> None:
        pass


JOBS = StructType([StructField("job", LongType()), StructField("attempts", IntegerType()), StructField("status", StringType())])


def lease_stream(events: DataFrame, job: str, kind: str, ts: str, tie: str) -> DataFrame:
    """The new state of each job that had events in a micro-batch."""
    rows = events.select(F.col(job).cast("long").alias("job"), F.col(kind).alias("kind"), F.col(ts).alias("ts"), F.col(tie).alias("event_id"))
    ship_package(rows.sparkSession)
    return rows.groupBy("job").transformWithStateInPandas(LeaseProcessor(), JOBS, "Update", "None")


class TimedLeaseProcessor(StatefulProcessor):
    """Queue state of a job with clocks: the lease's end and the fallback are event-time timers.

    One timer is set, at the next time that may change the state. Between micro-batches events
    must come in order of time; ``operators.queueing.timed_fold`` gives the same states.
    """

    def __init__(self, lease_seconds: int = LEASE_SECONDS, fallback_minutes: int = FALLBACK_MINUTES):
        self.lease_ms, self.fallback_ms = lease_seconds * 1000, fallback_minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [StructField("attempts", IntegerType()), StructField("status", StringType()), StructField("until", LongType()), StructField("born", LongType()), StructField("timer", LongType())]
        self.job = handle.getValueState("job", StructType(fields))

    def _passed(self, status: str, until: int, born: int, t: int) -> str:
        if status == "leased" and until < t:
            status = "pending"
        if status == "pending" and self.fallback_ms > 0 and born + self.fallback_ms < t:
            status = "fell_back"
        return status

    def _kept(self, key, attempts: int, status: str, until: int, born: int, timer: int) -> pd.DataFrame:
        wanted = until + 1 if status == "leased" else born + self.fallback_ms + 1 if status == "pending" and self.fallback_ms > 0 else 0
        if timer and timer != wanted:
            self.handle.deleteTimer(timer)
        if wanted and timer != wanted:
            self.handle.registerTimer(wanted)
        self.job.update((attempts, status, until, born, wanted))
        return pd.DataFrame({"job": [key[0]], "attempts": [attempts], "status": [status], "lease_until": [pd.Timestamp(until, unit="ms") if status == "leased" else pd.NaT]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).dropna(subset=["ts"]).sort_values(["ts", "event_id"])
        times = [int(t.timestamp() * 1000) for t in events["ts"]]
        if times:
            attempts, status, until, born, timer = self.job.get() if self.job.exists() else (0, "pending", 0, times[0], 0)
            for kind, t in zip(events["kind"], times, strict=True):
                status = self._passed(status, until, born, t)
                if status == "failed" or status in FINAL.values():
                    break
                if kind == "lease" and status == "pending":
                    attempts, status, until = attempts + 1, "leased", t + self.lease_ms
                elif kind == "extend" and status == "leased":
                    until = t + self.lease_ms
                elif kind == "fail" and status == "leased":
                    status = "failed" if attempts >= MAX_ATTEMPTS else "pending"
                else:
                    status = FINAL.get(kind, status)
            yield self._kept(key, attempts, status, until, born, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        attempts, status, until, born, timer = self.job.get()
        after = self._passed(status, until, born, expiredTimerInfo.getExpiryTimeInMs())
        yield self._kept(key, attempts, after, until, born, 0)

    def close(self) -> None:
        pass


TIMED_JOBS = StructType([StructField("job", LongType()), StructField("attempts", IntegerType()), StructField("status", StringType()), StructField("lease_until", TimestampType())])


def timed_lease_stream(events: DataFrame, job: str, kind: str, ts: str, tie: str, delay: str = "0 seconds", lease_seconds: int = LEASE_SECONDS, fallback_minutes: int = FALLBACK_MINUTES) -> DataFrame:
    """The new state of each job that had events, or whose clock ran out, in a micro-batch."""
    rows = events.select(F.col(job).cast("long").alias("job"), F.col(kind).alias("kind"), F.col(ts).cast("timestamp").alias("ts"), F.col(tie).alias("event_id")).withWatermark("ts", delay)
    ship_package(rows.sparkSession)
    return rows.groupBy("job").transformWithStateInPandas(TimedLeaseProcessor(lease_seconds, fallback_minutes), TIMED_JOBS, "Update", "EventTime")


class CacheProcessor(StatefulProcessor):
    """Answers by fingerprint: a request within ``ttl`` of the answer that is kept is a hit, a
    later one is a miss, whose answer is kept from then on. An expired answer is cleared by a
    timer, so state does not outlive it."""

    def __init__(self, ttl_seconds: int):
        self.ttl_ms = ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", StructType([StructField("ms", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        requests = pd.concat(list(rows)).dropna(subset=["ts"]).sort_values(["ts", "request"])
        since, out = (self.kept.get()[0] if self.kept.exists() else None), []
        before = since
        for request, ts in zip(requests["request"], requests["ts"], strict=True):
            t = int(ts.timestamp() * 1000)
            hit = since is not None and t <= since + self.ttl_ms
            since = since if hit else t
            out.append((request, hit))
        if since is not None and since != before:
            if before is not None:
                self.handle.deleteTimer(before + self.ttl_ms + 1)
            self.kept.update((since,))
            self.handle.registerTimer(since + self.ttl_ms + 1)
        yield pd.DataFrame(out, columns=["request", "hit"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        yield pd.DataFrame({"request": pd.Series([], dtype="int64"), "hit": pd.Series([], dtype="bool")})

    def close(self) -> None:
        pass


CACHED = "request long, hit boolean"


def cache_stream(requests: DataFrame, fingerprint: str, request: str, ts: str, ttl_seconds: int, delay: str = "0 seconds") -> DataFrame:
    """(request, hit) of each request; ``operators.decisions.cache_hits`` is the batch form."""
    rows = requests.select(F.col(fingerprint).cast("string").alias("fingerprint"), F.col(request).cast("long").alias("request"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", delay)
    ship_package(rows.sparkSession)
    return rows.groupBy("fingerprint").transformWithStateInPandas(CacheProcessor(ttl_seconds), CACHED, "Append", "EventTime")


def deliver_once(messages: DataFrame, key: str, ts: str, delay: str = "1 day") -> DataFrame:
    """The first message of each idempotency key within the watermark."""
    return messages.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def weekly_digest(events: DataFrame, ts: str, delay: str = "1 day") -> DataFrame:
    """Events a week, in windows that start on Monday."""
    week = F.window(ts, "7 days", "7 days", "4 days")
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).groupBy(week).agg(F.count(F.lit(1)).alias("events")).select(F.col("window.start").alias("week"), "events")
