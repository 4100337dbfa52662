"""Clocks of the queue and the cache: the batch folds against plain loops, the streams against the folds."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lexstrata.operators import decisions, queueing
from lexstrata.streaming import processors

START = dt.datetime(2026, 3, 1)


def plain_job(events, now, lease=600, fallback=60):
    attempts, status, until, born = 0, "pending", None, None

    def passed(t):
        nonlocal status
        if status == "leased" and until < t:
            status = "pending"
        if status == "pending" and fallback > 0 and born + dt.timedelta(minutes=fallback) < t:
            status = "fell_back"

    for ts, _, kind in sorted(e for e in events if e[0] <= now):
        born = born or ts
        passed(ts)
        if status in ("succeeded", "cancelled", "fell_back", "failed"):
            break
        if kind == "lease" and status == "pending":
            attempts, status, until = attempts + 1, "leased", ts + dt.timedelta(seconds=lease)
        elif kind == "extend" and status == "leased":
            until = ts + dt.timedelta(seconds=lease)
        elif kind == "fail" and status == "leased":
            status = "failed" if attempts >= 3 else "pending"
        elif kind in ("succeed", "cancel", "fall_back"):
            status = {"succeed": "succeeded", "cancel": "cancelled", "fall_back": "fell_back"}[kind]
    if born is None:
        return None
    passed(now)
    return attempts, status, until if status == "leased" else None


def made_events(seed, jobs=60):
    rng = random.Random(seed)
    rows, n = [], 0
    for job in range(jobs):
        t = START + dt.timedelta(seconds=rng.randrange(3600))
        for _ in range(rng.randrange(1, 9)):
            n += 1
            rows.append((job, rng.choice(["lease"] * 5 + ["extend", "fail", "fail", "succeed", "cancel", "create"]), t, n))
            t += dt.timedelta(seconds=rng.choice([0, 30, 599, 600, 601, 900, 2000]))
    return rows


COLUMNS = "job long, kind string, ts timestamp, event_id long"


@pytest.mark.parametrize(("lease", "fallback"), [(600, 60), (60, 5), (600, 0)])
def test_timed_fold(spark, lease, fallback):
    rows = made_events(lease + fallback)
    frame = spark.createDataFrame([*rows, (5, "cancel", None, 0), (None, "lease", START, 1)], COLUMNS)
    for minutes in (-1, 0, 20, 61, 300):
        now = START + dt.timedelta(minutes=minutes)
        got = {r.job: (r.attempts, r.status, r.lease_until) for r in queueing.timed_fold(frame, "job", "kind", "ts", "event_id", F.lit(now), lease, fallback).collect() if r.job is not None}
        by_job = {}
        for job, kind, ts, n in rows:
            by_job.setdefault(job, []).append((ts, n, kind))
        assert got == {j: s for j, e in by_job.items() if (s := plain_job(e, now, lease, fallback)) is not None}


def in_batches(spark, folder, rows, columns, cuts):
    """A stream of one file a micro-batch, in order of time."""
    edges = [dt.datetime.min, *cuts, dt.datetime.max]
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        part = [r for r in rows if a <= r[2] < b]
        spark.createDataFrame(part, columns).coalesce(1).write.parquet(f"{folder}/{i}")
    return spark.readStream.schema(columns).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))


def last_states(spark, stream, name, folder):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    seen = []

    def keep(batch, n):
        seen.extend((n, tuple(r)) for r in batch.collect())

    stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}-{name}").trigger(availableNow=True).start().awaitTermination()
    return seen


@pytest.mark.parametrize("minutes", [25, 75, 200])
def test_the_stream_ends_as_the_fold_at_each_cut(spark, tmp_path, minutes):
    """A job of its own, created at the cut, moves the clock there."""
    rows = made_events(7, 30)
    cut = START + dt.timedelta(minutes=minutes)
    given = [r for r in rows if r[2] <= cut] + [(999, "cancel", cut + dt.timedelta(milliseconds=1), 9999)]
    stream = in_batches(spark, tmp_path / "in", given, COLUMNS, [START + dt.timedelta(minutes=10), cut])
    seen = last_states(spark, processors.timed_lease_stream(stream, "job", "kind", "ts", "event_id"), "lease", tmp_path / "cp")
    got = {job: state for _, (job, *state) in seen if job != 999}
    fold = queueing.timed_fold(spark.createDataFrame(given, COLUMNS).filter("job <> 999"), "job", "kind", "ts", "event_id", F.lit(cut + dt.timedelta(milliseconds=1)))
    assert {j: (s[0], s[1]) for j, s in got.items()} == {r.job: (r.attempts, r.status) for r in fold.collect()}


def plain_hits(rows, ttl):
    kept, out = {}, {}
    for f, request, ts in sorted(rows, key=lambda r: (r[2], r[1])):
        hit = f in kept and ts <= kept[f] + dt.timedelta(seconds=ttl)
        kept[f] = kept[f] if hit else ts
        out[request] = hit
    return out


def test_cache_hits_expire(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), i, START + dt.timedelta(seconds=rng.randrange(4000))) for i in range(150)]
    columns = "fingerprint string, request long, ts timestamp"
    frame = spark.createDataFrame([*rows, ("a", 900, None)], columns)
    expected = plain_hits(rows, 300)
    assert {r.request: r.hit for r in decisions.cache_hits(frame, "fingerprint", "request", "ts", 300).collect()} == expected
    assert 0 < sum(expected.values()) < 150
    stream = in_batches(spark, tmp_path / "in", rows, columns, [START + dt.timedelta(seconds=s) for s in (500, 1500, 2500)])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    seen = []
    query = processors.cache_stream(stream, "fingerprint", "request", "ts", 300).writeStream.foreachBatch(lambda b, n: seen.extend(b.collect()))
    query.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert {r.request: r.hit for r in seen} == expected


def test_oldest_first(spark):
    jobs = spark.createDataFrame([(i, "pending" if i % 3 else "leased", START + dt.timedelta(minutes=i % 50)) for i in range(200)], "id long, status string, created timestamp")
    now = F.lit(START + dt.timedelta(minutes=90))
    got = queueing.stale_jobs(jobs, now, 60, "status", "created", "id").collect()
    expected = sorted((r.created, r.id) for r in jobs.collect() if r.status == "pending" and r.created < START + dt.timedelta(minutes=30))[:50]
    assert [(r.created, r.id) for r in got] == expected and len(got) == 50 and queueing.stale_jobs(jobs, now, 0, "status", "created", "id").count() == 0
    waiting = queueing.next_settled(jobs, "id", "created", F.lit(START + dt.timedelta(hours=73)), 72, limit=7).collect()
    assert [r.id for r in waiting] == [0, 50, 100, 150, 1, 51, 101]
