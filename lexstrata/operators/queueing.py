"""Leased priority queue as tables: fold of events, expiry, claims, fallback, settling.

Times are plain columns, so the same functions serve batch runs and ``foreachBatch``. A
null time never expires, settles or counts as stale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.binding import let

MAX_ATTEMPTS = 3
CLAIM_LIMIT = 50
STALE_LIMIT = 50
LEASE_SECONDS = 600
FALLBACK_MINUTES = 60
FINAL = {"succeed": "succeeded", "cancel": "cancelled", "fall_back": "fell_back"}


def fold_events(events: DataFrame, job: str, kind: str, *order: str) -> DataFrame:
    """State of each job after its events: lease, succeed, fail, cancel, fall_back.

    Every rule of the machine looks at three facts that aggregates give without collecting
    a job's events: leases so far, the last event, and whether a final event came first.
    A failure releases the job while it has attempts left.
    """
    at = F.struct(*order)
    final = F.col(kind).isin("succeed", "cancel", "fall_back")
    first_final = F.min_by(F.col(kind), F.when(final, at))
    cut = events.withColumn("_end", F.min(F.when(final, at)).over(Window.partitionBy(job)))
    before = F.col("_end").isNull() | (at <= F.col("_end"))
    folded = cut.filter(before).groupBy(job).agg(
        F.count_if(F.col(kind) == "lease").alias("attempts"), F.max_by(kind, at).alias("_last"), first_final.alias("_final")
    )
    state = (
        F.when(F.col("_final") == "succeed", "succeeded").when(F.col("_final") == "cancel", "cancelled").when(F.col("_final") == "fall_back", "fell_back")
        .when(F.col("_last") == "lease", "leased").when((F.col("_last") == "fail") & (F.col("attempts") >= MAX_ATTEMPTS), "failed").otherwise("pending")
    )
    return folded.select(job, "attempts", state.alias("status"))


def claim(jobs: DataFrame, limit: int, priority: str, created: str, tie: str, by: str | None = None) -> DataFrame:
    """The next jobs: highest priority, then oldest. ``limit`` is 1 to 50; with ``by``, for
    each value of that column. This is the queue's own limit, a top-k."""
    limit = max(1, min(limit, CLAIM_LIMIT))
    order = [F.desc(priority), F.asc(created), F.asc(tie)]
    if by is None:
        return jobs.orderBy(*order).limit(limit)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return jobs.withColumn("_n", rank).filter(F.col("_n") <= limit).drop("_n")


def expired(lease_until: Column, now: Column) -> Column:
    return F.coalesce(lease_until < now, F.lit(False))


def release_expired(jobs: DataFrame, now: Column) -> DataFrame:
    """Leased jobs whose lease ran out are pending again, without a lease."""
    gone = (F.col("status") == "leased") & expired(F.col("lease_until"), now)
    return jobs.withColumns({"status": F.when(gone, "pending").otherwise(F.col("status")), "lease_until": F.when(~gone, F.col("lease_until"))})


def stale(created: Column, now: Column, minutes: int) -> Column:
    """Pending for too long; zero or less switches the fallback off."""
    return F.lit(False) if minutes <= 0 else F.coalesce(created < now - F.make_dt_interval(mins=F.lit(minutes)), F.lit(False))


def stale_jobs(jobs: DataFrame, now: Column, minutes: int, status: str, created: str, tie: str, limit: int = STALE_LIMIT) -> DataFrame:
    """The oldest jobs that are pending for too long, at most ``limit`` a run: a top-k."""
    waiting = jobs.filter((F.col(status) == "pending") & stale(F.col(created), now, minutes))
    return waiting.orderBy(F.asc(created), F.asc(tie)).limit(max(0, limit))


def timed_fold(events: DataFrame, job: str, kind: str, ts: str, tie: str, now: Column, lease_seconds: int = LEASE_SECONDS, fallback_minutes: int = FALLBACK_MINUTES) -> DataFrame:
    """job, attempts, status, lease_until at ``now``, clocks included.

    A job is created by its first event. Before each event, and at ``now``, time passes: a
    lease that ran out makes the job pending again, and a job that is pending later than
    ``fallback_minutes`` after its creation has fallen back for good. ``lease`` takes a pending
    job for ``lease_seconds``, ``extend`` moves a lease on. Events without a time, and those
    after ``now``, do not count. One fold over a job's own events, of times and kinds only.
    """
    at = lambda c: (F.col(c).cast("timestamp").cast("double") * 1000).cast("long")
    cut = (now.cast("timestamp").cast("double") * 1000).cast("long")
    rows = events.select(F.col(job).alias("job"), at(ts).alias("t"), F.col(tie).alias("tie"), F.col(kind).alias("kind")).filter(F.col("t").isNotNull()).filter(F.col("t") <= cut)
    listed = rows.groupBy("job").agg(F.array_sort(F.collect_list(F.struct("t", "tie", "kind"))).alias("events"))
    start = F.struct(F.lit(0).alias("attempts"), F.lit("pending").alias("status"), F.lit(None).cast("long").alias("until"), F.get("events", F.lit(0))["t"].alias("born"))
    state = F.aggregate("events", start, lambda s, e: _applied(_passed(s, e["t"], fallback_minutes), e["kind"], e["t"], lease_seconds), lambda s: _passed(s, cut, fallback_minutes))
    return listed.select(F.col("job").alias(job), state.alias("s")).select(job, "s.attempts", "s.status", F.when(F.col("s.status") == "leased", F.timestamp_millis("s.until")).alias("lease_until"))


def _with(s: Column, **changed: Column) -> Column:
    return F.struct(*[changed.get(c, s[c]).alias(c) for c in ("attempts", "status", "until", "born")])


def _passed(s: Column, t: Column, fallback_minutes: int) -> Column:
    free = _with(s, status=F.when((s["status"] == "leased") & (s["until"] < t), "pending").otherwise(s["status"]))
    if fallback_minutes <= 0:
        return free
    return let(free, lambda f: _with(f, status=F.when((f["status"] == "pending") & (f["born"] + fallback_minutes * 60_000 < t), "fell_back").otherwise(f["status"])))


def _applied(s: Column, kind: Column, t: Column, lease_seconds: int) -> Column:
    def step(s: Column) -> Column:
        pending, leased, final = s["status"] == "pending", s["status"] == "leased", s["status"].isin("failed", *FINAL.values())
        leases = (kind == "lease") & pending
        status = F.when(final, s["status"]).when(leases, "leased").when((kind == "fail") & leased, F.when(s["attempts"] >= MAX_ATTEMPTS, "failed").otherwise("pending"))
        for name, becomes in FINAL.items():
            status = status.when(kind == name, becomes)
        until = F.when(~final & (leases | ((kind == "extend") & leased)), t + lease_seconds * 1000).otherwise(s["until"])
        return _with(s, attempts=s["attempts"] + F.when(~final & leases, 1).otherwise(0), status=status.otherwise(s["status"]), until=until)

    return let(s, step)


def settled(changes: DataFrame, key: str, at: str, now: Column, hours: int = 72) -> DataFrame:
    """Keys whose first time is ``hours`` back; later times never move the start."""
    starts = changes.groupBy(key).agg(F.min(at).alias("settling_started_at"))
    return starts.filter(F.col("settling_started_at") <= now - F.make_dt_interval(hours=F.lit(hours)))


def next_settled(changes: DataFrame, key: str, at: str, now: Column, hours: int = 72, limit: int = STALE_LIMIT) -> DataFrame:
    """The settled keys that waited longest, at most ``limit`` a run: a top-k."""
    return settled(changes, key, at, now, hours).orderBy("settling_started_at", key).limit(max(0, limit))


def accepted_attempts(attempts: DataFrame, request: str, attempt: str, valid: str) -> DataFrame:
    """First valid attempt of each request, and how many were made up to it."""
    good = F.min(F.when(F.col(valid), F.col(attempt)))
    return attempts.groupBy(request).agg(good.alias("accepted"), F.count(F.lit(1)).alias("made"))


def preferred_models(chain: Column, avoid: Column) -> Column:
    """The chain without the provider to avoid; else without that very model; else whole.
    Entries are ``provider:model``."""
    provider = lambda m: F.substring_index(m, ":", 1)
    others = F.filter(chain, lambda m: provider(m) != provider(avoid))
    rest = F.filter(chain, lambda m: m != avoid)
    return F.when(avoid.isNull(), chain).when(F.size(others) > 0, others).when(F.size(rest) > 0, rest).otherwise(chain)
