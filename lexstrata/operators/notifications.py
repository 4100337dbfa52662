"""Notifications: keys that make sending idempotent, their lifecycle, and a day's sending plan.

The lifecycle is a fold of actions (schedule, reschedule, sent, failed, cancel), told by four facts
that aggregates give: the last action, the last planned time, the last sending, and the last error
that no sending followed. Actions without a time or of other names do not count; a null error of a
failure is kept as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .audience import after_quiet_hours, rate_limited

KEY_LENGTH, ERROR_LENGTH = 128, 512
STATUS = {"schedule": "scheduled", "reschedule": "deferred", "sent": "sent", "failed": "failed", "cancel": "cancelled"}


def idempotency_key(recipient: Column, kind: Column, channel: Column, subject: Column, variant: Column) -> Column:
    """One key for each message that a recipient may get once."""
    return F.left(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in (recipient, kind, channel, subject, variant)]), F.lit(KEY_LENGTH))


def lifecycle(actions: DataFrame, key: str, action: str, at: str, tie: str, planned: str, error: str) -> DataFrame:
    """key, status, scheduled_at, sent_at, error of each notification after its ``actions``."""
    rows = actions.filter(F.col(at).isNotNull() & F.col(action).isin(*STATUS))
    order, is_ = F.struct(at, tie), lambda *names: F.col(action).isin(*names)
    status = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])[F.max_by(action, order)]
    ended = F.max_by(F.struct(F.col(action).alias("a"), F.left(F.col(error), F.lit(ERROR_LENGTH)).alias("e")), F.when(is_("sent", "failed"), order))
    return rows.groupBy(key).agg(
        status.alias("status"), F.max_by(planned, F.when(is_("schedule", "reschedule"), order)).alias("scheduled_at"), F.max_by(at, F.when(is_("sent"), order)).alias("sent_at"),
        F.when(ended["a"] == "failed", ended["e"]).alias("error"),
    )


def sending_plan(messages: DataFrame, recipient: str, at: str, tie: str, per_day: int = 3) -> DataFrame:
    """Adds channel, send_at, status: the first few messages of a recipient's day go out at
    once or after the quiet hours, the others wait for the digest (send_at null)."""
    ranked = rate_limited(messages, recipient, at, tie, per_day)
    send = F.when(F.col("channel") == "instant", after_quiet_hours(F.col(at)))
    return ranked.withColumn("send_at", send).withColumn("status", F.when(F.col("send_at") == F.col(at), "scheduled").otherwise("deferred"))
