"""Audience matching by tags, and when to tell whom.

Null tag lists count as empty, a null region as none, a null impact as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DIRECT, POSSIBLE, OTHER = "direct", "possible", "other"
PROFILE = ["tags", "land", "interests", "answered"]
RULE = ["lands", "general", "all_of", "any_of", "none_of", "topics", "impact"]
REMINDER_DAYS = (14, 1, 0)


def _set(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def _overlap(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def groups_of(tags: Column) -> Column:
    """Tags are ``group.value``; their distinct groups."""
    return F.array_distinct(F.transform(_set(tags), lambda t: F.substring_index(t, ".", 1)))


def in_region(lands: Column, land: Column) -> Column:
    return (F.size(_set(lands)) == 0) | F.coalesce(F.array_contains(lands, land), F.lit(False))


def match_level(tags: Column, land: Column, interests: Column, answered: Column, lands: Column, general: Column, all_of: Column, any_of: Column, none_of: Column, topics: Column, impact: Column) -> Column:
    """direct, possible, other, or null outside the region.

    A group that the change asks for and the person never answered, or a change for some
    regions and a person without one, caps a match at possible; an excluded tag gives other.
    """
    tags, all_of, any_of, none_of = map(_set, (tags, all_of, any_of, none_of))
    general, impact = F.coalesce(general, F.lit(False)), F.coalesce(impact, F.lit(0))
    excluded = _overlap(none_of, tags)
    asked = F.size(all_of) + F.size(any_of) > 0
    by_tags = asked & (F.size(F.array_except(all_of, tags)) == 0) & ((F.size(any_of) == 0) | _overlap(any_of, tags))
    unanswered = F.size(F.array_except(groups_of(F.concat(all_of, any_of, none_of)), _set(answered))) > 0
    capped = unanswered | (land.isNull() & (F.size(_set(lands)) > 0))
    direct = ~excluded & (by_tags | (general & (impact >= 2)))
    partly = _overlap(_set(topics), _set(interests)) | _overlap(groups_of(any_of), groups_of(tags)) | (general & (impact == 1))
    level = F.when(direct & ~capped, DIRECT).when(direct | (~excluded & partly), POSSIBLE).otherwise(OTHER)
    return F.when(in_region(lands, land), level)


def explanation(tags: Column, all_of: Column, any_of: Column) -> Column:
    """The person's tags that the change names, sorted."""
    return F.array_sort(F.array_intersect(_set(tags), F.concat(_set(all_of), _set(any_of))))


def classes(rows: DataFrame, columns: list[str], key: str, name: str, size: str) -> DataFrame:
    """Distinct combinations of ``columns``, named by their smallest ``key``, with their sizes."""
    return rows.groupBy(*columns).agg(F.min(key).alias(name), F.count(F.lit(1)).alias(size))


def members(rows: DataFrame, columns: list[str], key: str, name: str) -> DataFrame:
    """(key, name of its class)."""
    found = classes(rows, columns, key, name, "_n").drop("_n")
    same = [rows[c].eqNullSafe(found[c]) for c in columns]
    return rows.join(found, same).select(rows[key], found[name])


def class_matches(people: DataFrame, changes: DataFrame, person: str, change: str) -> DataFrame:
    """profile, rule, people, changes, level, because, for classes that share a region.

    People who answered alike have one profile and changes that ask alike one rule; only
    these meet, so the work follows the number of different answers, not of people. Regions
    make an equi-join: a rule without regions is listed under every region and under none.
    """
    profiles = classes(people, PROFILE, person, "profile", "people")
    rules = classes(changes, RULE, change, "rule", "changes")
    regions = profiles.select("land").distinct()
    everywhere = rules.filter(F.size(_set(F.col("lands"))) == 0).join(regions)
    somewhere = rules.filter(F.size("lands") > 0).withColumn("land", F.explode(F.array_distinct("lands")))
    listed = everywhere.unionByName(somewhere).withColumnRenamed("land", "_land")
    joined = profiles.join(listed, F.col("land").eqNullSafe(F.col("_land")))
    level = match_level(*[F.col(c) for c in ("tags", "land", "interests", "answered", "lands", "general", "all_of", "any_of", "none_of", "topics", "impact")])
    because = F.array_join(explanation(F.col("tags"), F.col("all_of"), F.col("any_of")), ",")
    return joined.select("profile", "rule", "people", "changes", level.alias("level"), because.alias("because"))


def effective_state(dates: Column, today: Column) -> Column:
    """upcoming, partially_in_force, in_force or unknown, from all effective dates."""
    known = F.filter(dates, lambda x: x.isNotNull())
    return (
        F.when(F.coalesce(F.size(known), F.lit(0)) <= 0, "unknown").when(F.array_min(known) > today, "upcoming")
        .when(F.array_max(known) > today, "partially_in_force").otherwise("in_force")
    )


def reminders(changes: DataFrame, key: str, effective: str, known_since: str, days: tuple[int, ...] = REMINDER_DAYS) -> DataFrame:
    """Reminder days that are not past when the change is known; the one on the day itself
    only where no reminder goes out the day before."""
    offsets = F.explode(F.array(*map(F.lit, days))).alias("days_before")
    rows = changes.select(key, effective, known_since, offsets).withColumn("remind_on", F.date_sub(effective, F.col("days_before")))
    open_ = rows.filter(F.col("remind_on") >= F.col(known_since))
    eve = F.max((F.col("days_before") == 1).cast("int")).over(Window.partitionBy(key))
    return open_.withColumn("_eve", eve).filter((F.col("days_before") != 0) | (F.col("_eve") == 0)).select(key, "days_before", "remind_on")


def rate_limited(messages: DataFrame, recipient: str, at: str, tie: str, per_day: int = 3) -> DataFrame:
    """Adds channel: the first ``per_day`` of a recipient's day go out, the rest is digest."""
    rank = F.row_number().over(Window.partitionBy(recipient, F.to_date(at)).orderBy(at, tie))
    return messages.withColumn("channel", F.when(rank <= per_day, "instant").otherwise("digest"))


def after_quiet_hours(at: Column, start: int = 22, end: int = 8) -> Column:
    """The time itself, or the end of the quiet hours it falls into."""
    day, hour = F.date_trunc("day", at), F.hour(at)
    morning = F.make_dt_interval(hours=F.lit(end))
    return F.when(hour >= start, day + F.make_dt_interval(days=F.lit(1)) + morning).when(hour < end, day + morning).otherwise(at)
