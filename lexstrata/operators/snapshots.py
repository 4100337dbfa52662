"""Snapshot comparison: outcomes, vanished and orphaned keys, insert-if-absent.

Null keys never match anything; two null contents count as equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CREATED, UPDATED, UNCHANGED, MISSING, REPEALED = "created", "updated", "unchanged", "missing", "repealed"


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def fetch_outcomes(documents: DataFrame, known: DataFrame, key: str, content: str) -> DataFrame:
    """key, content_hash, outcome: ``unchanged`` when the hash is the one on record."""
    seen = known.select(key, F.col("content_hash").alias("_known"))
    now = documents.select(key, content_hash(F.col(content)).alias("content_hash"))
    outcome = F.when(F.col("_known").isNull(), CREATED).when(F.col("_known") == F.col("content_hash"), UNCHANGED).otherwise(UPDATED)
    return now.join(seen, key, "left").select(key, "content_hash", outcome.alias("outcome"))


def compare_snapshots(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """key and outcome over both snapshots (full outer, null-safe content equality)."""
    a = old.select(key, F.col(content).alias("_old"), F.lit(True).alias("_in_old"))
    b = new.select(key, F.col(content).alias("_new"), F.lit(True).alias("_in_new"))
    outcome = (
        F.when(F.col("_in_old").isNull(), CREATED)
        .when(F.col("_in_new").isNull(), MISSING)
        .when(F.col("_old").eqNullSafe(F.col("_new")), UNCHANGED)
        .otherwise(UPDATED)
    )
    sizes = [F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in ("_old", "_new")]
    return a.join(b, key, "full_outer").select(key, outcome.alias("outcome"), sizes[0].alias("bytes_before"), sizes[1].alias("bytes_after"))


def changes_the_repository(outcome: Column) -> Column:
    return outcome.isin(CREATED, UPDATED, REPEALED)


def missing_from(known: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows of ``known`` whose key was not seen."""
    return known.join(seen.select(key).distinct(), key, "left_anti")


def insert_absent(table: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows to append: first of each key by ``order``, unless the table has the key."""
    first = Window.partitionBy(*keys).orderBy(order)
    fresh = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return fresh.join(table.select(*keys).distinct(), keys, "left_anti")


def latest_per_key(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key; ``order`` ends with a tie-breaker. A partial aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(best).select(*keys, "_row.*")


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """Full-outer upsert. Columns in ``keep`` stay as they are once a row exists."""
    old, new = current.alias("o"), incoming.alias("n")
    joined = old.join(new, keys, "full_outer")
    columns = []
    for c in [x for x in current.columns if x not in keys]:
        order = (f"o.{c}", f"n.{c}") if c in keep else (f"n.{c}", f"o.{c}")
        columns.append(F.coalesce(*map(F.col, order)).alias(c) if c in incoming.columns else F.col(f"o.{c}").alias(c))
    return joined.select(*keys, *columns)


def absence_streaks(days: DataFrame, key: str, day: str, present: str) -> DataFrame:
    """Absences in a row up to each day; a sighting starts the count again.

    The number of sightings so far names the island, the position in it is the streak.
    """
    by = Window.partitionBy(key).orderBy(day)
    islands = days.withColumn("_island", F.sum(F.col(present).cast("int")).over(by))
    inside = Window.partitionBy(key, "_island").orderBy(day)
    streak = F.when(F.col(present), 0).otherwise(F.sum((~F.col(present)).cast("int")).over(inside))
    return islands.select(key, day, present, streak.cast("int").alias("misses"))
