"""Version histories: slowly changing dimensions, before and after, change groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .snapshots import content_hash


def new_versions(rows: DataFrame, key: str, content: str, *order: str) -> DataFrame:
    """Rows whose content hash differs from the row before (null-safe), numbered from 1."""
    by = Window.partitionBy(key).orderBy(*order)
    hashed = rows.withColumn("content_hash", content_hash(F.col(content)))
    first = F.row_number().over(by) == 1
    changed = first | ~F.col("content_hash").eqNullSafe(F.lag("content_hash").over(by))
    return hashed.withColumn("_new", changed).filter("_new").drop("_new").withColumn("version", F.row_number().over(by))


def validity(versions: DataFrame, key: str, at: str, *order: str) -> DataFrame:
    """Adds valid_to (the next version's start, null while current)."""
    return versions.withColumn("valid_to", F.lead(at).over(Window.partitionBy(key).orderBy(*order)))


def before_and_after(versions: DataFrame, key: str, content: str, *order: str) -> DataFrame:
    """The two last versions of each key, side by side."""
    last = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    ranked = versions.select(key, content, F.row_number().over(last).alias("_n")).filter("_n <= 2")
    pick = lambda n: F.max(F.when(F.col("_n") == n, F.col(content)))
    return ranked.groupBy(key).agg(pick(2).alias("before"), pick(1).alias("after"))


def group_changes(rows: DataFrame, group: str, member: str, note: str, order: str, limit: int = 3) -> DataFrame:
    """One row a group: its number of members, the first non-null note by order, and a title of
    the first ``limit`` members. Counts are plain aggregates; of the members only the first few
    are ranked, which each task cuts to ``limit`` a group before they are shuffled."""
    first_note = F.min_by(F.col(note), F.when(F.col(note).isNotNull(), F.col(order)))
    counted = rows.groupBy(group).agg(F.count(F.lit(1)).alias("members"), first_note.alias("note"))
    ranked = rows.select(group, member, F.row_number().over(Window.partitionBy(group).orderBy(order)).alias("_n")).filter(F.col("_n") <= limit)
    shown = F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(member).cast("string").alias("m")))), lambda x: x["m"])
    titled = ranked.groupBy(F.col(group).alias("_group")).agg(shown.alias("_shown"))
    grouped = counted.join(titled, counted[group].eqNullSafe(titled["_group"]), "left")
    return grouped.select(group, "members", "note", group_title(F.coalesce("_shown", F.array().cast("array<string>")), F.col("members"), limit).alias("title"))


def group_title(shown: Column, members: Column, limit: int = 3) -> Column:
    names = F.array_join(shown, ", ")
    return F.when(members > limit, F.concat(names, F.lit(" und "), (members - limit).cast("string"), F.lit(" weitere"))).otherwise(names)


def forward_fill(rows: DataFrame, key: str, column: str, *order: str) -> DataFrame:
    """The last non-null value up to and including each row."""
    by = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(by))


def line_changes(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """Added and removed lines of each key, as multisets: equal lines cancel in pairs."""
    lines = lambda df, sign: df.select(key, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line"), F.lit(sign).alias("sign"))
    balance = lines(old, -1).unionByName(lines(new, 1)).groupBy(key, "line").agg(F.sum("sign").alias("d"))
    return balance.groupBy(key).agg(F.sum(F.greatest("d", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("removed"))
