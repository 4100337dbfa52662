"""Histories in text form: log records, numstat lines, line provenance, and the commit sink.

A null text has no records; lines that do not parse are skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RECORD, UNIT = "\x1e", "\x1f"
LOG_FIELDS = ("commit", "author", "email", "date", "subject", "body")


def parse_log(logs: DataFrame, keys: list[str], log: str) -> DataFrame:
    """keys, place, commit, author, email, date, subject, body from separated records."""
    rows = logs.select(*keys, F.posexplode(F.split(log, RECORD)).alias("place", "_r")).filter(F.btrim("_r", F.lit(" \n")) != "")
    parts = F.split(F.btrim("_r", F.lit("\n")), UNIT)
    return rows.select(*keys, "place", *[F.get(parts, k).alias(name) for k, name in enumerate(LOG_FIELDS)])


def parse_numstat(stats: DataFrame, keys: list[str], lines: str) -> DataFrame:
    """keys, path, added, removed; a dash (binary file) counts as 0."""
    rows = stats.select(*keys, F.explode(F.split(lines, "\n")).alias("_l")).filter(F.col("_l").rlike(r"^(\d+|-)\t(\d+|-)\t."))
    part = F.split("_l", "\t")
    number = lambda k: F.coalesce(part[k].try_cast("long"), F.lit(0))
    return rows.select(*keys, part[2].alias("path"), number(0).alias("added"), number(1).alias("removed"))


def parse_provenance(blames: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, line_no, commit, author, content. A commit's author is written once only, with
    the first of its lines, and holds for all of them."""
    lines = blames.select(*keys, F.posexplode(F.split(text, "\n")).alias("_n", "_l"))
    header = r"^([0-9a-f]{40}) \d+ (\d+)"
    by = Window.partitionBy(*keys).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(by)
    is_head = F.col("_l").rlike(header)
    rows = lines.withColumns({"commit": last(F.when(is_head, F.regexp_extract("_l", header, 1))), "line_no": last(F.when(is_head, F.regexp_extract("_l", header, 2).cast("int")))})
    authors = rows.filter(F.col("_l").startswith("author ")).groupBy(*keys, "commit").agg(F.min(F.substr("_l", F.lit(8))).alias("author"))
    content = rows.filter(F.col("_l").startswith("\t")).select(*keys, "line_no", "commit", F.substr("_l", F.lit(2)).alias("content"))
    return content.join(authors, [*keys, "commit"], "left").select(*keys, "line_no", "commit", "author", "content")


def append_commit(spark: SparkSession, path: str, changes: DataFrame, message: str, parent: str = "") -> str | None:
    """Append changed rows as one commit; its hash, or None when nothing changed.

    The hash folds the row hashes by a commutative sum, so the order of rows does not matter.
    """
    rows = changes.withColumn("_h", F.xxhash64(*[F.col(c).cast("string") for c in changes.columns]))
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_h").cast("decimal(38,0)")).alias("h")).first()
    if not got.n:
        return None
    commit = spark.range(1).select(F.sha2(F.lit(f"{parent}|{got.n}|{got.h}|{message}"), 256).alias("h")).first().h
    changes.withColumns({"commit": F.lit(commit), "parent": F.lit(parent), "message": F.lit(message)}).write.mode("append").parquet(path)
    return commit
