"""Content-addressed store: ``source/yyyy/MM/dd/sha256.ext``, written once.

An empty or null content is never stored and has no address; a null source is ``unknown``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# First bytes that tell a kind, and the kinds told by a declared type, in order.
STARTS = (("PK\x03\x04", "zip"), ("%PDF", "pdf"))
DECLARED = ("xml", "json", "html", "pdf", "zip")


def extension(content: Column, content_type: Column | None = None) -> Column:
    """From the first bytes, then from the declared type, else ``bin``."""
    text = content.cast("string")
    kind = F.lit("bin")
    for name in reversed(DECLARED if content_type is not None else ()):
        kind = F.when(F.contains(content_type, F.lit(name)), name).otherwise(kind)
    for start, name in reversed(STARTS):
        kind = F.when(text.startswith(start), name).otherwise(kind)
    return kind


def safe_name(source: Column) -> Column:
    """A source's name as a folder: runs of other characters become one dash, none at the ends."""
    return F.btrim(F.regexp_replace(F.coalesce(source, F.lit("unknown")), "[^A-Za-z0-9._-]+", "-"), F.lit("-"))


def address(source: Column, day: Column, content: Column, content_type: Column | None = None) -> Column:
    path = F.concat(safe_name(source), F.lit("/"), F.date_format(day, "yyyy/MM/dd"), F.lit("/"), F.sha2(content.cast("binary"), 256), F.lit("."), extension(content, content_type))
    return F.when(content.cast("string") != "", path)


def held(addresses: DataFrame, store: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``addresses`` with what the store (path, content) holds there, null where nothing is,
    and ``exists``. Leading slashes of an address do not count."""
    kept = store.select(F.col("path").alias("_path"), F.col("content").alias(content), F.lit(True).alias("_there"))
    found = addresses.join(kept, F.ltrim(addresses[path], F.lit("/")) == kept["_path"], "left")
    return found.withColumn("exists", F.coalesce("_there", F.lit(False))).drop("_path", "_there")


def store_new(documents: DataFrame, path: str, source: str, day: str, content: str) -> DataFrame:
    """Append documents whose (source, hash) the store does not hold; returns those rows.
    Empty contents are left out."""
    spark = documents.sparkSession
    rows = documents.filter(F.col(content) != "").withColumn("content_hash", F.sha2(F.col(content).cast("binary"), 256)).dropDuplicates([source, "content_hash"])
    try:
        held = spark.read.parquet(path).select(source, "content_hash")
    except Exception as e:  # an empty store has no files yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        held = rows.select(source, "content_hash").limit(0)
    fresh = rows.join(held, [source, "content_hash"], "left_anti")
    fresh.write.mode("append").partitionBy(source, day).parquet(path)
    return fresh
