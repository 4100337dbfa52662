"""Exact dedup over an extendible-hash index on shared files (DataFrame operations only).

How it works
------------
1. Every row gets a key, the SHA-256 of its text, and keys are counted by their leading bits:
   as many bits as the counts call for, ``MOST_DEPTH`` at most, so the driver holds a bounded
   number of counters. From these the directory grows as in extendible hashing: a bucket
   above ``capacity`` keys splits on its next bit, and the directory doubles when the deepest
   bucket does. A directory slot is a key prefix, so each bucket is one contiguous key range.
2. The directory routes every row to its bucket. A partial aggregate on (bucket, key, text)
   combines copies inside each map task before anything is shuffled, and the final aggregate
   compares whole texts of a bucket byte by byte. A group that holds a third of all rows
   reaches its reducer as one row a map task.
3. Owner tasks take whole buckets: they chain the entries that share a key (the chain
   number tells colliding texts apart) and write the bucket's folder of the index.
4. Rows probe the index by (bucket, key) with the keys kept from step 1, without their texts.
   Keys with more than a ``HOT_SHARE``-th of all rows, at most that many, are looked up by a
   broadcast, so no probe task takes a hot key. Only keys whose chain has more than one text
   read their texts again and are compared by them.

Defined cases: a null text counts as the empty text; rows that repeat both id and text are
one document and share its verdict; of rows that repeat an id with different texts each is
judged by its own text; a null id is kept only if its whole group has no id; an empty table
gives an empty result. Other columns of the input are never touched.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, remove_path, work_path

CAPACITY = 4096
MOST_DEPTH = 20
SPARE_BITS = 3
HOT_SHARE = 10_000


def sha256_key(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _prefix(key: Column, bits: int) -> Column:
    """The first ``bits`` bits of a hex key as an integer; at most 32."""
    head = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    return F.shiftright(head, 32 - bits).cast("int")


def grow_directory(counts: dict[int, int], capacity: int, max_depth: int) -> list[tuple[int, int, int, int]]:
    """Split overfull buckets until each holds ``capacity`` keys or ``max_depth`` is reached.

    ``counts``: keys per prefix of ``max_depth`` bits. Returns (bucket, local depth, first
    prefix, last prefix); the ranges cover all prefixes without gaps, in order. A bucket
    that is still overfull at ``max_depth`` keeps its rows as an overflow chain.
    """
    totals = [0] * (2**max_depth + 1)
    for p in range(2**max_depth):
        totals[p + 1] = totals[p] + counts.get(p, 0)
    done, stack = [], [(0, 0)]
    while stack:
        depth, first = stack.pop()
        width = 2 ** (max_depth - depth)
        if totals[first + width] - totals[first] > capacity and depth < max_depth:
            stack += [(depth + 1, first + width // 2), (depth + 1, first)]
        else:
            done.append((depth, first, first + width - 1))
    return [(b, d, lo, hi) for b, (d, lo, hi) in enumerate(sorted(done, key=lambda x: x[1]))]


def directory_of(keys: DataFrame, capacity: int = CAPACITY, most_depth: int = MOST_DEPTH) -> tuple[DataFrame, int]:
    """(directory, depth in bits) for a table of distinct keys. The depth allows buckets of
    uneven keys ``SPARE_BITS`` more splits than even ones need."""
    spark: SparkSession = keys.sparkSession
    buckets = max(1, math.ceil(keys.count() / capacity))
    depth = min(most_depth, math.ceil(math.log2(buckets)) + SPARE_BITS)
    counted = keys.groupBy(_prefix(F.col("key"), depth).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 2**depth rows
    grown = grow_directory({r.p: r.n for r in counted}, capacity, depth)
    return spark.createDataFrame([(b, d, p) for b, d, lo, hi in grown for p in range(lo, hi + 1)], "bucket int, local_depth int, prefix int"), depth


def _routed(rows: DataFrame, directory: DataFrame, depth: int) -> DataFrame:
    """``rows`` with the bucket of their key. The directory has at most 2**MOST_DEPTH rows of two ints."""
    return rows.withColumn("prefix", _prefix(F.col("key"), depth)).join(F.broadcast(directory.select("prefix", "bucket")), "prefix").drop("prefix")


def _keyed(docs: DataFrame, id_col: str, text_col: str, key: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", "text", key(F.col("text")).alias("key"))


def build_index(docs: DataFrame, directory: DataFrame, depth: int, id_col: str = "doc_id", text_col: str = "text", key: Callable[[Column], Column] = sha256_key) -> DataFrame:
    """Index rows: bucket, key, chain, chain_length, keep_id, group_size; a folder a bucket."""
    spark: SparkSession = docs.sparkSession
    routed = _routed(_keyed(docs, id_col, text_col, key), directory, depth)
    groups = routed.groupBy("bucket", "key", "text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    entries_path = work_path(spark, "exact-entries")
    groups.select("bucket", "key", "keep_id", "group_size", F.crc32(F.col("text").cast("binary")).alias("text_crc")).write.parquet(entries_path)
    entries = spark.read.parquet(entries_path)

    chain = Window.partitionBy("bucket", "key")
    index = (
        entries.repartition("bucket")
        .withColumn("chain", F.row_number().over(chain.orderBy("keep_id", "text_crc")))
        .withColumn("chain_length", F.count(F.lit(1)).over(chain))
        .select("bucket", "key", "chain", "chain_length", "keep_id", "group_size")
    )
    path = work_path(spark, "exact-index")
    index.sortWithinPartitions("bucket", "key", "chain").write.partitionBy("bucket").parquet(path)
    id_type = entries.schema["keep_id"].dataType.simpleString()
    remove_path(spark, entries_path)
    return spark.read.schema(f"key string, chain int, chain_length long, keep_id {id_type}, group_size long, bucket int").parquet(path)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Callable[[Column], Column] = sha256_key, capacity: int = CAPACITY, most_depth: int = MOST_DEPTH) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, bucket."""
    keyed = _keyed(docs, id_col, text_col, key)
    sha = F.col("key") if key is sha256_key else sha256_key(F.col("text"))
    probe = materialize(keyed.select("id", "key", sha.alias("sha")), "exact-keys")
    counted = materialize(probe.groupBy("key").agg(F.count(F.lit(1)).alias("rows")), "exact-counts")
    directory, depth = directory_of(counted.select("key"), capacity, most_depth)
    index = build_index(docs, directory, depth, id_col, text_col, key)

    routed = _routed(probe, directory, depth)
    single = index.filter("chain_length = 1").select("bucket", "key", "keep_id", "group_size")
    least = counted.agg(F.sum("rows").alias("n")).select((F.col("n") / HOT_SHARE).alias("least")).first().least or 0
    hot = single.filter(F.col("group_size") > least)  # fewer than HOT_SHARE rows
    looked = routed.join(F.broadcast(hot), ["bucket", "key"], "left")
    cold = looked.filter("group_size is null").drop("keep_id", "group_size").join(single.filter(F.col("group_size") <= least), ["bucket", "key"])
    columns = ["id", "sha", "bucket", "keep_id", "group_size"]
    found = looked.filter("group_size is not null").select(columns).unionByName(cold.select(columns))
    chained = index.filter("chain_length > 1 and chain = 1").select("bucket", "key")
    if not chained.isEmpty():
        found = found.unionByName(_by_text(_routed(keyed, directory, depth), chained).select(columns))
    return found.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"), "bucket"
    )


def _by_text(routed: DataFrame, chained: DataFrame) -> DataFrame:
    """Rows whose key is shared by different texts: grouped by the whole text."""
    rows = routed.join(chained, ["bucket", "key"]).withColumn("sha", sha256_key(F.col("text")))
    groups = rows.groupBy("bucket", "key", "text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, ["bucket", "key", "text"])


def keep_first_of_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact dedup keeps, with their own columns. A row is told by
    its id and the digest of its text, so rows that repeat an id are judged one by one."""
    kept = exact_dedup(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias("_keep"), F.col("text_sha256").alias("_sha")).distinct()
    own = sha256_key(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_keep"]) & (own == kept["_sha"]), "left_semi")
