"""Shards of near equal bytes by histogram sort (DataFrame operations only).

How it works
------------
1. Rows sort by a 64-bit key: 44 bits of the text's hash, then 20 bits of the id's. Equal texts
   thus lie side by side, while the copies in a hot group still have keys of their own.
2. The key space is cut at candidate boundaries (probes), and the exact rows and bytes between
   them are counted in one aggregate over the keys. An interval that still holds a shard's border
   with more than ``tolerance`` of a shard on both sides, or more rows than a block may have,
   gets finer probes inside, and only its rows are counted in the next round. Rounds end when all
   intervals fit, or hold one key; 64 bits bound their number.
3. Borders are the counted boundaries nearest to equal shares. An interval is now a block with a
   known number of rows before it in its shard, so a row's slot needs its own block only.
4. Whole rows are exchanged once, by file: a run of blocks of one shard. Sorting inside that file
   numbers the slots; the result is already as ``write_shards`` stores it.

The driver holds counters: at most 2**16 in the first round, then those of intervals that are too
large, in number about the rows divided by ``BLOCK_ROWS``, and at most one interval a border.

Defined cases: a null text counts as none, its row still has 8 bytes; rows that repeat both id and
text (or a text without an id) share one key, hence one block and shard; an empty table gives an
empty result; fewer rows than shards leave shards empty; the input's columns stay, but for such
as have a result's name (``RESULT``), which the result replaces.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from dataclasses import dataclass
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

SHARDS = 24
TOLERANCE = 1e-3
BLOCK_ROWS = 1 << 17
BLOCKS = 1024
MOST_FIRST_BITS = 16
MORE_BITS = 12
ID_BITS = 20
FILE_BYTES = 64 << 20
MOST_TASKS = 20_000
ROW_BYTES = 8
RESULT = ("size", "shard", "slot", "file")


def row_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def sort_key(text: Column, row_id: Column) -> Column:
    """Unsigned 64 bits in a long: the text's hash above, the id's below."""
    high = F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), ID_BITS), ID_BITS)
    return high.bitwiseOR(F.shiftrightunsigned(F.xxhash64(row_id, text), 64 - ID_BITS))


@dataclass(frozen=True)
class Interval:
    """Keys whose first ``depth`` bits are ``prefix`` (signed as Spark has it), and what they hold."""

    depth: int
    prefix: int
    rows: int
    size: int

    @property
    def start(self) -> int:
        return (self.prefix << (64 - self.depth)) & (2**64 - 1)


def _listed(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A small table from the driver, as one literal: no task needs Python for it."""
    names = [c.split(" ")[0] for c in columns.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{columns.replace(' ', ': ')}>>".replace(",: ", ", "))))


def _refined(found: list[Interval], before: dict[Interval, int], borders: list[float], spare: float, block_rows: int, again: bool) -> list[tuple[int, int, int]]:
    """(depth, prefix, further bits) of the intervals that need finer probes. Keys are hashes,
    so what is too large ``again`` holds a hot group, whose keys part far below."""
    more = []
    for x in found:
        if x.depth == 64 or x.rows == 1:
            continue
        lo, hi = before[x], before[x] + x.size
        k = bisect_right(borders, lo + spare)
        torn = k < len(borders) and borders[k] < hi - spare
        if torn or x.rows > block_rows:
            bits = MORE_BITS if torn or again else min(MORE_BITS, ceil(log2(x.rows / block_rows)) + 2)
            more.append((x.depth, x.prefix, min(bits, 64 - x.depth)))
    return more


def _stepped(rows: DataFrame, more: DataFrame, how: str) -> DataFrame:
    """``rows`` with the depth and prefix of the finer interval, where theirs was cut."""
    finer = rows.join(F.broadcast(more), ["_depth", "_prefix"], how).withColumn("_depth", F.col("_depth") + F.coalesce("_bits", F.lit(0)))
    return finer.withColumn("_prefix", F.expr("shiftrightunsigned(_key, 64 - _depth)")).drop("_bits")


def _started(rows: DataFrame, bits: int) -> DataFrame:
    return rows.withColumn("_depth", F.lit(bits)).withColumn("_prefix", F.expr("shiftrightunsigned(_key, 64 - _depth)"))


def histogram(keys: DataFrame, shards: int, tolerance: float = TOLERANCE, block_rows: int | None = None) -> tuple[int, list[list[tuple[int, int, int]]], list[Interval]]:
    """(first bits, cuts by round, final intervals in key order) for a table (_key, size)."""
    spark: SparkSession = keys.sparkSession
    total = keys.agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("size")).first()
    if not total.rows:
        return 1, [], []
    block_rows = block_rows or min(BLOCK_ROWS, max(32, total.rows // BLOCKS))
    first = min(MOST_FIRST_BITS, max(1, ceil(log2(total.rows / block_rows)) + 1))
    borders, spare = [total.size * k / shards for k in range(1, shards)], tolerance * total.size / shards
    done: list[Interval] = []
    cuts: list[list[tuple[int, int, int]]] = []
    routed = _started(keys, first)
    while True:
        counted = routed.groupBy("_depth", "_prefix").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("size")).collect()
        done += [Interval(r._depth, r._prefix, r.rows, r["size"]) for r in counted]
        done.sort(key=lambda x: x.start)
        before, at = {}, 0
        for x in done:
            before[x], at = at, at + x.size
        more = _refined(done, before, borders, spare, block_rows, bool(cuts))
        if not more:
            return first, cuts, done
        cut = {(d, p) for d, p, _ in more}
        done = [x for x in done if (x.depth, x.prefix) not in cut]
        cuts.append(more)
        routed = _stepped(routed, _listed(spark, more, "_depth int, _prefix long, _bits int"), "inner")


def _laid_out(intervals: list[Interval], shards: int, file_bytes: int) -> list[tuple[int, int, int, int, int, int]]:
    """(depth, prefix, block, shard, file, rows before in the shard) of each interval."""
    total = sum(x.size for x in intervals)
    ends = [0]
    for x in intervals:
        ends.append(ends[-1] + x.size)
    starts = [0]  # of the shards, as numbers of intervals
    for k in range(1, shards):
        want = total * k
        i = max(starts[-1], bisect_right(ends, want // shards) - 1)
        if i < len(intervals) and ends[i + 1] * shards - want < want - ends[i] * shards:
            i += 1
        starts.append(i)
    out, files = [], 0
    for s, (a, b) in enumerate(zip(starts, [*starts[1:], len(intervals)])):
        held, rows = 0, 0
        for i in range(a, b):
            if i == a or held >= file_bytes:
                files, held = files + 1, 0
            out.append((intervals[i].depth, intervals[i].prefix, i, s, files - 1, rows))
            rows, held = rows + intervals[i].rows, held + intervals[i].size
    return out


def shard_rows(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE, block_rows: int | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """``docs`` with size, shard (0 to ``shards`` - 1), slot (from 0 in each shard) and file.

    Shards differ from equal bytes by no more than ``tolerance`` of a shard at each border, or by
    the row that lies across it. Rows of a file are in one task, in the order of their slots.
    """
    spark: SparkSession = docs.sparkSession
    text, row_id = F.col(text_col), F.col(id_col)
    sized = docs.drop(*[c for c in RESULT if c not in (id_col, text_col)]).withColumns({"size": row_size(text), "_key": sort_key(text, row_id)})
    first, cuts, intervals = histogram(materialize(sized.select("_key", "size"), "shard-keys"), shards, tolerance, block_rows)
    routed = _started(sized, first)
    for more in cuts:
        routed = _stepped(routed, _listed(spark, more, "_depth int, _prefix long, _bits int"), "left")
    laid_out = _laid_out(intervals, shards, file_bytes)
    blocks = _listed(spark, laid_out, "_depth int, _prefix long, _block int, shard int, file int, _before long")
    files = max((b[4] + 1 for b in laid_out), default=1)
    dealt = routed.join(F.broadcast(blocks), ["_depth", "_prefix"]).repartition(min(files, MOST_TASKS), "file")
    in_block = Window.partitionBy("file", "_block").orderBy("_key", id_col, text_col)
    slotted = dealt.withColumn("slot", F.col("_before") + F.row_number().over(in_block) - 1)
    return slotted.drop("_key", "_depth", "_prefix", "_block", "_before")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Store the shards, a folder a shard, each file a run of slots in order."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, file of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return shard_rows(docs, shards).select(
        "doc_id", "size", F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "file"
    )
