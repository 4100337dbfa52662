"""Best-fit packing by a configuration linear program over the length histogram.

Token counts are taken in Spark, one row a piece. What the driver sees is the histogram of
piece lengths: at most ``limit`` counters, whatever the input. A configuration is a
multiset of lengths that fits one sequence. The covering program

    minimise sum_c x_c   so that   sum_c x_c * a[c, l] >= n[l]   for every length l

is solved by multiplicative weights in phases. Each length has a weight, and a knapsack over
the capacity (dynamic programming) prices the configuration worth most. In a phase the
longest open length is covered by the configuration worth most that holds it; bought cover
lowers a length's weight exponentially, so lengths that lag come next. After a phase the
weights of lengths that only fit configurations worth less than the best one grow
exponentially. The weights divided by the worth of the best configuration are a dual
solution, so each phase also proves a lower bound. The phases stop when the best one is
within ``GAP`` of the best bound, or after ``PHASES``.

The best phase is rounded down to whole multiplicities, which leaves at most one sequence a
configuration, and a phase has at most one configuration a length. This rest is filled by
whole-sequence fillings of the longest length first, each repeated as often as counts allow.
Time depends on the number of lengths only.

Pieces are then ranked inside their length by Spark and looked up in the plan: interval
[from, to) of ranks of a length -> configuration, repetition, offset. With ``order``, ranks
follow a position of each document (a mixing schedule), and so do sequence ids.

Defined cases: a null text is empty, so the document is its end id alone; documents longer
than ``limit`` are cut into pieces of ``limit`` behind a first piece with the remainder;
rows that repeat an id are packed one by one; an empty table gives an empty result; a
document without a position comes first.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize
from .tokens import END_ID, default_tokenizer, pieces_of, tokenizer_at

LIMIT = 1024
PHASES = 6
GAP = 0.0005
LAG = 0.05
RISE = 0.5
LEAST_SHARD = 1024
MOST_SHARDS = 10_000
BATCH_CHARS = 1 << 20


def tokenized(docs: DataFrame, path: str, id_col: str, text_col: str, limit: int, end_id: int = END_ID) -> DataFrame:
    """One row a piece: id, row, piece, start, length, ids_crc32. Ids are not kept."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tokenizer_at(path)
        for batch in batches:
            out = []
            for key, row, ids in zip(batch["id"], batch["row"], encoder.encode(batch["text"].fillna("").tolist()), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                for k, (start, length) in enumerate(pieces_of(len(ids), limit)):
                    out.append((key, row, k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            yield pd.DataFrame(out, columns=["id", "row", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    if kind in ("bigint", "int"):  # pandas would turn null integers into floats
        rows = rows.withColumn("id", F.col("id").cast("string"))
    out = rows.mapInPandas(cut, "id string, row long, piece int, start long, length int, ids_crc32 long")
    return out.withColumn("id", F.col("id").cast(kind))


def knapsack(worth: np.ndarray, lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: for each room up to ``room`` the most worth that fits, and the
    item to take first (-1: leave one token free). ``lengths`` ascend."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    fitting = np.searchsorted(lengths, np.arange(room + 1), side="right").tolist()
    for r in range(1, room + 1):
        n = fitting[r]
        best[r] = best[r - 1]
        if n:
            total = worth[:n] + best[r - lengths[:n]]
            k = int(total.argmax())
            if total[k] > best[r]:
                best[r], pick[r] = total[k], k
    return best, pick


def cover_once(lengths: np.ndarray, need: np.ndarray, weight: np.ndarray, limit: int) -> list[tuple[dict[int, int], float]]:
    """One phase: [(places in ``lengths`` -> copies, times)] that covers ``need`` exactly.
    Each purchase closes at least one length."""
    left, bought = need.astype(float), []
    while (open_ := np.flatnonzero(left > 0)).size:
        longest = int(open_[-1])
        items, room = {longest: 1}, limit - int(lengths[longest])
        fits = open_[lengths[open_] <= room]
        if fits.size:
            lag = left[fits] / need[fits]
            _, pick = knapsack(weight[fits] * np.exp(LAG * (lag - 1)), lengths[fits], room)
            while room > 0:
                if pick[room] < 0:
                    room -= 1
                else:
                    k = int(fits[pick[room]])
                    items[k] = items.get(k, 0) + 1
                    room -= int(lengths[k])
        at, copies = np.array(list(items)), np.array(list(items.values()), dtype=float)
        turns = left[at] / copies
        times = float(turns.min())
        left[at] = np.where(turns <= times, 0.0, left[at] - times * copies)
        bought.append((items, times))
    return bought


def solve_covering(histogram: dict[int, int], limit: int, phases: int = PHASES, gap: float = GAP) -> tuple[list[tuple[dict[int, int], float]], float]:
    """(configurations with fractional multiplicities, proved lower bound of sequences)."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    need = np.array([histogram[x] for x in lengths.tolist()], dtype=np.int64)
    if not len(lengths):
        return [], 0.0
    share = lengths / limit
    bound, least, best = float((need * share).sum()), math.inf, []  # lengths as weights prove the volume bound
    exponent = 0.02 * np.log(share)  # long pieces are worth slightly more than their tokens
    for _ in range(phases):
        weight = share * np.exp(exponent)
        top = float(knapsack(weight, lengths, limit)[0][limit])
        bound = max(bound, float((need * weight).sum()) / top)
        bought = cover_once(lengths, need, weight, limit)
        cost = sum(times for _, times in bought)
        if cost < least:
            least, best = cost, bought
        if least <= (1 + gap) * bound:
            break
        for items, times in bought:
            at, copies = np.array(list(items)), np.array(list(items.values()))
            lacks = 1 - float((weight[at] * copies).sum()) / top
            exponent[at] += RISE * lacks * times * copies / need[at]
    return [({int(lengths[k]): n for k, n in items.items()}, times) for items, times in best], bound


def fill_rest(left: dict[int, int], limit: int) -> list[tuple[dict[int, int], int]]:
    """Best fit decreasing for the lengths that rounding left over: each filling starts with
    the longest length left, takes the subset that fills its room best, and is repeated as
    often as the counts allow. Reachable fillings are the bits of one integer."""
    left = {k: n for k, n in left.items() if n > 0}
    out = []
    while left:
        first = max(left)
        items = {first: 1}
        left[first] -= 1
        room = limit - first
        fits = (2 << room) - 1
        reach, steps = 1, []  # steps: (length, reachable before it)
        for length in sorted((x for x in left if x <= room and left[x] > 0), reverse=True):
            for _ in range(min(left[length], room // length)):
                more = (reach | reach << length) & fits
                if more == reach:
                    break
                steps.append((length, reach))
                reach = more
            if reach >> room & 1:
                break
        at = reach.bit_length() - 1
        for length, before in reversed(steps):
            if not before >> at & 1:  # only reachable with this piece
                at -= length
                items[length] = items.get(length, 0) + 1
        left[first] += 1
        times = min(left[length] // n for length, n in items.items())
        for length, n in items.items():
            left[length] -= n * times
        left = {k: n for k, n in left.items() if n > 0}
        out.append((items, times))
    return out


def plan_sequences(histogram: dict[int, int], limit: int, phases: int = PHASES) -> list[tuple[dict[int, int], int]]:
    """Configurations with whole multiplicities that use every piece exactly once."""
    left = dict(histogram)
    whole: dict[tuple[tuple[int, int], ...], int] = {}
    for items, x in solve_covering(histogram, limit, phases)[0]:
        times = min([int(x + 1e-6), *(left[length] // n for length, n in items.items())])
        if times > 0:
            key = tuple(sorted(items.items()))
            whole[key] = whole.get(key, 0) + times
            for length, n in items.items():
                left[length] -= times * n
    for items, times in fill_rest(left, limit):
        key = tuple(sorted(items.items()))
        whole[key] = whole.get(key, 0) + times
    return [(dict(k), n) for k, n in whole.items()]


def plan_rows(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """(length, rank from, rank to, copies a sequence, configuration, its sequences, first offset)."""
    used: dict[int, int] = {}
    rows = []
    for c, (items, times) in enumerate(plan):
        offset = 0
        for length, n in sorted(items.items(), reverse=True):
            at = used.get(length, 0)
            rows.append((length, at, at + n * times, n, c, times, offset))
            used[length] = at + n * times
            offset += n * length
    return rows


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = LIMIT, phases: int = PHASES, order: DataFrame | None = None, least_shard: int = LEAST_SHARD) -> DataFrame:
    """One row a piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    ``order``: (id, position) with one row an id. Pieces of a length are then handed out by
    position, and sequence ids ascend with the share of a configuration already used.
    """
    spark = docs.sparkSession
    pieces = tokenized(docs, tokenizer or default_tokenizer(), id_col, text_col, limit)
    if order is not None:
        place = order.select(F.col(id_col).alias("_id"), F.col("position").cast("long").alias("position"))
        pieces = pieces.join(place, F.col("id").eqNullSafe(F.col("_id")), "left").drop("_id").withColumn("position", F.coalesce("position", F.lit(0).cast("long")))
    else:
        pieces = pieces.withColumn("position", F.pmod(F.xxhash64("row", "piece"), F.lit(1 << 40)))
    pieces = materialize(pieces, "pack-pieces")
    counted = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.max("position").alias("last")).collect()  # at most `limit` rows
    histogram = {r.length: r.n for r in counted}
    plan = plan_sequences(histogram, limit, phases)
    # The plan is bounded by the lengths: a configuration closes a length or is a filling of the rest.
    slots = spark.createDataFrame(plan_rows(plan), "length int, rank_from long, rank_to long, copies long, configuration long, sequences long, first_offset long")

    # A length may belong to a third of all pieces: rank inside ranges of positions and add up.
    # A range holds about a 10,000th of all pieces at most, so no more than that many are added up.
    shard_rows = max(least_shard, sum(histogram.values()) // MOST_SHARDS)
    cuts = spark.createDataFrame([(r.length, -(-(r.last + 1) // -(-r.n // shard_rows))) for r in counted], "length int, width long")
    sharded = pieces.join(F.broadcast(cuts), "length").withColumn("shard", F.expr("position div width")).drop("width")
    sizes = materialize(sharded.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n")), "pack-sizes")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("shard")) - F.col("n")
    local = F.row_number().over(Window.partitionBy("length", "shard").orderBy("position", "row", "piece"))
    ranked = sharded.withColumn("local", local).join(sizes.select("length", "shard", before.alias("before")), ["length", "shard"]).withColumn("rank", F.col("before") + F.col("local") - 1)
    placed = ranked.join(F.broadcast(slots), "length").filter("rank >= rank_from and rank < rank_to")
    turn = F.expr("(rank - rank_from) div copies")
    bits = max(1, len(plan).bit_length())
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        (F.floor((turn + 0.5) / F.col("sequences") * float(1 << (60 - bits))) * (1 << bits) + F.col("configuration")).cast("long").alias("sequence_id"),
        (F.col("first_offset") + F.expr("(rank - rank_from) % copies") * F.col("length")).cast("long").alias("offset"),
    )
