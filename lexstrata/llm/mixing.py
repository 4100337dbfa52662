"""Mixing sources to target weights by Pfair scheduling.

Rows of a source are numbered and cut into units of a half block. Time is cut into ranges of a
fixed number of slots, a unit a slot. What a source gets in a range follows from its weight alone:
with the sources' exact shares added up in one fixed order, ``C``, a source has
``floor(C t) - floor((C - w) t)`` units by the end of a range, within one unit of ``w t``, and all
sources together have just ``t``. Inside a range unit ``j`` of ``k`` is released at slot
``floor(j / k)`` of the range's length and due by ``ceil((j + 1) / k)`` of it; earliest deadline
first over these windows strays by less than one unit. Both together stay below two units: one block of the target.

Ranges need no knowledge of each other, so tasks schedule them side by side, whatever the weights;
only integers are used. Sources so small that a range may bring them nothing form one source of
their own, the first in the order (its share never falls), and the slots of that source are dealt
to its members in the same way, one level down; a unit is then a smaller part of a block, so that
the levels' deviations still add up to less than one.

Once half of the weight has run out, shares are those of the sources that are left, counted from
there. Until then slots of sources that ran out stay empty, and the others close up in proportion:
every row is placed exactly once, none is dropped or repeated. The driver holds a row a source; all
rows are numbered and placed by Spark.

Defined cases: a null source is a source of its own; a null id sorts first inside its source;
repeated rows are placed one by one; sources without a target weight, or with one that is null,
zero, negative or not finite, come behind all others, mixed evenly; an empty table gives an empty
result. Weights are exact fractions, a float stands for the simplest one within one part in 10**9
of it; where their common denominator exceeds 2**96 they are rounded to that many parts.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, prepare

BLOCK_SIZE = 64
TEMPERATURE = 0.7
GRAIN = 1 << 20
RANGE_SLOTS = 1 << 16
MOST_PARTS = 1 << 96
LEAST_SHARD = 1024
MOST_SHARDS = 10_000
MOST_BROADCAST = 100_000


def exact_weight(weight) -> Fraction:
    """The weight as a fraction; 0 for what is no weight."""
    if weight is None or isinstance(weight, float) and not math.isfinite(weight):
        return Fraction(0)
    if not isinstance(weight, float):
        return max(Fraction(weight), Fraction(0))
    exact = Fraction(max(weight, 0.0))
    size = 1
    while exact and abs((near := exact.limit_denominator(size)) - exact) > exact / 10**9:
        size *= 2
    return near if exact else exact


def whole_weights(weights: dict[str, object]) -> dict[str, int]:
    """Weights over a common denominator; sources without a weight are left out."""
    exact = {n: w for n, v in weights.items() if (w := exact_weight(v)) > 0}
    scale = 1
    for w in exact.values():
        scale = math.lcm(scale, w.denominator)
        if scale > MOST_PARTS:
            total = sum(exact.values())
            return {n: max(1, round(w / total * MOST_PARTS)) for n, w in exact.items()}
    whole = {n: int(w * scale) for n, w in exact.items()}
    common = math.gcd(*whole.values()) if whole else 1
    return {n: k // common for n, k in whole.items()}


@dataclass
class Phase:
    """Ranges in which the same sources share: (name, weight, units left, units before) each, in
    the order in which shares are added up."""

    first_range: int
    ranges: int
    slots: int
    members: list[tuple[str, int, int, int]]

    def taken(self, t: int) -> list[int]:
        """Units of each member in the first ``t`` ranges, more than it may have left included."""
        total, upto, before, out = sum(m[1] for m in self.members), 0, 0, []
        for _, w, *_ in self.members:
            upto += w
            now = upto * self.slots * t // total
            out.append(now - before)
            before = now
        return out

    def scheduled(self, t: int) -> Iterator[tuple[str, int, int, int, int]]:
        """(name, unit, slot, release, deadline) of range ``t``, earliest deadline first; the
        times count from the beginning of the first phase."""
        waiting: list[tuple[int, int, str, int]] = []
        start = (self.first_range + t) * self.slots
        for (name, _, left, before), a, b in zip(self.members, self.taken(t), self.taken(t + 1), strict=True):
            quota = b - a
            waiting += [(j * self.slots // quota, -(-(j + 1) * self.slots // quota), name, before + a + j) for j in range(min(quota, left - a))]
        waiting.sort()
        ready: list[tuple[int, str, int, int]] = []
        at = slot = 0
        while at < len(waiting) or ready:
            if not ready:
                slot = max(slot, waiting[at][0])
            while at < len(waiting) and waiting[at][0] <= slot:
                release, due, name, unit = waiting[at]
                heapq.heappush(ready, (due, name, unit, release))
                at += 1
            due, name, unit, release = heapq.heappop(ready)
            if due <= slot:
                raise AssertionError("a feasible schedule missed a deadline")
            yield name, unit, start + slot, start + release, start + due
            slot += 1


@dataclass
class Level:
    """A schedule of some sources. ``nested`` is that of the small ones, which stand in this one as
    the source ``group``; ``first_slot`` is where it begins."""

    phases: list[Phase]
    group: str | None
    nested: Level | None
    units: int
    first_slot: int = 0

    @property
    def depth(self) -> int:
        return 1 + (self.nested.depth if self.nested else 0)

    @property
    def last_slot(self) -> int:
        return self.first_slot + sum(p.ranges * p.slots for p in self.phases)


def level(weights: dict[str, int], units: dict[str, int], slots: int = RANGE_SLOTS, number: int = 0) -> Level:
    """The schedule of ``units`` to ``weights``, in ranges of ``slots`` slots, or of a few more
    than there are sources."""
    slots = max(slots, 1 << (4 * max(1, len(weights)) - 1).bit_length())
    total = sum(weights.values())
    small = {n: w for n, w in weights.items() if w * slots < 2 * total}
    group, nested = None, None
    if len(small) > 1:
        group, nested = f"={number}", level(small, {n: units[n] for n in small}, slots, number + 1)
        weights = {group: sum(small.values())} | {n: w for n, w in weights.items() if n not in small}
        units = {group: nested.units} | {n: u for n, u in units.items() if n not in small}
    first = group or next(iter(small), None)
    left = {n: u for n, u in units.items() if u}
    phases: list[Phase] = []
    began, before = 0, dict.fromkeys(left, 0)
    while left:
        order = sorted(left, key=lambda n: (n != first, n))
        total, gone, ends = sum(weights[n] for n in left), 0, 0
        for n in sorted(left, key=lambda n: (Fraction(left[n], weights[n]), n)):
            gone, ends = gone + weights[n], -(-left[n] * total // (weights[n] * slots))
            if 2 * gone >= total:
                break
        phase = Phase(began, max(1, ends), slots, [(n, weights[n], left[n], before[n]) for n in order])
        phases.append(phase)
        began += phase.ranges
        for n, k in zip(order, phase.taken(phase.ranges), strict=True):
            k = min(k, left[n])
            before[n], left[n] = before[n] + k, left[n] - k
        left = {n: u for n, u in left.items() if u}
    return Level(phases, group, nested, sum(units.values()))


def _plan(spark, own: Level) -> DataFrame:
    """(key, unit, slot, release, deadline) of all units of a level; tasks take ranges."""
    firsts = [p.first_range for p in own.phases]
    phases, shift = own.phases, own.first_slot

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch["id"]:
                phase = next(p for p, f in zip(reversed(phases), reversed(firsts)) if f <= r)
                rows = list(phase.scheduled(int(r) - phase.first_range))
                yield pd.DataFrame([(n, u, shift + s, shift + a, shift + b) for n, u, s, a, b in rows], columns=["key", "unit", "slot", "release", "deadline"])

    ranges = sum(p.ranges for p in own.phases)
    each = spark.range(ranges).repartition(min(max(1, ranges), MOST_SHARDS))
    plan = each.mapInPandas(run, "key string, unit long, slot long, release long, deadline long")
    if own.nested is None:
        return materialize(plan, "mix-plan")
    plan = materialize(plan, "mix-plan")
    # The n-th unit of the group is the n-th unit that its members get among themselves.
    inner = _plan(spark, own.nested)
    by_range = inner.withColumn("_range", F.expr(f"slot div {own.nested.phases[0].slots}")) if own.nested.phases else inner.withColumn("_range", F.lit(0))
    sizes = materialize(by_range.groupBy("_range").agg(F.count(F.lit(1)).alias("n")), "mix-ranges")
    offsets = sizes.select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("_before"))  # a row a range
    nth = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy("slot")) - 1
    members = by_range.join(offsets, "_range").select("key", "unit", nth.alias("_nth"))
    outer = plan.filter(F.col("key") == own.group).select(F.col("unit").alias("_nth"), "slot", "release", "deadline")
    dealt = members.join(outer, "_nth").select("key", "unit", "slot", "release", "deadline")
    return plan.filter(F.col("key") != own.group).unionByName(dealt)


def _source_key(source):
    """Text that tells a null source from any name."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def temperature_weights(counts: dict[str, int], temperature: float = TEMPERATURE, grain: int = GRAIN) -> dict[str, int]:
    """Target weights that follow ``rows ** temperature``, in whole parts of about ``grain``
    parts in all, at least one."""
    flat = {k: float(n) ** temperature for k, n in counts.items()}
    total = sum(flat.values())
    return {k: max(1, round(grain * x / total)) for k, x in flat.items()}


def schedule(counts: dict[str, int], target: dict[str, object], block_size: int, slots: int = RANGE_SLOTS) -> tuple[list[Level], int]:
    """(levels, rows of a unit): the sources with a weight, and behind them those without."""
    whole = whole_weights({k: target.get(k) for k in counts})
    tiers = [whole, dict.fromkeys((k for k in counts if k not in whole), 1)]
    made, rows = [], 1
    depth = max((level(w, dict.fromkeys(w, 1), slots).depth for w in tiers if w), default=1)  # by the weights alone
    rows = max(1, block_size // (2 * depth))
    at = 0
    for tier in tiers:
        if tier:
            own = level(tier, {k: -(-counts[k] // rows) for k in tier}, slots)
            own.first_slot = at
            at = own.last_slot
            made.append(own)
    return made, rows


def mix_sources(docs: DataFrame, weights: dict[str | None, object] | None = None, id_col: str = "doc_id", source_col: str = "source", block_size: int = BLOCK_SIZE, temperature: float = TEMPERATURE, least_shard: int = LEAST_SHARD, slots: int = RANGE_SLOTS) -> DataFrame:
    """Place every row: id, source, source_row, block, release, deadline, slot, place.

    ``weights``: target weight by source name (None: the null source) as int, Fraction or
    float; without them see :func:`temperature_weights`. ``slot`` is that of the row's unit,
    ``place`` orders rows inside a slot.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source")).withColumn("key", _source_key(F.col("source")))
    counts = {r.key: r.n for r in rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a source
    target = temperature_weights(counts, temperature) if weights is None else {("-" if k is None else f"+{k}"): w for k, w in weights.items()}
    levels, unit_rows = schedule(counts, target, block_size, slots)
    columns = "key string, unit long, slot long, release long, deadline long"
    plan = spark.createDataFrame([], columns)
    for own in levels:
        plan = plan.unionByName(_plan(spark, own))

    # A source may hold a third of all rows: number rows inside (source, shard) and add offsets.
    # A shard holds about a 10,000th of all rows, so no more than that many offsets are added up.
    shard_rows = max(least_shard, sum(counts.values()) // MOST_SHARDS)
    sources = spark.createDataFrame(list(counts.items()), "key string, n long")
    shards = F.ceil(F.col("n") / shard_rows).cast("long")
    sources = F.broadcast(sources) if len(counts) <= MOST_BROADCAST else sources  # else a join whose hot keys Spark splits
    rows = rows.join(sources, "key").withColumn("shard", F.pmod(F.xxhash64("id"), shards))
    sizes = materialize(rows.groupBy("key", "shard").agg(F.count(F.lit(1)).alias("rows")), "mix-sizes")
    offsets = sizes.select("key", "shard", (F.sum("rows").over(Window.partitionBy("key").orderBy("shard")) - F.col("rows")).alias("before"))
    local = F.row_number().over(Window.partitionBy("key", "shard").orderBy(F.col("id").asc_nulls_first()))
    numbered = rows.withColumn("local", local).join(offsets, ["key", "shard"]).withColumn("source_row", F.col("before") + F.col("local") - 1)
    placed = numbered.withColumn("unit", F.expr(f"source_row div {unit_rows}")).join(plan, ["key", "unit"])
    return placed.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "source_row", F.expr(f"source_row div {block_size}").alias("block"),
        "release", "deadline", "slot", F.expr(f"source_row % {unit_rows}").alias("place"),
    )


def positions(docs: DataFrame, weights: dict[str | None, object] | None = None, id_col: str = "doc_id", source_col: str = "source", block_size: int = BLOCK_SIZE, **options) -> DataFrame:
    """(id, position): the place of each id in the schedule. A repeated id takes its first."""
    placed = mix_sources(docs, weights, id_col, source_col, block_size, **options)
    return placed.groupBy(id_col).agg(F.min(F.col("slot") * block_size + F.col("place")).alias("position"))


def mixed_documents(docs: DataFrame, weights: dict[str | None, object] | None = None, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """``docs`` itself in the order of the schedule: range-partitioned and sorted by slot."""
    at = positions(docs, weights, id_col, source_col, **options).select(F.col(id_col).alias("_mix_id"), F.col("position").alias("_mix_at"))
    joined = docs.join(at, docs[id_col].eqNullSafe(at["_mix_id"]))
    return joined.repartitionByRange("_mix_at").sortWithinPartitions("_mix_at").select(*[docs[c] for c in docs.columns])
