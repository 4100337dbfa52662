"""Which filter removes what, under every order of the filters.

How it works
------------
1. Each document becomes a mask: one bit per filter whose failure condition it meets. Only masks
   are counted, so nothing after the first aggregate grows with the number of documents.
2. All orders of the filters are ranked lexicographically (Lehmer code). A document is removed at
   the first filter in its mask, so the orders that share the prefix up to that filter form one
   interval of ranks. ``removal_intervals`` lists these intervals per mask, neighbours merged.
3. A mask's count is added at an interval's first rank and subtracted behind its last: a difference
   array per part and step. Prefix sums over the ranks give what each step removes in each order.
4. ``redundant`` is what fails the filter less what it removes; ``kept`` the total less all removals
   up to the step; ``shapley`` the removals of one filter, summed over all orders.

Copies are told apart without bringing a group together: rows are counted by (text digest, id),
then by (digest, part, labels), and only these counts meet their group's smallest id.

Defined cases: a null text counts as empty; a null source as the part ''; a row without an id is
never a later copy, and no row is a copy of it; rows that repeat an id and its text are the same
document and fail or pass alike; of several labels of one id the largest counts; an empty table
gives an empty result. Other columns are never touched.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, UPPER, materialize

LETTERS = "ABCDE"
MARKS = r"[#$%&*|]"
#: The filter that compares documents; the others look at one text.
COPIES = "E"


def row_failures(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters that look at one text."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    distinct = F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": F.size(words) < 200,
        "B": distinct * 100 < F.size(words) * 50,
        "C": capitals.cast("long") * 100 > F.length(text).cast("long") * 2,
        "D": text.rlike(MARKS),
    }


def removal_intervals(n: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank behind the last): the orders in which a document with this
    mask is removed at this step. Bit i of a mask stands for the i-th filter."""
    found: list[tuple[int, int, int, int]] = []

    def descend(mask: int, left: Sequence[int], step: int, rank: int) -> None:
        width = factorial(len(left) - 1)
        for smaller, f in enumerate(left):
            first = rank + smaller * width
            if not mask >> f & 1:
                descend(mask, [x for x in left if x != f], step + 1, first)
            elif found and found[-1][:2] == (mask, step) and found[-1][3] == first:
                found[-1] = (mask, step, found[-1][2], first + width)
            else:
                found.append((mask, step, first, first + width))

    for mask in range(1, 2**n):
        descend(mask, range(n), 1, 0)
    return found


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, n_good, n_toxic): documents by the set of filters that they fail."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    bits = [c.cast("int") * (1 << LETTERS.index(f)) for f, c in row_failures(F.col("text")).items()]
    flagged = read.select("id", "part", sum(bits[1:], bits[0]).alias("mask"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    judged = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    same = ["digest", "part", "mask", "good", "toxic"]
    by_id = flagged.join(judged, "id", "left").fillna(0, ["good", "toxic"]).groupBy("id", *same).agg(F.count(F.lit(1)).alias("n"))
    by_text = by_id.groupBy(*same).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first")
    )
    smallest = F.min("first.id").over(Window.partitionBy("digest"))
    firsts = F.when(F.col("first.id") == smallest, F.col("first.n")).otherwise(0)
    split = by_text.select("part", "mask", "good", "toxic", "n", (F.col("nameless") + firsts).alias("originals"))
    parts = F.explode(F.array(F.struct("mask", F.col("originals").alias("n")), F.struct((F.col("mask") + (1 << LETTERS.index(COPIES))).alias("mask"), (F.col("n") - F.col("originals")).alias("n"))))
    each = split.select("part", "good", "toxic", parts.alias("x")).select("part", "good", "toxic", "x.mask", "x.n").filter("n > 0")
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("n_good"), F.sum(F.col("n") * F.col("toxic")).alias("n_toxic"))


def audit_orders(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order of ``letters`` and step, from counts by mask.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley, filter. ``letters`` are in ascending order, at most seven or so: the
    rows a part grow with their factorial.
    """
    spark: SparkSession = counts.sparkSession
    n = len(letters)
    order_rows = [(r, "".join(p), s + 1, letters.index(f)) for r, p in enumerate(permutations(letters)) for s, f in enumerate(p)]
    orders = spark.createDataFrame(order_rows, "rank int, filter_order string, step int, f int")
    ends = [(m, s, at, sign) for m, s, lo, hi in removal_intervals(n) for at, sign in ((lo, 1), (hi, -1)) if at < factorial(n)]
    events = spark.createDataFrame(ends, "mask int, step int, rank int, sign int")

    changes = counts.join(F.broadcast(events), "mask").select("part", "rank", "step", *[(F.col(c) * F.col("sign")).alias(to) for c, to in (("n", "removed"), ("n_good", "good_lost"), ("n_toxic", "toxic_lost"))])
    bit = [F.lit(1 << i) for i in range(n)]
    totals = counts.groupBy("part").agg(
        F.sum("n").alias("total"),
        F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(b) != 0, F.col("n")).otherwise(0)) for b in bit]).alias("fails"),
        F.array(*[F.sum(F.when(F.col("mask") == b, F.col("n")).otherwise(0)) for b in bit]).alias("only"),
    )
    grid = totals.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(factorial(n) - 1)))).join(F.broadcast(orders), "rank")
    cells = grid.select("part", "rank", "step", "filter_order", "f", "total", F.get("fails", F.col("f")).alias("failing"), F.get("only", F.col("f")).alias("unique_fails"))
    both = cells.unionByName(changes, allowMissingColumns=True).repartition("part")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("removed", "good_lost", "toxic_lost")]
    dense = both.groupBy("part", "rank", "step").agg(*[F.max(c).alias(c) for c in ("filter_order", "f", "total", "failing", "unique_fails")], *sums)

    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    stepped = dense.withColumns({c: F.sum(c).over(along) for c in ("removed", "good_lost", "toxic_lost")})
    before = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return stepped.select(
        "part", "filter_order", "step", (F.col("total") - F.sum("removed").over(before)).alias("kept"), "removed", (F.col("failing") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", F.sum("removed").over(Window.partitionBy("part", "f")).alias("shapley"), F.substring(F.lit(letters), F.col("f") + 1, F.lit(1)).alias("filter"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over ``docs``, from one pass over the texts."""
    return audit_orders(materialize(mask_counts(docs, labels), "audit-counts"))
