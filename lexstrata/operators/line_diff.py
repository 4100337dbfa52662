"""Shortest edit scripts between versions, hunks of them, and where each line came from.

Two versions meet by their key; a task aligns the lines of one pair. Alignment is a longest common
subsequence over whole lines, found with one machine word for 64 lines: common heads and tails are
set aside, small pairs are traced directly, large ones are halved first, so memory stays linear.
Everything behind it (scripts, hunks, unified text, provenance) is windows, joins and folds of
columns.

Defined cases: a null text has no lines and an empty one has one empty line; a key on one side only
is added or removed as a whole; of rows that repeat a key on one side the largest text counts; rows
without a key are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship_package

TRACED_BITS = 1 << 25
CONTEXT = 3


def _common_rows(a: list[int], b: list[int]) -> list[int]:
    """One integer a prefix of ``a``: bit j is 0 where the common subsequence with ``b`` grows
    from j to j + 1 lines of ``b``."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, [full]
    for x in a:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    return rows


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the common subsequence of ``a`` and each prefix of ``b``."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of places of equal lines, as many as can be, in order on both sides."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i0, i1, j0, j1 = stack.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        n, m = i1 - i0, j1 - j0
        if not n or not m:
            continue
        if n * m <= TRACED_BITS or n == 1:
            rows = _common_rows(a[i0:i1], b[j0:j1])
            i, j = n, m
            while i and j:
                if a[i0 + i - 1] == b[j0 + j - 1]:
                    i, j = i - 1, j - 1
                    out.append((i0 + i, j0 + j))
                elif rows[i] >> (j - 1) & 1:
                    j -= 1
                else:
                    i -= 1
            continue
        half = i0 + n // 2
        ahead, behind = _lengths(a[i0:half], b[j0:j1]), _lengths(a[half:i1][::-1], b[j0:j1][::-1])
        cut = j0 + int(np.argmax(ahead + behind[::-1]))
        stack += [(i0, half, j0, cut), (half, i1, cut, j1)]
    return sorted(out)


def lines_of(text: Column) -> Column:
    return F.coalesce(F.split(text, "\n", -1), F.array().cast("array<string>"))


def kept_lines(old: Column, new: Column) -> Column:
    """For each line of ``new`` (both arrays of lines) the place of the line of ``old`` that it
    is, or -1. The result is a column that Python tasks compute from lines' hashes."""

    def align(olds: pd.Series, news: pd.Series) -> pd.Series:
        def one(a, b) -> list[int]:
            out = [-1] * len(b)
            for i, j in aligned(a.tolist(), b.tolist()):
                out[j] = i
            return out

        return pd.Series([one(a, b) for a, b in zip(olds, news, strict=True)])

    hashed = lambda lines: F.transform(lines, lambda x: F.xxhash64(x))
    ship_package()
    return F.pandas_udf(align, "array<int>")(hashed(old), hashed(new))


def _one_side(rows: DataFrame, key: str, text: str, name: str) -> DataFrame:
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(text).alias(name), F.lit(True).alias(f"has_{name}"))


def edit_script(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """key, place, op ('=', '-' or '+'), old_no, new_no, line of the keys whose texts differ.

    Numbers count from 1; removed lines stand before added ones. Read with '=' and '-' the
    rows are the old text, with '=' and '+' the new one, and no script has fewer changes.
    """
    both = _one_side(old, key, text, "old").join(_one_side(new, key, text, "new"), key, "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
    rows = both.select(key, lines_of(F.col("old")).alias("a"), lines_of(F.col("new")).alias("b"))
    rows = rows.withColumn("kept", kept_lines(F.col("a"), F.col("b")))
    # A kept or added line stands behind the old lines before its anchor: the last kept one.
    by_new = rows.select(key, F.posexplode("b").alias("j", "line"), F.col("kept").alias("kept"))
    by_new = by_new.select(key, "j", "line", F.get("kept", F.col("j")).alias("i"))
    by_old = rows.select(key, F.posexplode("a").alias("i", "line"), F.col("kept").alias("kept"))
    gone = by_old.join(by_new.filter("i >= 0").select(key, "i"), [key, "i"], "left_anti").select(key, "i", "line")
    no = lambda c: (F.col(c) + 1).cast("int")
    kind = lambda o: F.lit(o).alias("op")
    script = (
        by_new.filter("i >= 0").select(key, kind("="), no("i").alias("old_no"), no("j").alias("new_no"), "line")
        .unionByName(by_new.filter("i < 0").select(key, kind("+"), F.lit(None).cast("int").alias("old_no"), no("j").alias("new_no"), "line"))
        .unionByName(gone.select(key, kind("-"), no("i").alias("old_no"), F.lit(None).cast("int").alias("new_no"), "line"))
    )
    # The kept line before each line on its own side names the gap it stands in.
    on_old = Window.partitionBy(key).orderBy(F.col("old_no").asc_nulls_last(), "new_no").rowsBetween(Window.unboundedPreceding, 0)
    on_new = Window.partitionBy(key).orderBy(F.col("new_no").asc_nulls_last(), "old_no").rowsBetween(Window.unboundedPreceding, 0)
    anchor = lambda w: F.coalesce(F.max(F.when(F.col("op") == "=", F.col("old_no"))).over(w), F.lit(0))
    gap = F.when(F.col("op") == "+", anchor(on_new)).otherwise(anchor(on_old))
    order = Window.partitionBy(key).orderBy("_gap", F.when(F.col("op") == "=", 0).when(F.col("op") == "-", 1).otherwise(2), F.coalesce("old_no", "new_no"))
    return script.withColumn("_gap", gap).withColumn("place", F.row_number().over(order)).select(key, "place", "op", "old_no", "new_no", "line")


def hunks(script: DataFrame, key: str, context: int = CONTEXT) -> DataFrame:
    """key, hunk, header, body: changes with ``context`` lines around them; changes whose
    context meets share a hunk, as in a unified diff."""
    by = Window.partitionBy(key).orderBy("place")
    changed = F.when(F.col("op") != "=", F.col("place"))
    before = F.last(changed, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(changed, ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing))
    near = script.withColumns({"_b": before, "_a": after}).filter((F.col("place") - F.col("_b") <= context) | (F.col("_a") - F.col("place") <= context))
    starts = F.coalesce((F.col("place") - F.lag("place").over(by) > 1).cast("int"), F.lit(0))
    numbered = near.withColumn("_s", starts).withColumn("hunk", F.sum("_s").over(by) + 1)
    # A side without lines in the hunk counts from the line before it.
    seen = lambda c: F.coalesce(F.max(c).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    whole = script.select(key, "place", seen("old_no").alias("_old"), seen("new_no").alias("_new"))
    marked = numbered.join(whole, [key, "place"]).withColumn("text", F.concat(F.when(F.col("op") == "=", " ").otherwise(F.col("op")), "line"))
    grouped = marked.groupBy(key, "hunk").agg(
        F.coalesce(F.min("old_no"), F.min("_old")).alias("o"), F.count("old_no").alias("on"), F.coalesce(F.min("new_no"), F.min("_new")).alias("n"), F.count("new_no").alias("nn"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n").alias("body"),
    )
    side = lambda sign, start, count: F.concat(F.lit(sign), F.col(start).cast("string"), F.when(F.col(count) == 1, "").otherwise(F.concat(F.lit(","), F.col(count).cast("string"))))
    return grouped.select(key, "hunk", F.concat(F.lit("@@ "), side("-", "o", "on"), F.lit(" "), side("+", "n", "nn"), F.lit(" @@")).alias("header"), "body")


def replayed(script: DataFrame, key: str) -> DataFrame:
    """key, old, new: both texts as the script gives them; a side without lines is null."""
    text = lambda no: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(no).isNotNull(), F.struct(no, "line")))), lambda x: x["line"]), "\n")
    of = lambda no: F.when(F.count(no) > 0, text(no))
    return script.groupBy(key).agg(of("old_no").alias("old"), of("new_no").alias("new"))


def provenance(versions: DataFrame, key: str, text: str, version: str) -> DataFrame:
    """key, line_no (from 1), origin (the version that brought the line), line: of each key's
    last version. A line that goes and comes back is brought by the version it came back in.

    Each version is aligned with the one before; then one fold over a key's versions, of line
    numbers only, carries every line's origin along.
    """
    by = Window.partitionBy(key).orderBy(version)
    rows = versions.filter(F.col(key).isNotNull() & F.col(version).isNotNull()).select(key, version, lines_of(F.col(text)).alias("b"))
    pairs = rows.withColumns({"a": F.coalesce(F.lag("b").over(by), F.array().cast("array<string>")), "last": F.lead(version).over(by).isNull()})
    steps = pairs.select(key, version, kept_lines(F.col("a"), F.col("b")).alias("kept"), F.when(F.col("last"), F.col("b")).alias("lines"))
    chain = steps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(version).alias("v"), "kept"))).alias("chain"), F.max("lines").alias("lines"))
    kind = versions.schema[version].dataType.simpleString()
    origin = F.aggregate("chain", F.array().cast(f"array<{kind}>"), lambda known, s: F.transform(s["kept"], lambda k: F.when(k < 0, s["v"]).otherwise(F.get(known, k))))
    found = chain.select(key, F.posexplode(F.arrays_zip(origin.alias("origin"), F.col("lines").alias("line"))).alias("_n", "x"))
    return found.select(key, (F.col("_n") + 1).alias("line_no"), F.col("x.origin").alias("origin"), F.col("x.line").alias("line"))
