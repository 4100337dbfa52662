"""Derived tables as a graph: rebuilt from their sources in order, and compared with what is kept.

A definition names its inputs, sources or other tables, and a function of them. Tables are rebuilt in
topological order, each written once to the shared folder, so a table that several others read is
computed once. A fingerprint of a table is the number of its rows and the sum of their hashes: it
does not depend on order or partitions, and repeated rows count.

Defined cases: a definition that reads an unknown name, or a cycle, is an error that names it; a kept
table that is not there is ``missing``; one with other columns, rows or values ``differs``; columns
are compared by name; nulls and empty tables count as any other value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import shared_folder


@dataclass(frozen=True)
class Derived:
    inputs: tuple[str, ...]
    make: Callable[..., DataFrame]


def rebuild_order(graph: dict[str, Derived], sources: set[str]) -> list[str]:
    """Names of the derived tables, each behind its inputs; ties by name."""
    if unknown := sorted({i for t in graph.values() for i in t.inputs} - graph.keys() - sources):
        raise ValueError(f"unknown tables: {', '.join(unknown)}")
    sorter = TopologicalSorter({n: sorted(i for i in t.inputs if i in graph) for n, t in sorted(graph.items())})
    try:
        sorter.prepare()
    except CycleError as problem:
        raise ValueError(f"tables that derive from themselves: {' <- '.join(problem.args[1])}") from problem
    out: list[str] = []
    while sorter.is_active():
        ready = sorted(sorter.get_ready())
        out += ready
        sorter.done(*ready)
    return out


def rebuilt(graph: dict[str, Derived], sources: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every derived table, replayed from the sources."""
    done = dict(sources)
    for name in rebuild_order(graph, set(sources)):
        made = graph[name].make(*(done[i] for i in graph[name].inputs))
        path = shared_folder(made.sparkSession, f"derived-{name}")
        made.write.parquet(path)
        done[name] = made.sparkSession.read.schema(made.schema).parquet(path)
    return {n: t for n, t in done.items() if n in graph}


def fingerprint(table: DataFrame) -> tuple[int, str]:
    """(rows, sum of their hashes): one aggregate over the table."""
    columns = sorted(table.columns)
    row = F.xxhash64(*[F.struct(F.col(f"`{c}`")) for c in columns], F.lit("|".join(columns)))
    got = table.agg(F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(38,0)")).alias("h")).first()
    return got.n, str(got.h or 0)


def compared(spark: SparkSession, made: dict[str, DataFrame], kept: dict[str, DataFrame]) -> DataFrame:
    """table, rows, kept_rows, status (equal, differs, missing) of each derived table."""
    rows = []
    for name in sorted(made):
        n, h = fingerprint(made[name])
        if name not in kept:
            rows.append((name, n, None, "missing"))
            continue
        kept_n, kept_h = fingerprint(kept[name])
        rows.append((name, n, kept_n, "equal" if (n, h) == (kept_n, kept_h) else "differs"))
    return spark.createDataFrame(rows, "`table` string, rows long, kept_rows long, status string")
