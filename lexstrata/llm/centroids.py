"""Exact centroid clustering that skips most distances (Shallot search).

How it works
------------
A vector carries, from round to round, its nearest and second-nearest centroid, an upper bound on
the distance to the former and a lower bound on the distance to all others. After centroids moved,
the bounds move by as much. Where the upper bound stays below the lower one, or below half the way
to the nearest other centroid, the vector keeps its centroid without a distance. Else the distances
to both remembered centroids are taken, the scan starts at the closer one and goes through that
centroid's neighbours in order of distance, inside a ball of the distance to the start plus that to
the second-best found so far: each better second shrinks the ball, and the scan of a vector ends at
the first neighbour outside. What survives is compared by whole squared distances, so ties go to the
smaller number whatever the bounds' rounding; bounds are used with a margin far above it.

A round is one pass over the table of vectors and bounds, written to the shared folder; the table
of the round before is deleted then. Cluster sums are SQL aggregates, at most k rows for the driver.

Defined cases: rows whose vector is null, has another number of components, or a null or non-finite
one are left out; repeated rows count each; a null id hashes as the text 'null', and of equal ids
the smaller vector comes first; fewer rows than centroids give fewer centroids; an empty table gives
an empty result; other columns are never touched. Whole components beyond 2**27 are an error: their
squared distances do not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove_path, work_path

DIMENSIONS = 64
CENTROIDS = 40
ROUNDS = 5
SEED = 2
SCALE = 256
LARGEST = 1 << 27
MARGIN = 1e-7
STATE = "vec_id {id_type}, vector array<long>, cluster int, second int, upper double, lower double, distance long"


def whole_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, vector) of the rows with ``dimensions`` finite components, as floor(256 * x)."""
    finite = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    read = table.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.size("v") == dimensions).filter(finite)
    return read.select("vec_id", F.transform("v", lambda x: F.floor(x * SCALE)).alias("vector"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes of their ids, in that order."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    return np.array([r.vector for r in vectors.select(drawn.alias("h"), "vector").orderBy("h", "vector").limit(k).collect()], np.int64)


class Search:
    """One assignment of vectors to ``centroids``, given what they remember of the last one.

    ``moved`` holds how far each centroid has moved since; None stands for no memory.
    """

    def __init__(self, centroids: np.ndarray, moved: np.ndarray | None) -> None:
        self.centroids = centroids
        k = len(centroids)
        self.apart = np.sqrt(((centroids[:, None] - centroids[None]) ** 2).sum(2).astype(float))
        others = self.apart + np.diag(np.full(k, np.inf))
        self.half = others.min(1) / 2 if k > 1 else np.full(k, np.inf)
        self.neighbours = np.argsort(others, 1, kind="stable")[:, : k - 1]
        self.moved = moved
        if moved is not None:
            top = np.argsort(-moved, kind="stable")[:2]
            self.drift = np.where(np.arange(k) == top[0], moved[top[1]] if k > 1 else 0.0, moved[top[0]])

    def squared(self, vectors: np.ndarray, which: np.ndarray) -> np.ndarray:
        return ((vectors - self.centroids[which]) ** 2).sum(1)

    def assign(self, x: np.ndarray, near: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
        """(nearest, second, upper, lower) of the vectors ``x``; the arrays given are changed."""
        if len(self.centroids) == 1:
            near[:], second[:], upper[:], lower[:] = 0, 0, np.inf, np.inf
            return near, second, upper, lower
        if self.moved is None:
            near[:], second[:], open_ = 0, 1, np.arange(len(x))
        else:
            upper += self.moved[near]
            lower -= self.drift[near]
            open_ = np.flatnonzero(self._unsure(upper, np.maximum(lower, self.half[near])))
            exact = np.sqrt(self.squared(x[open_], near[open_]).astype(float))
            upper[open_] = exact
            open_ = open_[self._unsure(exact, np.maximum(lower[open_], self.half[near[open_]]))]
        if len(open_):
            self._scan(x, open_, near, second, upper, lower)
        return near, second, upper, lower

    @staticmethod
    def _unsure(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return low * (1 + MARGIN) + MARGIN >= high

    def _scan(self, x: np.ndarray, rows: np.ndarray, near: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        v, a, b = x[rows], near[rows], second[rows]
        da, db = self.squared(v, a), self.squared(v, b)
        swap = (db < da) | ((db == da) & (b < a))
        a, b, da, db = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, db, da), np.where(swap, da, db)
        start, reach, remembered = a.copy(), np.sqrt(da.astype(float)), b.copy()
        live = np.arange(len(rows))
        for rank in range(self.neighbours.shape[1]):
            c = self.neighbours[start[live], rank]
            inside = ~((reach[live] + np.sqrt(db[live].astype(float))) * (1 + MARGIN) + MARGIN < self.apart[start[live], c])
            live, c = live[inside], c[inside]
            if not len(live):
                break
            new = c != remembered[live]
            at, c = live[new], c[new]
            d = self.squared(v[at], c)
            first = (d < da[at]) | ((d == da[at]) & (c < a[at]))
            next_ = ~first & (d < db[at])
            i = at[first]
            b[i], db[i], a[i], da[i] = a[i], da[i], c[first], d[first]
            i = at[next_]
            b[i], db[i] = c[next_], d[next_]
        near[rows], second[rows], upper[rows], lower[rows] = a, b, np.sqrt(da.astype(float)), np.sqrt(db.astype(float))


def _batches(centroids: np.ndarray, moved: np.ndarray | None, last: bool):
    """The pass over Arrow batches, as Spark calls it in its tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids, moved)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            if np.abs(x).max() > LARGEST or x.min() < -LARGEST:
                raise ValueError(f"a component is beyond {LARGEST}")
            if moved is None:
                known = [np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n)]
            else:
                known = [batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("cluster", "second", "upper", "lower")]
            near, second, upper, lower = search.assign(x, *known)
            distance = search.squared(x, near) if last else np.zeros(n, np.int64)
            columns = [batch.column("vec_id"), batch.column("vector"), *map(pa.array, (near.astype(np.int32), second.astype(np.int32), upper, lower, distance))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "vector", "cluster", "second", "upper", "lower", "distance"])

    return run


def _moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floors of the means, exact: sums of the upper and lower halves of the components fit longs."""
    dims = centroids.shape[1]
    x = [F.get("vector", F.lit(i)) for i in range(dims)]
    halves = [F.sum(F.shiftright(c, 16)).alias(f"h{i}") for i, c in enumerate(x)] + [F.sum(c.bitwiseAND(F.lit(65535))).alias(f"l{i}") for i, c in enumerate(x)]
    out = centroids.copy()
    for r in state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *halves).collect():  # at most one row a centroid
        out[r.cluster] = [((r[f"h{i}"] << 16) + r[f"l{i}"]) // r.n for i in range(dims)]
    return out


def cluster_vectors(table: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, vector, cluster, distance), centroids) after ``rounds`` rounds and a last assignment."""
    spark: SparkSession = table.sparkSession
    state = whole_vectors(table, id_col, vector_col, dimensions)
    schema = STATE.format(id_type=state.schema["vec_id"].dataType.simpleString())
    centroids = first_centroids(state, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], schema).select("vec_id", "vector", "cluster", "distance"), centroids
    moved, before = None, None
    for r in range(rounds + 1):
        path = work_path(spark, "centroids")
        state.mapInArrow(_batches(centroids, moved, r == rounds), schema).write.parquet(path)
        state = spark.read.schema(schema).parquet(path)
        if before:
            remove_path(spark, before)
        before = path
        if r < rounds:
            after = _moved_centroids(state, centroids)
            moved = np.sqrt(((after - centroids) ** 2).sum(1).astype(float))
            centroids = after
    return state.select("vec_id", "vector", "cluster", "distance"), centroids


def cluster_report(table: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    spark: SparkSession = table.sparkSession
    found, centroids = cluster_vectors(table)
    inertia = {r.cluster: r.d for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # at most one row a centroid
    total = sum(inertia.values())
    rows = [(c, d, total, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in inertia.items()]
    clusters = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
