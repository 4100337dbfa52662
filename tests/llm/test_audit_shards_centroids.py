"""Filter audit, histogram-sort shards and centroid search against brute force, with edges."""

import math
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexstrata.llm.centroids import Search, cluster_report, cluster_vectors
from lexstrata.llm.filter_audit import LETTERS, audit_orders, filter_audit, mask_counts, removal_intervals
from lexstrata.llm.sharding import shard_report, shard_rows, write_shards


def test_intervals_cover_each_order_once():
    for n in (1, 3, 5):
        ranks = list(permutations(range(n)))
        step_of = defaultdict(dict)
        for mask, step, lo, hi in removal_intervals(n):
            for rank in range(lo, hi):
                assert rank not in step_of[mask]
                step_of[mask][rank] = step
        for mask in range(1, 2**n):
            assert step_of[mask] == {r: 1 + next(i for i, f in enumerate(p) if mask >> f & 1) for r, p in enumerate(ranks)}


def test_intervals_are_merged():
    assert [x for x in removal_intervals(5) if x[0] == 31] == [(31, 1, 0, 120)]
    assert len(removal_intervals(5)) < 800


def test_audit_against_documents_removed_one_by_one(spark):
    rng = np.random.default_rng(3)
    rows = [(str(rng.integers(0, 3)), int(m), int(rng.integers(0, 2)), int(rng.integers(0, 2))) for m in rng.integers(0, 32, 300)]
    counts = spark.createDataFrame(rows, "part string, mask int, g int, t int").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("g").alias("n_good"), F.sum("t").alias("n_toxic"))
    got = {(r.part, r.filter_order, r.step): r for r in audit_orders(counts).collect()}
    assert len(got) == 3 * 600
    total = Counter()
    for part in "012":
        for order in map("".join, permutations(LETTERS)):
            left, out = [r for r in rows if r[0] == part], []
            for step, f in enumerate(order, 1):
                bit = 1 << LETTERS.index(f)
                removed = [r for r in left if r[1] & bit]
                redundant, left, out = sum(1 for r in out if r[1] & bit), [r for r in left if not r[1] & bit], out + removed
                total[part, f] += len(removed)
                x = got[part, order, step]
                unique = sum(1 for r in rows if r[0] == part and r[1] == bit)
                assert (x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost) == (len(left), len(removed), redundant, unique, sum(r[2] for r in removed), sum(r[3] for r in removed))
    assert all(x.shapley == total[x.part, x.filter] for x in got.values())


def test_masks_of_edge_rows(spark):
    words = " ".join(f"w{i}" for i in range(200))
    rows = [(1, words, None), (2, words, ""), (None, words, "s"), (5, None, "s"), (4, "", "s"), (4, "", "s"), (6, "A$" + "b" * 40, "t"), (7, ("x " * 100_000).strip(), "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("part", "mask", "n", "id", "digest", "first", "good", "rank", "filter")})
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, None), (6, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {(r.part, r["mask"]): (r.n, r.n_good, r.n_toxic) for r in mask_counts(docs, labels).collect()}
    a, b, c, d, e = (1 << i for i in range(5))
    assert got == {("", 0): (1, 1, 1), ("", e): (1, 0, 0), ("s", 0): (1, 0, 0), ("s", a): (2, 0, 0), ("s", a + e): (1, 0, 0), ("t", a + c + d): (1, 0, 1), ("t", b): (1, 0, 0)}
    assert filter_audit(docs, labels).count() == 3 * 600
    assert filter_audit(docs.limit(0), labels).count() == 0


def made_documents(spark, n=3000, hot=1000):
    rng = np.random.default_rng(5)
    rows = [(i, "same text of a hot group" if i < hot else "y" * int(rng.integers(0, 400)) + str(i), "s") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)


def test_shards_are_even_and_slots_without_gaps(spark):
    rows = shard_report(made_documents(spark)).collect()
    taken, slots = Counter(), defaultdict(list)
    for r in rows:
        taken[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    mean, largest = sum(taken.values()) / 24, max(r["size"] for r in rows)
    assert sorted(taken) == list(range(24)) and all(abs(t - mean) <= 2 * (0.001 * mean + largest) for t in taken.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.doc_id for r in rows}) == len(rows) == 3000 and {r.law for r in rows} == {"bytes"}


def test_shards_follow_one_order_of_keys(spark):
    """Read by shard and slot, rows are in the order of their unsigned keys."""
    from lexstrata.llm.sharding import sort_key

    docs = made_documents(spark).withColumn("own", sort_key(F.col("text"), F.col("doc_id")))
    for blocks in (None, 40, 10_000):
        rows = sorted(shard_rows(docs, block_rows=blocks).collect(), key=lambda r: (r.shard, r.slot))
        keys = [r.own & (2**64 - 1) for r in rows]
        assert keys == sorted(keys)
        assert max(i for i, r in enumerate(rows) if r.text.startswith("same")) - min(i for i, r in enumerate(rows) if r.text.startswith("same")) == 999


def test_shards_do_not_depend_on_partitions(spark):
    docs = made_documents(spark)
    one, two = ({(r.doc_id, r.shard, r.slot) for r in shard_report(d).collect()} for d in (docs.coalesce(1), docs.repartition(11, "doc_id")))
    assert one == two


def test_written_shards_hold_runs_of_slots(spark, tmp_path):
    sharded = shard_rows(made_documents(spark), shards=3, file_bytes=20_000)
    write_shards(sharded, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).withColumn("name", F.input_file_name())
    assert back.count() == 3000 and set(back.columns) >= {"doc_id", "text", "source", "size", "shard", "slot", "file"}
    runs = back.groupBy("shard", "file").agg((F.max("slot") - F.min("slot") + 1).alias("span"), F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("names")).collect()
    assert len(runs) > 3 and all(r.span == r.n and r.names == 1 for r in runs)


def test_shards_of_edge_rows(spark):
    rows = [(1, None), (1, ""), (None, "é" * 50_000), (None, "é" * 50_000), (2, "x"), (2, "x"), (3, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("c") for c in ("size", "shard", "slot", "file", "_key2", "rows", "prefix", "law")})
    got = shard_report(docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter({(1, 8): 2, (None, 100_008): 2, (2, 9): 2, (3, 9): 1})
    assert len({(r.shard, r.slot) for r in got}) == len(rows)
    assert shard_report(docs.limit(0)).count() == 0


def plain_clusters(rows, k=40, rounds=5):
    """Every distance, in Python's integers."""
    import hashlib

    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    for r in range(rounds + 1):
        ways = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]
        if r < rounds:
            for j in range(len(centroids)):
                own = [v for (_, v), (_, n) in zip(kept, ways) if n == j]
                if own:
                    centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    return Counter((i, j, d) for (i, _), (d, j) in zip(kept, ways)), centroids


def test_clusters_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(11)
    grid = [[float(x) for x in rng.integers(-2, 3, 4)] + [0.0] * 60 for _ in range(260)]  # coarse: many ties and repeated vectors
    rows = list(enumerate(grid)) + [(900, None), (901, [1.0] * 63), (902, [None] * 64), (903, [float("nan")] * 64), (904, [float("inf")] * 64), (None, grid[0]), (5, grid[7]), (5, grid[7])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("c") for c in ("cluster", "distance", "vector", "v", "h", "upper")})
    expected, centroids = plain_clusters(rows)
    found, got = cluster_vectors(table.repartition(3))
    assert got.tolist() == centroids
    assert Counter((r.vec_id, r.cluster, r.distance) for r in found.collect()) == expected
    report = cluster_report(table).collect()
    assert len(report) == sum(expected.values()) and len({r.inertia for r in report}) == 1 and report[0].inertia == sum(d * n for (_, _, d), n in expected.items())


@pytest.mark.parametrize("n", [0, 1, 2, 39])
def test_clusters_of_few_rows(spark, n):
    rows = [(i, [i / 7] * 64) for i in range(n)]
    found, centroids = cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert len(centroids) == n and sorted(r.distance for r in found.collect()) == [0] * n
    assert cluster_report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count() == n


def test_clusters_of_large_components(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-(2**19), 2**19, 64)]) for i in range(80)]
    expected, centroids = plain_clusters(rows, rounds=2)
    found, got = cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rounds=2)
    assert got.tolist() == centroids and Counter((r.vec_id, r.cluster, r.distance) for r in found.collect()) == expected


def test_search_skips_most_distances():
    rng = np.random.default_rng(1)
    middles = rng.normal(0, 400, (40, 64))
    x = np.floor(np.repeat(middles, 100, 0) + rng.normal(0, 20, (4000, 64))).astype(np.int64)
    centroids = np.floor(middles).astype(np.int64)
    state = [np.zeros(4000, np.int32), np.zeros(4000, np.int32), np.zeros(4000), np.zeros(4000)]
    near, *_ = Search(centroids, None).assign(x, *state)
    moved = centroids + 1
    count = [0]

    class Counting(Search):
        def squared(self, vectors, which):
            count[0] += len(vectors)
            return super().squared(vectors, which)

    again, *_ = Counting(moved, np.sqrt(((moved - centroids) ** 2).sum(1).astype(float))).assign(x, *state)
    assert (again == ((x[:, None] - moved[None]) ** 2).sum(2).argmin(1)).all()
    assert count[0] < 4000  # of 160,000
