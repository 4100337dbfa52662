"""Ranked search against exhaustive scores; derived tables against what is kept."""

import math
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexstrata.operators import derived, search


def plain_search(documents, queries, k, synonyms=()):
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    docs = {i: split(t) for i, t in documents.items()}
    average = sum(map(len, docs.values())) / max(len(docs), 1) or 1.0
    holding = {}
    for i, ws in docs.items():
        for w in set(ws):
            holding.setdefault(w, set()).add(i)
    out = {}
    for q, text in queries.items():
        terms = set(split(text))
        terms |= {b for a, b in synonyms if a in terms} | {a for a, b in synonyms if b in set(split(text))}
        scores = {}
        for t in terms & holding.keys():
            rarity = math.log(1 + (len(docs) - len(holding[t]) + 0.5) / (len(holding[t]) + 0.5))
            for i in holding[t]:
                c = docs[i].count(t)
                scores[i] = scores.get(i, 0) + rarity * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(docs[i]) / average))
        out[q] = [(i, round(s, 6)) for i, s in sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]]
    return out


def found(spark, documents, queries, k, **options):
    index = search.build_index(spark.createDataFrame(list(documents.items()), "id long, text string"), "id", "text", options.pop("block_documents", 20))
    pairs = options.pop("synonyms", None)
    frame = spark.createDataFrame(pairs, "word string, synonym string") if pairs else None
    asked = spark.createDataFrame(list(queries.items()), "q string, text string")
    rows = search.search(index, asked, "q", "text", k, frame, **options).collect()
    got = {q: [] for q in queries}
    for r in sorted(rows, key=lambda r: (r.q, r.place)):
        got[r.q].append((r.id, round(r.score, 6)))
    assert all(r.place <= k for r in rows)
    return got, index


@pytest.mark.parametrize("first_blocks", [1, 4, 100])
def test_best_documents_are_those_of_all_blocks(spark, first_blocks):
    rng = random.Random(first_blocks)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    documents = {i: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))) for i in range(400)}
    documents |= {i: documents[7] for i in range(400, 420)}  # ties
    queries = {f"q{i}": " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 5))) for i in range(30)} | {"none": "zzz", "tied": documents[7][:40]}
    synonyms = [("w1", "w9"), ("w3", "w4")]
    got, index = found(spark, documents, queries, 5, synonyms=synonyms, first_blocks=first_blocks)
    assert got == plain_search(documents, queries, 5, synonyms)
    assert index.postings.groupBy("term", "block").count().agg(F.max("count")).first()[0] == 1 and index.postings.filter("term = 'w1'").count() > 15


def test_many_small_blocks(spark):
    rng = random.Random(5)
    documents = {i: "common " + ("rare " * 5 if i < 10 else "") + " ".join(f"x{rng.randrange(50)}" for _ in range(20)) for i in range(600)}
    got, _ = found(spark, documents, {"q": "rare common"}, 3, block_documents=10)
    assert got == plain_search(documents, {"q": "rare common"}, 3)


def test_odd_texts(spark):
    documents = {1: None, 2: "", 3: "Ärger-Ärger, ärger!", 4: "9 a_b"}
    queries = {"a": "ÄRGER", "b": "", "c": None, "d": "a 9", "e": "ärger ärger"}
    got, _ = found(spark, documents, queries, 2)
    assert [i for i, _ in got["a"]] == [3] == [i for i, _ in got["e"]] and got["a"] == got["e"] and got["b"] == got["c"] == [] and [i for i, _ in got["d"]] == [4]
    empty, _ = found(spark, {1: None}, queries, 2)
    assert all(v == [] for v in empty.values())


def test_queries_in_shares_meet_blocks_with_floors(spark):
    rng = random.Random(9)
    documents = {i: " ".join(["the"] * rng.randrange(1, 9) + [f"y{int(rng.paretovariate(0.5)) % 300}" for _ in range(rng.randrange(1, 30))]) for i in range(300)} | {i: "the y1 y2" for i in range(300, 330)}
    queries = {f"q{i}": "the " + " ".join(f"y{rng.randrange(40)}" for _ in range(3)) for i in range(40)}
    got, index = found(spark, documents, queries, 4, block_documents=64, share=7)
    assert got == plain_search(documents, queries, 4) and index.blocks == 6


def test_frequent_words_seed_no_documents_below_the_floor():
    postings = pd.DataFrame({"term": ["the", "rare"], "ids": [np.ones(100, np.int64), np.array([50, 1])], "counts": [np.ones(100, np.int32), np.ones(2, np.int32)], "lengths": [np.full(100, 5), np.full(2, 5)]})
    asked = pd.DataFrame({"query": ["q"], "terms": [["the", "rare"]], "rarities": [[0.1, 3.0]], "floor": [3.0]})
    rows = search.block_best(postings, asked, 10, 5.0)
    assert rows["id"].tolist() == [50, 51] and rows["score"].round(6).tolist() == [3.1, 3.1]
    assert search.block_best(postings, asked.assign(floor=0.0), 10, 5.0)["id"].tolist() == [50, 51, *range(1, 9)]
    assert search.block_best(postings, asked.assign(floor=3.2), 10, 5.0).empty


def shuffled_rows(spark, run):
    """What ``run`` returns, and the rows that its shuffles wrote."""
    sc, none = spark.sparkContext, spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = sc._jsc.sc().statusStore().stageList(None, False, False, none, spark._jvm.java.util.ArrayList())
        return {x.stageId(): x.shuffleWriteRecords() for x in (found.apply(i) for i in range(found.size()))}

    before, out = stages(), run()
    return out, sum(n for k, n in stages().items() if k not in before)


def test_disk_takes_neither_a_row_a_posting_nor_a_query_a_block(spark):
    rng = random.Random(3)
    documents = {i: " ".join(f"z{int(rng.paretovariate(0.6)) % 900}" for _ in range(40)) for i in range(1200)}
    queries = {f"q{i}": " ".join(f"z{rng.randrange(60)}" for _ in range(3)) for i in range(500)}
    rows = spark.createDataFrame(list(documents.items()), "id long, text string")
    index, moved = shuffled_rows(spark, lambda: search.build_index(rows, "id", "text", 10))
    assert moved < 3 * len(documents) and index.blocks == 120
    asked = spark.createDataFrame(list(queries.items()), "q string, text string")
    found_rows, moved = shuffled_rows(spark, lambda: search.search(index, asked, "q", "text", 2).collect())
    assert moved < len(queries) * index.blocks
    got = {q: [] for q in queries}
    for r in sorted(found_rows, key=lambda r: (r.q, r.place)):
        got[r.q].append((r.id, round(r.score, 6)))
    assert got == plain_search(documents, queries, 2)


def test_lists_of_a_block_join_its_batches():
    first = pa.RecordBatch.from_pydict({"block": pa.array([1, 1, 2], pa.int32()), "id": pa.array([5, -3, 4], pa.int64()), "words": [["b", "a", "b"], ["b"], ["c"]]})
    second = pa.RecordBatch.from_pydict({"block": pa.array([1, 3, 1], pa.int32()), "id": pa.array([2, 7, 8], pa.int64()), "words": pa.array([["a"], [], None], pa.list_(pa.string()))})
    rows = {(r["term"], r["block"]): (r["ids"], r["counts"], r["lengths"]) for batch in search.block_lists(iter([first, second])) for r in batch.to_pylist()}
    assert rows == {("b", 1): ([-3, 8], [1, 2], [1, 3]), ("a", 1): ([2, 3], [1, 1], [1, 3]), ("c", 2): ([4], [1], [1])}


def test_derived_tables_are_rebuilt_in_order(spark):
    graph = {
        "c": derived.Derived(("b", "a"), lambda b, a: b.join(a, "k").select("k", (F.col("m") + F.col("n")).alias("s"))),
        "b": derived.Derived(("a",), lambda a: a.groupBy("k").agg(F.sum("n").alias("m"))), "a": derived.Derived(("log",), lambda x: x.filter("n > 1")),
    }
    assert derived.rebuild_order(graph, {"log"}) == ["a", "b", "c"]
    log = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (None, 4), (2, 3)], "k int, n long")
    made = derived.rebuilt(graph, {"log": log})
    assert sorted(r.s for r in made["c"].collect()) == [4, 9, 9]
    kept = {"a": made["a"].repartition(4).select("n", "k"), "b": made["b"].withColumn("m", F.when(F.col("k") == 2, 7).otherwise(F.col("m")))}
    assert {r.table: (r.rows, r.kept_rows, r.status) for r in derived.compared(spark, made, kept).collect()} == {"a": (4, 4, "equal"), "b": (3, 3, "differs"), "c": (3, None, "missing")}
    assert derived.fingerprint(made["a"]) != derived.fingerprint(made["a"].distinct()) and derived.fingerprint(made["a"]) != derived.fingerprint(made["a"].withColumnRenamed("n", "z"))
    assert derived.fingerprint(made["a"].limit(0)) == (0, "0")


def test_wrong_graphs_are_named():
    with pytest.raises(ValueError, match="unknown tables: x"):
        derived.rebuild_order({"a": derived.Derived(("x",), lambda x: x)}, {"log"})
    loop = {"a": derived.Derived(("b",), lambda x: x), "b": derived.Derived(("a",), lambda x: x)}
    with pytest.raises(ValueError, match="derive from themselves"):
        derived.rebuild_order(loop, set())
