"""Null and repeated ids, empty and null texts, and clashing columns for the row-wise operators."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

TEXTS = ["a b c d e f g h i j k l", "a b c d e f g h i j k l", None, "", "zorg " * 3000, "a b c d e f g h i j k l"]
IDS = [1, 1, None, 2, 3, None]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "s") for i, t in zip(IDS, TEXTS)]
    clash = ["row", "piece", "length", "position", "shard", "score", "ratio", "kept", "path", "fold", "y", "segments"]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in clash})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (None, 1, 1), (2, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int")


def ids_of(df):
    return Counter(str(r.doc_id) for r in df.select("doc_id").collect())


def test_token_output_packs_rows_one_by_one(docs):
    from lexstrata.llm.token_output import token_output

    rows = token_output(docs).collect()
    assert Counter(str(r.doc_id) for r in rows if r.piece == 0) == Counter(map(str, IDS))
    assert Counter(r.piece for r in rows if r.doc_id == 3) == Counter(range(len([r for r in rows if r.doc_id == 3])))


def test_packing_packs_rows_one_by_one(spark, docs):
    from lexstrata.llm.mixing import positions
    from lexstrata.llm.packing import pack

    order = positions(docs)
    assert ids_of(order) == Counter(["1", "2", "3", "None"])
    for given in (None, order, order.filter("doc_id = 2")):
        rows = pack(docs, order=given).collect()
        assert Counter(str(r.doc_id) for r in rows if r.piece == 0) == Counter(map(str, IDS))
        taken = Counter()
        for r in rows:
            taken[r.sequence_id] += r.length
        assert max(taken.values()) <= 1024 and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_quality_and_toxicity_judge_rows_one_by_one(docs, labels):
    from lexstrata.llm.quality import quality_rules
    from lexstrata.llm.toxicity import drop_toxic, score_toxicity

    judged = quality_rules(docs, labels)
    assert ids_of(judged) == Counter(map(str, IDS)) and judged.filter("n_words = 0 and not kept").count() == 2
    scored = score_toxicity(docs, labels)
    assert ids_of(scored) == Counter(map(str, IDS)) and scored.filter("score is null").count() == 0
    assert drop_toxic(docs, labels).columns == docs.columns
