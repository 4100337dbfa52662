"""A corpus pipeline: toxicity, exact dedup, near dedup, source mixing, packing.

Each stage takes all rows its predecessor kept; all but the last return the columns of
``documents``. The mixing stage orders its rows by schedule slot, and the packing stage
hands pieces out along the same schedule: read by ascending sequence id, the packed
sequences follow the target weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexstrata.llm.common import prepare, table, work_path
from lexstrata.llm.exact_dedup import keep_first_of_copies
from lexstrata.llm.mixing import mixed_documents, positions
from lexstrata.llm.near_dedup import keep_first_of_group
from lexstrata.llm.packing import pack
from lexstrata.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the clause grammar scores as toxic."""
    prepare(spark)
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the largest doc_id of equal texts."""
    return keep_first_of_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of texts linked at a similarity of 0.8."""
    prepare(spark)
    return keep_first_of_group(docs, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Order the rows by the Pfair schedule of their sources."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack whole documents into sequences of 1024 tokens, along the schedule of the sources."""
    prepare(spark)
    return pack(docs, order=positions(docs))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("minhash_near_dedup", near), ("mixing", mixing), ("best_fit_packing", packing)]

#: SQL cannot express learnt scores, MinHash groups and packing; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = work_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
