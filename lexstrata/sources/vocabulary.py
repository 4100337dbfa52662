"""Vocabularies kept as JSON lines: tags, glossary terms, forbidden phrases.

Reading forgives: lines that are no JSON, or miss a required field, are left out. Of
entries with one key, the last in file order stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "taxonomy": ("tag string, group string, exclusive boolean, names map<string,string>", ("tag", "group")),
    "glossary": ("german_term string, render string, explanation string, keep_german boolean", ("german_term",)),
    "phrases": ("phrase string, lang string, category string", ("phrase", "lang")),
}


def read_vocabulary(spark: SparkSession, path: str, kind: str) -> DataFrame:
    schema, required = SCHEMAS[kind]
    lines = spark.read.text(path).select(F.col("value"), F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("_at"))
    rows = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("e"), "_at")
    for c in required:
        rows = rows.filter(F.coalesce(F.btrim(F.col(f"e.{c}")), F.lit("")) != "")
    return rows.groupBy(*[F.col(f"e.{c}").alias(c) for c in required]).agg(F.max_by("e", "_at").alias("e")).select("e.*")


def expected_rendering(entry_german, render, keep_german):
    """What a translation must contain for a term: the term itself, or its rendering."""
    return F.when(F.coalesce(keep_german, F.lit(False)), entry_german).otherwise(render)
