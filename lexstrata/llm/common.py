"""Shared helpers: input tables, the shared work folder, word splitting."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The ASCII letters that are lower-cased, and the white space that ends a word.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
SPACES = r"[\x20\x09-\x0D]+"
FILTER_BITS = 1 << 26
CHUNK_BITS = 1 << 15
PART_BYTES = 1 << 23


def prepare(spark: SparkSession) -> None:
    """Ship this package to the Python workers, once a Spark application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"  # Spark copies it to its own store
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        sc.addPyFile(str(archive))
        _SHIPPED.add(sc.applicationId)


_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a local master, where
    driver and executors are one process, may do without: a folder below the warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir") + "/_work"
    return root.rstrip("/")


def work_folder(spark: SparkSession) -> str:
    """The folder of all work tables of this Spark application."""
    return f"{shared_root(spark)}/lexstrata/{spark.sparkContext.applicationId}"


def work_path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear_work(spark: SparkSession) -> None:
    """Delete the work tables of this application. Results are read from them, so call it
    once these have been written."""
    remove_path(spark, work_folder(spark))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there,
    and a lost executor costs no more than its running tasks."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_filter(values: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test that holds for every value of ``column`` and for few others.

    A bitmap of ``FILTER_BITS`` hashed values, of a fixed size whatever the input, goes to
    the tasks; what passes still needs a join, but most other rows stay out of its shuffle.
    """
    hashed = values.select(_filter_place(F.col(column)).alias("h"))
    parts = hashed.groupBy(F.expr(f"h div {CHUNK_BITS}").alias("chunk")).agg(F.bitmap_construct_agg(F.col("h") % CHUNK_BITS).alias("bits"))
    bitmap = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts.collect():  # at most FILTER_BITS / CHUNK_BITS rows of CHUNK_BITS / 8 bytes
        at = r.chunk * CHUNK_BITS // 8
        bitmap[at : at + CHUNK_BITS // 8] = np.frombuffer(r.bits, np.uint8)
    shared = values.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def maybe(places: pd.Series) -> pd.Series:
        at = places.to_numpy().astype(np.int64)
        return pd.Series((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return lambda c: maybe(_filter_place(c))


def _filter_place(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a work folder through the file system that owns it."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in UTF-8, with A-Z lower-cased. ``bytes.split``
    splits at exactly these six bytes. Lone surrogates cannot come from Spark."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split() if text else []


def text_parts(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in runs of about ``PART_BYTES``; none is cut."""
    before = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy().astype(np.int64)) // PART_BYTES
    starts = [0, *(np.flatnonzero(np.diff(before)) + 1).tolist(), len(texts)]
    for a, b in zip(starts, starts[1:]):
        if a < b:
            yield texts[a:b]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, as ``words_of`` gives them, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
    words, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    ends -= ends[0]
    full = pc.binary_length(words).to_numpy() > 0  # white space at an end of a text leaves an empty word there
    if not full.all():
        words, ends = words.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[ends]
    return words, np.diff(ends)


def doc_crc_mod(col: str, mod: int):
    """crc32 of the id as text, modulo ``mod`` (null ids count as the text 'null')."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("null")).cast("binary")) % mod
