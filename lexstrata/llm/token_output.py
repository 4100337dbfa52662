"""Token-id output: best-fit-decreasing packing with a segment tree, written as matrices.

Tasks tokenise whole texts and pack them batch by batch: pieces in descending length, each
into the fullest open sequence that still has room. The open sequences are kept by free
room in a segment tree over capacities, so the best fit is found in ``log2(limit)`` steps.
A batch is bounded in tokens, not in documents, and closes its sequences at its end, so
memory does not depend on the partition. Texts longer than ``limit`` are cut into pieces;
nothing is lost or repeated, and pieces join to the text's ids again.

Each row written is one sequence: ``ids`` padded to ``limit``, the cumulative segment
lengths ``cu_seqlens``, and ``position_ids`` that start again with each segment.

Defined cases: a null text is empty and gives its end id alone; rows that repeat an id are
packed one by one; an empty table writes a folder without rows.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import work_path
from .tokens import END_ID, default_tokenizer, pieces_of, tokenizer_at

LIMIT = 1024
PAD_ID = 0
BATCH_TOKENS = 1 << 19


class RoomTree:
    """Open sequences by free room; finds the least room that fits a length."""

    def __init__(self, limit: int):
        self.size = 1 << limit.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(limit + 1)]

    def _add(self, room: int, n: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += n
            at >>= 1

    def push(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self._add(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """(sequence, room) with the least room of at least ``length``, taken out."""
        at = length + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1  # up, until a subtree to the right holds a sequence
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        self._add(room, -1)
        return self.open[room].pop(), room


def best_fit_decreasing(lengths: list[int], limit: int) -> list[list[int]]:
    """Indices of the pieces in each sequence."""
    tree, sequences = RoomTree(limit), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[i])
        if found is None:
            sequences.append([])
            found = len(sequences) - 1, limit
        sequences[found[0]].append(i)
        if found[1] > lengths[i]:
            tree.push(found[1] - lengths[i], found[0])
    return sequences


def matrices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """One row a sequence: sequence_id, ids, cu_seqlens, position_ids, and its segments
    (id, piece, start) in order."""
    path = tokenizer or default_tokenizer()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer_at(path)
        keys, numbers, starts, parts, held = [], [], [], [], 0
        partition, written = TaskContext.get().partitionId(), 0

        def close() -> pa.RecordBatch:
            groups = best_fit_decreasing([len(p) for p in parts], limit)
            order = list(itertools.chain.from_iterable(groups))
            taken = np.array([len(g) for g in groups])
            sizes = np.array([len(parts[i]) for i in order])
            before = np.cumsum(sizes) - sizes
            heads = np.cumsum(taken) - taken  # the first piece of each sequence
            offsets = before - np.repeat(before[heads], taken)
            within = np.arange(sizes.sum(), dtype=np.int32) - np.repeat(before, sizes).astype(np.int32)
            at = within + np.repeat(np.repeat(np.arange(len(groups)) * limit, taken) + offsets, sizes)
            ids, places = np.full(len(groups) * limit, PAD_ID, np.int32), np.zeros(len(groups) * limit, np.int32)
            ids[at], places[at] = np.concatenate([parts[i] for i in order]), within
            # Of each sequence: the offsets of its pieces, then its length.
            ends = np.insert(offsets, heads + taken, (offsets + sizes)[heads + taken - 1]).astype(np.int32)
            nonlocal written
            names = [f"{partition:06d}-{written + k:09d}" for k in range(len(groups))]
            written += len(groups)
            rows = np.arange(len(groups) + 1, dtype=np.int32)
            pieces = np.append(heads, len(order)).astype(np.int32)
            segments = pa.StructArray.from_arrays(
                [pa.array([keys[i] for i in order], pa.string()), pa.array([numbers[i] for i in order], pa.int32()), pa.array([starts[i] for i in order], pa.int64())], fields=list(_SEGMENTS.value_type)
            )
            columns = [pa.ListArray.from_arrays(rows * limit, ids), pa.ListArray.from_arrays(pieces + rows, ends), pa.ListArray.from_arrays(rows * limit, places), pa.ListArray.from_arrays(pieces, segments)]
            return pa.RecordBatch.from_arrays([pa.array(names), *columns], names=["sequence_id", "ids", "cu_seqlens", "position_ids", "segments"])

        for batch in batches:
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            for key, text in zip(batch.column("id").to_pylist(), texts, strict=True):
                ids = np.append(encoder.encode([text])[0], np.uint32(end_id)).astype(np.int32)
                for k, (start, length) in enumerate(pieces_of(len(ids), limit)):
                    keys.append(key)
                    numbers.append(k)
                    starts.append(start)
                    parts.append(ids[start : start + length])
                held += len(ids)
                if held >= BATCH_TOKENS:
                    yield close()
                    keys, numbers, starts, parts, held = [], [], [], [], 0
        if parts:
            yield close()

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    schema = "sequence_id string, ids array<int>, cu_seqlens array<int>, position_ids array<int>, segments array<struct<id:string,piece:int,start:long>>"
    out = rows.mapInArrow(run, schema)
    return out.withColumn("segments", F.col("segments").cast(f"array<struct<id:{kind},piece:int,start:bigint>>"))


_SEGMENTS = pa.list_(pa.struct([("id", pa.string()), ("piece", pa.int32()), ("start", pa.int64())]))


def write_matrices(docs: DataFrame, path: str, **options) -> None:
    """Write the matrices as Parquet; ids keep their 32 bits and compress in columns."""
    matrices(docs, **options).write.parquet(path)


def read_pieces(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row a piece, from the matrices alone: id, piece, start, length, ids_crc32,
    sequence_id, offset, positions_reset (its positions run from 0)."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("part")
            flat, at = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy() - ids.offsets[0].as_py()
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            rest = [c for c in batch.schema.names if c != "part"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(sums, pa.int64())], names=[*rest, "ids_crc32"])

    rows = spark.read.parquet(path).select("*", F.posexplode("segments").alias("k", "s"))
    begin, end = F.expr("cu_seqlens[k]"), F.expr("cu_seqlens[k + 1]")
    cut = rows.select(
        F.col("s.id").alias(id_col), F.col("s.piece").alias("piece"), F.col("s.start").alias("start"), (end - begin).cast("long").alias("length"), "sequence_id",
        begin.cast("long").alias("offset"), ((F.get("position_ids", begin) == 0) & (F.get("position_ids", end - 1) == end - begin - 1)).alias("positions_reset"),
        F.slice("ids", begin + 1, end - begin).alias("part"),
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields if f.name != "part") + ", ids_crc32 long"
    return cut.mapInArrow(crc, schema)


def token_output(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, **options) -> DataFrame:
    """Write the matrices of all documents to the shared folder and return their pieces."""
    spark = docs.sparkSession
    path = path or work_path(spark, "token-matrices")
    write_matrices(docs, path, id_col=id_col, text_col=text_col, **options)
    return read_pieces(spark, path, id_col)
