"""LM scoring: a hashed maximum-entropy model (:mod:`.maxent`), trained and applied by Spark.

Word counts cover all training texts. Words at least as frequent as a cut-off, at most
``HEAD`` of them, become leaves of the model and go to the tasks; all other words of a text
are looked up by a join, so every count is exact whatever the vocabulary. The tables of
weights grow with the training tokens up to fixed bounds.

Training is synchronous rounds of local gradient steps: each task starts from the round's
weights, walks over its partition of the training texts in mini-batches, and sends its
change of each weight with the squared gradients it saw there. Tasks add both up block by
block, a weight's changes weighted by their squares, so a task that never met a feature does
not dilute it; many tasks are added up in two levels. Rounds split the training texts by the
checksum of the id, so together they use each text once. Scoring walks over all whole texts
in batches bounded in tokens.

Defined cases: a null or empty text is the end token alone; a null id counts as the text
'null'; rows that repeat an id are scored one by one; without training texts every count
is 0 and nothing but the smoothing tells classes apart; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_crc_mod, materialize, split_words, text_parts
from .maxent import CLASSES, RESTS, SMOOTH, STEP_TOKENS, Descent, Model, Tokens, Vocabulary

HEAD = 300_000
ROUNDS = 2
FLUSH_WORDS = 1_000_000
BLOCK = 4096
TASK_TOKENS = 1 << 24
FAN_IN = 256


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all words of ``docs`` (column text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = [], 0
        for batch in batches:
            for part in text_parts(batch.column("text")):
                seen.append(pa.RecordBatch.from_struct_array(split_words(part)[0].value_counts()))
                held += seen[-1].num_rows
                if held > FLUSH_WORDS:
                    seen = _summed(seen)
                    held = sum(s.num_rows for s in seen)
                    if held > FLUSH_WORDS // 2:
                        yield from seen
                        seen, held = [], 0
        if seen:
            yield from _summed(seen)

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _summed(counts: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    """(word, n) with each word once, from counts with columns (word, n) in any names."""
    whole = pa.Table.from_batches([c.rename_columns(["word", "n"]) for c in counts]).group_by("word").aggregate([("n", "sum")])
    return whole.rename_columns(["word", "n"]).combine_chunks().to_batches()


def learn_vocabulary(train: DataFrame, head_size: int = HEAD) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary and the table (word, n) of all training words."""
    words = materialize(count_words(train), "lm-words")
    docs = train.count()
    # Counts in steps of a sixteenth of a power of two: some hundred rows, whatever the corpus.
    steps = words.groupBy(F.floor(16 * F.log2("n")).alias("step")).agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("tokens"), F.min("n").alias("least")).collect()
    taken, cut = 0, None
    for r in sorted(steps, key=lambda r: -r.step):
        if taken + r.types > head_size:
            break
        taken, cut = taken + r.types, r.least
    head = words.filter(F.col("n") >= cut).toArrow() if cut else None  # at most head_size rows
    rest = words.filter(F.col("n") < cut) if cut else words
    shares = rest.groupBy((F.crc32(F.col("word").cast("binary")) % RESTS).cast("int").alias("leaf")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect()  # RESTS rows
    frequent = dict(zip(head["word"].to_pylist(), head["n"].to_pylist(), strict=True)) if head else {}
    tokens, types = sum(r.tokens for r in steps) + docs, sum(r.types for r in steps) + (docs > 0)
    return Vocabulary(frequent, {r.leaf: (r.n, r.types) for r in shares}, docs, tokens, types), words


def _bundles(v: Vocabulary, texts: Iterator[pa.Array]) -> Iterator[Tokens]:
    """Whole texts in bundles of about ``STEP_TOKENS`` tokens."""
    words, found, sizes = pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(0, np.int64)
    for part in (p for t in texts for p in text_parts(t)):
        more, more_sizes = split_words(part)
        words, found, sizes = pa.concat_arrays([words, more]), np.concatenate([found, v.find(more)]), np.concatenate([sizes, more_sizes])
        ends, tokens = (np.concatenate([[0], np.cumsum(x)]) for x in (sizes, sizes + 1))
        a = 0
        while (b := int(np.searchsorted(tokens, tokens[a] + STEP_TOKENS))) <= len(sizes):
            own = slice(int(ends[a]), int(ends[b]))
            yield Tokens.of(v, words[own], found[own], sizes[a:b])
            a = b
        words, found, sizes = words[int(ends[a]) :], found[ends[a] :], sizes[a:]
    if len(sizes):
        yield Tokens.of(v, words, found, sizes)


_CHANGE = "block int, salt int, change binary, squares binary"


def _change_batch(rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    arrays = [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32())]
    # Half precision: a change to three digits, and the root of its squares.
    arrays += [pa.array([c.astype(np.float16).tobytes() for c in columns[2]], pa.binary()), pa.array([np.minimum(np.sqrt(s), 6e4).astype(np.float16).tobytes() for s in columns[3]], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["block", "salt", "change", "squares"])


def _added_up(parts: DataFrame, *keys: str) -> DataFrame:
    """Changes of one block (and salt) as one: weighted by squares, batch by batch."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list[np.ndarray]] = {}  # at most one entry a block of the tables and salt
        for batch in batches:
            for block, salt, change, squares in zip(*(batch.column(c).to_pylist() for c in ("block", "salt", "change", "squares")), strict=True):
                weight = np.square(np.frombuffer(squares, np.float16).astype(np.float32))
                moved = np.frombuffer(change, np.float16) * weight
                held = sums.get((block, salt if "salt" in keys else 0))
                if held is None:
                    sums[block, salt if "salt" in keys else 0] = [moved, weight]
                else:
                    held[0] += moved
                    held[1] += weight
        for (block, salt), (moved, weight) in sums.items():
            yield _change_batch([(block, salt, moved / np.where(weight > 0, weight, 1), weight)])

    return parts.repartition(*keys).mapInArrow(add, _CHANGE)


def train_round(docs: DataFrame, vocabulary, model: Model) -> Model:
    """One synchronous round over ``docs`` (column text)."""
    spark = docs.sparkSession
    given = spark.sparkContext.broadcast((model.rows, model.cells))  # bounded by MOST_BUCKETS and MOST_CELLS

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = Model(vocabulary.value, *given.value)
        descent = Descent(start)
        for tokens in _bundles(start.v, (b.column("text") for b in batches)):
            descent.step(tokens)
        salt = TaskContext.get().partitionId() % FAN_IN
        change = np.concatenate([(descent.model.rows - start.rows).ravel(), descent.model.cells - start.cells]).reshape(-1, BLOCK)
        squares = np.concatenate([descent.row_squares.ravel(), descent.cell_squares]).reshape(-1, BLOCK)
        used = np.flatnonzero(squares.any(axis=1)).tolist()
        for at in range(0, len(used), 64):
            yield _change_batch([(k, salt, change[k], squares[k]) for k in used[at : at + 64]])

    # A task sends both tables whole, so small partitions go together, but no core stays idle.
    tasks = max(2 * spark.sparkContext.defaultParallelism, math.ceil(model.v.tokens / TASK_TOKENS))
    parts = docs.select("text").coalesce(tasks).mapInArrow(learn, _CHANGE)
    if tasks > FAN_IN:
        parts = _added_up(parts, "block", "salt")
    flat = np.concatenate([model.rows.ravel(), model.cells]).reshape(-1, BLOCK)
    for r in _added_up(parts, "block").collect():  # one row a block of the tables
        flat[r.block] += np.frombuffer(r.change, np.float16)
    given.unpersist()
    rows, cells = np.split(flat.ravel(), [model.rows.size])
    return Model(model.v, rows.reshape(-1, CLASSES), cells)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", holdout: int = 10, rounds: int = ROUNDS, head_size: int = HEAD) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    train = rows.filter(doc_crc_mod("id", holdout) != 0).select("id", "text")
    vocabulary, words = learn_vocabulary(train, head_size)
    shared = spark.sparkContext.broadcast(vocabulary)  # at most head_size words
    model = Model.fresh(vocabulary)
    for r in range(rounds):
        part = train.filter(F.expr(f"(crc32(cast(coalesce(cast(id as string), 'null') as binary)) div {holdout}) % {rounds} = {r}"))
        model = train_round(part, shared, model)
    learnt = spark.sparkContext.broadcast((model.rows, model.cells))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(shared.value, *learnt.value)
        for batch in batches:
            parts = [_scored(own, tokens) for tokens in _bundles(own.v, iter([batch.column("text")]))]
            columns = [pa.concat_arrays(c) for c in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), *columns], names=["row", "id", *_SCORED])

    schema = f"row long, id {docs.schema[id_col].dataType.simpleString()}, n long, known long, log_count double, log_model double, words array<string>"
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    part = materialize(numbered.mapInArrow(score, schema), "lm-scored")

    outside = part.select("row", F.explode("words").alias("word")).join(words, "word", "left")
    seen = outside.select("row", F.col("n").isNotNull().cast("long").alias("known"), F.log10(F.coalesce("n", F.lit(0)) + SMOOTH).alias("log_count"))
    # A word outside the head adds its log count to both scores; the model took its leaf's total off.
    seen = seen.withColumn("log_model", F.col("log_count"))
    flat = part.select("row", "id", "n", "known", "log_count", "log_model").unionByName(seen, allowMissingColumns=True)
    total = flat.groupBy("row").agg(F.max("id").alias("id"), *[F.sum(c).alias(c) for c in ("n", "known", "log_count", "log_model")])
    return total.select(
        F.col("id").alias(id_col), (doc_crc_mod("id", holdout) == 0).alias("held_out"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), (F.col("log_count") - F.col("n") * vocabulary.log_base).alias("base_score"), F.col("log_model").alias("score"),
    )


_SCORED = {"n": pa.int64(), "known": pa.int64(), "log_count": pa.float64(), "log_model": pa.float64(), "words": pa.list_(pa.string())}


def _scored(model: Model, tokens: Tokens) -> list[pa.Array]:
    """The columns of ``_SCORED`` for the texts of one bundle."""
    v, n = model.v, len(tokens.sizes)
    text = np.repeat(np.arange(n), tokens.sizes)
    logs = model.log_probability(tokens)
    frequent = tokens.leaf < v.size
    outside = ~frequent & (tokens.leaf < v.end)
    logs[outside] -= v.log_rest[tokens.leaf[outside] - v.size]
    known = np.bincount(text[frequent], minlength=n) + (v.docs > 0)
    log_count = np.bincount(text[frequent], weights=v.log_counts[tokens.leaf[frequent]], minlength=n) + math.log10(v.docs + SMOOTH)
    ends = pa.array(np.searchsorted(tokens.outside_text, np.arange(n + 1)), pa.int32())
    words = pa.ListArray.from_arrays(ends, pa.array(tokens.outside, pa.binary()).cast(pa.string()))
    values = (tokens.sizes, known, log_count, np.bincount(text, weights=logs, minlength=n))
    return [*(pa.array(x, t) for x, t in zip(values, _SCORED.values())), words]
