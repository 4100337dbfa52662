"""Quality rules: hashed n-gram log-likelihood ratio behind plain counting rules.

Word unigrams and bigrams are hashed into ``BUCKETS`` counters. One multinomial is counted
over the trusted target (every labelled text of good quality), one over every whole text of
the corpus. A document's ratio is the
mean of ``log p_target - log p_raw`` over its n-grams, so long and short texts compare.
The threshold is fixed before scoring. Trusted texts fall into two halves by a hash of the
text, and each half is scored with the counts of the other; the threshold is the
``LEAST_SHARE`` quantile of these held-out ratios, so it follows their spread at any size.
Every document is then kept or not by that number alone. Texts are read where they lie:
ids alone are joined with the labels.

Defined cases: a null or blank text has no words, fails the base rules and is not kept;
rows that repeat an id are scored one by one; without trusted texts the verdict is the
base rules; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_filter, materialize
from .near_dedup import _mix, word_hashes

BUCKETS = 1 << 16
BINS = 1 << 16
LEAST_SHARE = 0.01
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
# Fixed value: characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def raw_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in UTF-8, case kept."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def gram_buckets(hashes: np.ndarray) -> np.ndarray:
    """Buckets of the unigrams and bigrams of a text."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    two = _mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])
    return (np.concatenate([_mix(hashes), two]) % np.uint64(BUCKETS)).astype(np.int64)


def repeated_window_words(hashes: np.ndarray, width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text."""
    n = len(hashes) - width + 1
    if n < 2:
        return 0
    w = np.full(n, width, np.uint64)
    for k in range(width):
        w = _mix(w + hashes[k : k + n])
    _, back, times = np.unique(w, return_inverse=True, return_counts=True)
    edge = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(times[back] > 1)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: str | None, words: list[bytes], hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    chars = len(b"".join(words).decode("utf-8", "surrogatepass"))
    symbols = len(text) - len(text.translate(_NO_SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_window_words(hashes)


_NO_SYMBOLS = str.maketrans("", "", SYMBOLS)


def gram_counts(rows: DataFrame) -> np.ndarray:
    """Counts of all buckets over whole texts (columns text, half) in three rows: all texts,
    those of half 0, those of half 1. Each task sends one row a bucket."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((3, BUCKETS), np.int64)  # no half, half 0, half 1
        for batch in batches:
            for text, half in zip(batch["text"], batch["half"].fillna(-1).astype(int), strict=True):
                if text:
                    total[half + 1] += np.bincount(gram_buckets(word_hashes(raw_words(text))), minlength=BUCKETS)
        used = np.flatnonzero(total.any(axis=0))
        yield pd.DataFrame({"bucket": used.astype(np.int32), **dict(zip(_COUNTS, total[:, used], strict=True))})

    parts = rows.select("text", "half").mapInPandas(count, "bucket int, other long, first long, second long")
    out = np.zeros((3, BUCKETS), np.int64)
    for r in parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in _COUNTS]).collect():  # at most BUCKETS rows
        out[:, r.bucket] = r.other + r["first"] + r.second, r["first"], r.second
    return out


_COUNTS = ["other", "first", "second"]


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw of each bucket, with one added to every count."""
    return np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))


def mean_ratio(ratio: np.ndarray, hashes: np.ndarray) -> float:
    grams = gram_buckets(hashes)
    return float(ratio[grams].mean()) if len(grams) else 0.0


def exact_quantile(rows: DataFrame, share: float) -> float:
    """The quantile of ``r`` over all rows, between two of them by their distance: counted in
    ``BINS`` bins first, then by value in the bins that hold its ranks."""
    seen = rows.agg(F.count("r").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).first()
    if seen.low == seen.high:
        return seen.low
    place = F.least(F.floor((F.col("r") - seen.low) / (seen.high - seen.low) * BINS), F.lit(BINS - 1))
    at = (seen.n - 1) * share
    ranks = [int(np.floor(at)), int(np.ceil(at))]
    bins = np.array(sorted(tuple(x) for x in rows.groupBy(place.alias("bin")).count().collect()))  # at most BINS rows
    ends = np.cumsum(bins[:, 1])
    first, last = np.searchsorted(ends, ranks, side="right")
    values = np.array(sorted(tuple(x) for x in rows.filter(place.between(int(bins[first, 0]), int(bins[last, 0]))).groupBy("r").count().collect()))
    lower, upper = values[np.searchsorted(np.cumsum(values[:, 1]), np.array(ranks) - (ends[first] - bins[first, 1]), side="right"), 0]
    return float(lower + (at - ranks[0]) * (upper - lower))


def membership(rows: DataFrame, members: DataFrame) -> tuple[Column, DataFrame]:
    """Which ``rows`` have an id in ``members`` (distinct, column id), by two bitmaps of a fixed
    size instead of a join that moves the rows.

    The first bitmap knows all members and lets some strangers through. A join of ids alone
    names these, and the second bitmap knows them. Rows that pass the first and not the second
    are members: the column returned holds for them. Rows that pass both are joined; the
    members among them are the table returned. With bitmaps too full to tell anything, that
    is all rows, so the result is exact at any size.
    """
    possible = id_filter(members, "id")(F.col("id"))
    again = F.xxhash64("id", F.lit(1))  # not the places of the first bitmap
    strangers = rows.select("id").filter(possible).join(members, "id", "left_anti").select(again.alias("place"))
    strange = id_filter(strangers, "place")(again)
    return possible & ~strange, rows.filter(possible & strange).join(members, "id", "left_semi")


def fit_ratio(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, float] | None:
    """(ratio by bucket, threshold), or None without trusted texts."""
    good = labels.filter(F.col(label_col) == 1).select(F.col(id_col).alias("id")).filter("id is not null").distinct()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    certain, doubtful = membership(rows, good)
    # Equal texts fall into one half, or a copy would score itself.
    half = F.pmod(F.xxhash64("text"), F.lit(2))
    joined = materialize(doubtful.select("text", half.alias("half")), "trusted")  # the few whose ids the bitmaps cannot tell
    raw, *halves = gram_counts(rows.select("text", F.when(certain, half).alias("half")))
    halves = [a + b for a, b in zip(halves, gram_counts(joined)[1:], strict=True)]
    target = halves[0] + halves[1]
    if not target.sum():
        return None
    other = [log_ratio(counts if counts.sum() else target, raw) for counts in reversed(halves)]

    @F.pandas_udf("double")
    def held_out_ratio(texts: pd.Series, half: pd.Series) -> pd.Series:
        return pd.Series([mean_ratio(other[k], word_hashes(raw_words(t))) for t, k in zip(texts, half, strict=True)], dtype=float)

    trusted = rows.filter(certain).select("text", half.alias("half")).union(joined)
    scored = trusted.filter(F.length(F.trim("text")) > 0).select(held_out_ratio("text", "half").alias("r"))
    return log_ratio(target, raw), exact_quantile(materialize(scored, "ratios"), LEAST_SHARE)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, kept."""
    model = fit_ratio(docs, labels, id_col, text_col, label_col)
    ratio, threshold = model if model else (np.zeros(BUCKETS), -np.inf)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # BUCKETS doubles, whatever the input

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for batch in batches:
            rows = []
            for text in batch["text"]:
                words = raw_words(text)
                hashes = word_hashes(words)
                rows.append((*base_counts(text, words, hashes), mean_ratio(table, hashes)))
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio"]
            yield pd.concat([batch[["id"]].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInPandas(measure, "id string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), "ratio", (~failed & (F.col("ratio") >= threshold)).alias("kept"),
    )
