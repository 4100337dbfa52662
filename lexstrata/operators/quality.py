"""Data-quality rules. Each gives issue rows (subject, severity, code, path), which add up
by ``union`` and roll up to one report a subject."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR, WARNING, INFO = "error", "warning", "info"
COLUMNS = ["subject", "severity", "code", "path"]
MIN_FOR_RATIO = 20
BLOCK = 1000
LISTED = 100_000


def issues(rows: DataFrame, when: Column, subject: Column, severity: str | Column, code: str | Column, path: Column | None = None) -> DataFrame:
    """An issue for each row where ``when`` holds (null counts as no)."""
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    path = F.lit(None).cast("string") if path is None else path
    return rows.filter(F.coalesce(when, F.lit(False))).select(
        subject.cast("string").alias("subject"), as_column(severity).alias("severity"), as_column(code).alias("code"), path.cast("string").alias("path")
    )


def merged(*reports: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)


def report(found: DataFrame) -> DataFrame:
    """One row a subject: passed (no error), number of issues, distinct codes in order."""
    return found.groupBy("subject").agg(
        F.every(F.col("severity") != ERROR).alias("passed"), F.count(F.lit(1)).alias("issues"), F.array_join(F.sort_array(F.collect_set("code")), ",").alias("codes")
    )


def deletion_ratio(before: Column, after: Column) -> Column:
    return F.when(before > 0, F.greatest(F.lit(0.0), (before - after) / before)).otherwise(F.lit(0.0))


def deletion_issues(outcomes: DataFrame, subject: str, limit: float = 0.4, repealed_at_source: DataFrame | None = None) -> DataFrame:
    """Texts that lost too much, unless they are repealed or the source says so."""
    rows = outcomes if repealed_at_source is None else outcomes.join(repealed_at_source, subject, "left_anti")
    lost = (F.col("outcome") != "repealed") & (deletion_ratio(F.col("bytes_before"), F.col("bytes_after")) > limit)
    return issues(rows, lost, F.col(subject), ERROR, "law_text_deleted")


def run_size_issues(outcomes: DataFrame, group: str, limit: float = 0.3) -> DataFrame:
    """Groups of at least 20 of which too large a share changed in one run."""
    sizes = outcomes.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome").isin("created", "updated", "repealed")).alias("changed"))
    return issues(sizes, (F.col("n") >= MIN_FOR_RATIO) & (F.col("changed") / F.col("n") > limit), F.col(group), ERROR, "too_many_laws_changed")


def phrase_matches(texts: DataFrame, phrases: DataFrame, text: str, phrase: str, key: str, phrase_key: str, min_words: int = 3) -> DataFrame:
    """(key, phrase_key) for each phrase that a text contains.

    An index join instead of a comparison of all pairs: a phrase is found by the words that
    it holds whole (all but the first and last, which may touch longer words), of which the
    rarest is the index key; the text is checked for the phrase only where that word occurs.
    A list of up to ``LISTED`` phrases is sent to the texts, so no task gathers what holds one
    word or phrase; a longer one is joined by word. A candidate keeps its phrase, and texts are
    joined by their own key. Phrases of fewer than ``min_words`` words have no inner word: each
    text, where it lies, meets them as a stated list, in rows of about ``BLOCK`` phrases.
    """
    split = lambda c: F.split(c, " ")
    listed = phrases.select(F.col(phrase_key), F.col(phrase).alias("_phrase")).filter("_phrase is not null and _phrase <> ''")
    words = texts.select(F.col(key), F.col(text).alias("_text")).filter("_text is not null")
    long = listed.filter(F.size(split(F.col("_phrase"))) >= min_words)
    inner = long.select("*", F.explode(F.array_distinct(F.slice(split(F.col("_phrase")), 2, F.size(split(F.col("_phrase"))) - 2))).alias("_word"))
    held = words.select(key, F.explode(F.array_distinct(split(F.col("_text")))).alias("_word"))
    sent = F.broadcast if long.limit(LISTED + 1).count() <= LISTED else lambda x: x
    wanted = held.join(sent(inner.select("_word").distinct()), "_word", "left_semi")
    frequency = wanted.groupBy("_word").agg(F.count(F.lit(1)).alias("_n"))
    rarest = inner.join(frequency, "_word", "left").groupBy(phrase_key, "_phrase").agg(F.min_by("_word", F.struct(F.coalesce("_n", F.lit(0)), "_word")).alias("_word"))
    rarest = sent(rarest.join(long, [phrase_key, "_phrase"]))  # as often as it is listed
    pairs = wanted.join(rarest, "_word").select(key, phrase_key, "_phrase")
    found = pairs.join(words, key).filter(F.contains("_text", "_phrase")).select(key, phrase_key)

    short = listed.filter(F.size(split(F.col("_phrase"))) < min_words)
    n = -(-short.count() // BLOCK)
    if not n:
        return found
    blocks = short.groupBy(F.pmod(F.xxhash64("_phrase"), F.lit(n)).alias("_block")).agg(F.collect_list(F.struct(F.col(phrase_key), "_phrase")).alias("_list"))
    hits = words.crossJoin(F.broadcast(blocks)).select(key, F.explode(F.filter("_list", lambda p: F.contains(F.col("_text"), p["_phrase"]))).alias("_p"))
    return found.union(hits.select(key, F.col("_p")[phrase_key].alias(phrase_key)))


def section_issues(sections: DataFrame, subject: str, section: str, text: str, required: list[str]) -> DataFrame:
    """Required sections that are missing or empty, and sections that nobody knows."""
    filled = sections.filter(F.coalesce(F.btrim(text), F.lit("")) != "")
    held = sections.select(subject).distinct().join(filled.groupBy(subject).agg(F.collect_set(section).alias("_held")), subject, "left")
    missing = held.select(subject, F.explode(F.array_except(F.array(*map(F.lit, required)), F.coalesce("_held", F.array().cast("array<string>")))).alias("_s"))
    unknown = sections.filter(~F.col(section).isin(required)).select(subject, F.col(section).alias("_s")).distinct()
    return merged(
        issues(missing, F.lit(True), F.col(subject), ERROR, "translation.section_missing", F.col("_s")),
        issues(unknown, F.lit(True), F.col(subject), ERROR, "translation.unknown_section", F.col("_s")),
    )


def length_issues(sections: DataFrame, subject: str, section: str, text: str, summary: str, summary_limit: int = 280, total_limit: int = 8000) -> DataFrame:
    """Lengths in characters: a summary that is too long, a whole that is too long."""
    long = sections.filter(F.col(section) == summary).filter(F.length(text) > summary_limit).select(subject).distinct()
    totals = sections.groupBy(subject).agg(F.sum(F.length(text)).alias("_n"))
    return merged(
        issues(long, F.lit(True), F.col(subject), ERROR, "card.summary_too_long", F.lit(summary)),
        issues(totals, F.col("_n") > total_limit, F.col(subject), WARNING, "card.too_long"),
    )


def value_in_quote(quote: Column, value: Column) -> Column:
    """A number is quoted: its rounded integer occurs, or, unless it is whole, itself with a
    point or a comma. Matching is by substring."""
    whole = F.round(value).cast("long")
    plain = F.regexp_replace(value.cast("string"), r"\.0$", "")
    exact = F.contains(quote, plain) | F.contains(quote, F.replace(plain, F.lit("."), F.lit(",")))
    return F.contains(quote, whole.cast("string")) | ((whole.cast("double") != value) & exact)
