"""Small decisions as column expressions and rollups: which task may run, what a fetch means,
when a document is gone, which attempt counts.

Null kinds and stages are none of the named ones; a null status is a failed fetch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Kinds, tasks and stages with a meaning of their own, and the order of fields.
CRITICAL_TASKS = ("promulgation_extract", "amendment_apply", "change_analyze", "card_write", "card_verify")
INSTANT_KINDS = ("change_direct", "bill_update", "correction")
FINAL_NEGATIVE_STAGES = ("rejected", "withdrawn")
AUTO_MERGED_KINDS = ("official",)
FIELD_ORDER = (
    "id", "kind", "jurisdiction", "lands", "title_de", "amending_act", "affected_laws",
    "stage", "dates", "amounts", "audience", "topics", "impact", "impact_rationale",
    "confidence", "uncertainties", "review", "ai", "sources", "corrections",
)
DONE_NOTE = "ist berücksichtigt"
CONFIRMATIONS = 3
REPAIRS = 2


def one_of(value: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(value.isin(*names), F.lit(False))


def is_pending(note: Column) -> Column:
    """A note announces an amendment that the text does not show yet."""
    return ~F.contains(note, F.lit(DONE_NOTE))


def is_nationwide(lands: Column) -> Column:
    return F.coalesce(F.size(lands), F.lit(0)) <= 0


def ordered_fields(fields: Column, order: tuple[str, ...] = FIELD_ORDER) -> Column:
    """Names in the given order, and behind them the others as they came."""
    known = F.filter(F.array(*map(F.lit, order)), lambda k: F.array_contains(fields, k))
    return F.concat(known, F.array_except(fields, known))


def may_run(state: Column, policy: Column, task: Column, is_free: Column) -> Column:
    """Within the budget every task runs; beyond it "pause" lets critical tasks run, any other
    policy what costs nothing."""
    beyond = F.when(policy == "pause", one_of(task, CRITICAL_TASKS)).otherwise(F.coalesce(is_free, F.lit(False)))
    return F.when(F.coalesce(state == "exceeded", F.lit(False)), beyond).otherwise(F.lit(True))


def fetch_outcome(status: Column, content_hash: Column, known_hash: Column) -> Column:
    """not_modified, failed, unchanged, changed or new, from a status and two hashes."""
    return (
        F.when(F.coalesce(status >= 400, F.lit(True)), "failed").when(status == 304, "not_modified")
        .when(known_hash.isNull(), "new").when(content_hash == known_hash, "unchanged").otherwise("changed")
    )


def robots_answer(status: Column) -> Column:
    """What a host allows by the status of its robots file: its rules, all, or nothing."""
    return F.when(status.between(200, 299), "rules").when(status.between(400, 499), "all").otherwise("nothing")


def confirmed_missing(misses: Column, gone: Column, confirmations: int = CONFIRMATIONS) -> Column:
    """A document counts as repealed once it was missed often enough and its source says it is gone."""
    return (misses >= confirmations) & F.coalesce(gone, F.lit(False))


def accepted_answers(attempts: DataFrame, request: str, place: str, attempt: list[str], valid: str, repairs: int = REPAIRS) -> DataFrame:
    """One row a request: model place and attempt of the answer that counts (null: none), and
    attempts that were made up to it.

    A model of the chain (``place`` from 0) answers and may repair ``repairs`` times; later
    attempts of it are never made, and the next model's turn comes only after that.
    """
    by_model = Window.partitionBy(request, place).orderBy(*attempt)
    made = attempts.withColumn("_n", F.row_number().over(by_model)).filter(F.col("_n") <= repairs + 1)
    at = F.struct(F.col(place).alias("place"), F.col("_n").alias("attempt"))
    first = made.groupBy(request).agg(F.min(F.when(F.col(valid), at)).alias("_at"), F.sort_array(F.collect_list(at)).alias("_all"))  # at most repairs + 1 a model
    upto = F.when(F.col("_at").isNull(), F.size("_all")).otherwise(F.size(F.filter("_all", lambda x: x <= F.col("_at"))))
    return first.select(request, F.col("_at.place").alias("place"), F.col("_at.attempt").alias("attempt"), upto.alias("made"))


def rebuilt(log: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The state of each key replayed from its whole log: the last value, null drops the key."""
    return log.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value)).filter(F.col(value).isNotNull())


def cache_hits(requests: DataFrame, fingerprint: str, request: str, ts: str, ttl_seconds: int) -> DataFrame:
    """(request, hit): whether an answer that is at most ``ttl_seconds`` old is kept when a
    request comes. A miss keeps a new answer; a hit does not make the kept one younger. One
    fold over a fingerprint's own times; requests without a time are left out."""
    at = (F.col(ts).cast("timestamp").cast("double") * 1000).cast("long")
    listed = requests.select(F.col(fingerprint).cast("string").alias("f"), F.struct(at.alias("t"), F.col(request).cast("long").alias("r")).alias("x")).filter("x.t is not null").groupBy("f").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    start = F.struct(F.lit(None).cast("long").alias("since"), F.array().cast("array<struct<request: bigint, hit: boolean>>").alias("out"))

    def step(s, x):
        hit = F.coalesce(x["t"] <= s["since"] + ttl_seconds * 1000, F.lit(False))
        return F.struct(F.when(hit, s["since"]).otherwise(x["t"]).alias("since"), F.array_append(s["out"], F.struct(x["r"].alias("request"), hit.alias("hit"))).alias("out"))

    return listed.select(F.explode(F.aggregate("xs", start, step)["out"]).alias("o")).select("o.request", "o.hit")
