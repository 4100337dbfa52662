"""URL filters as a temporal list join (DataFrame operations only).

Dated list entries become validity intervals: the add and remove events of one pattern, in
time order, and an interval from each add to the next event. Every capture is then joined
as of its fetch time with all entries that cover its URL: its exact URL, its host, each
parent domain, and each path prefix at a segment border. Entries and captures meet in an
equi-join on (kind, pattern, time bucket); intervals are clipped to the span of the
captures and laid over its buckets, so a pattern with a long history or a host with a third
of all captures only meets what was valid around the same time.

Defined cases: events of one pattern at the same time count once, and an add wins over a
remove; an event without list, kind, pattern or time, or of another action, is ignored; a
capture without URL or fetch time matches nothing and is kept; repeated captures are judged
one by one; empty captures give an empty result, empty lists keep everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKET_SECONDS = 30 * 86400


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and final dot; brackets of an address stay."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@\[]*)", 1)
    return F.lower(F.regexp_replace(host, r"\.$", ""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def patterns_of(url: Column) -> Column:
    """All (kind, pattern) pairs that an entry can name to cover a URL."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    pair = lambda kind, pattern: F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern"))
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: pair("domain", F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    depth = F.size(segments)
    prefixes = F.when(
        depth > 0,
        F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda i: pair("prefix", F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/")))),
    ).otherwise(F.array().cast("array<struct<kind:string,pattern:string>>"))
    return F.when(url.isNotNull(), F.concat(F.array(pair("url", url), pair("host", host)), domains, prefixes))


def validity_intervals(events: DataFrame) -> DataFrame:
    """(list, kind, pattern, valid_from, valid_to) from (list, kind, pattern, action, at);
    an open end is null."""
    good = events.filter(F.col("action").isin("add", "remove")).dropna(subset=["list", "kind", "pattern", "at"])
    states = good.groupBy("list", "kind", "pattern", "at").agg(F.max((F.col("action") == "add").cast("int")).alias("added"))
    following = F.lead("at").over(Window.partitionBy("list", "kind", "pattern").orderBy("at"))
    return states.withColumn("valid_to", following).filter("added = 1").select("list", "kind", "pattern", F.col("at").alias("valid_from"), "valid_to")


def judge_captures(captures: DataFrame, events: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at", bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """One row per capture: id, fetched_at, n_entries, lists, active_since, kept."""
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("at"))
    span = rows.agg(F.min("at").alias("low"), F.max("at").alias("high")).first()
    bucket = lambda t: F.floor(F.unix_timestamp(t) / bucket_seconds)
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    keys = numbered.select("row", "id", "at", bucket(F.col("at")).alias("bucket"), F.explode_outer(patterns_of(F.col("url"))).alias("k")).select(
        "row", "id", "at", "bucket", F.col("k.kind").alias("kind"), F.col("k.pattern").alias("pattern")
    )

    low, high = F.lit(span.low).cast("timestamp"), F.lit(span.high).cast("timestamp")
    covered = validity_intervals(events).filter((F.col("valid_from") <= high) & (F.col("valid_to").isNull() | (F.col("valid_to") > low)))
    first = bucket(F.greatest(F.col("valid_from"), low))
    last = bucket(F.least(F.coalesce("valid_to", high), high))
    spread = covered.withColumn("bucket", F.explode(F.sequence(first, last)))

    on = ["kind", "pattern", "bucket"]
    met = keys.join(spread, on, "left")
    active = (F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("at")))
    judged = met.groupBy("row").agg(
        F.max("id").alias("id"), F.max("at").alias("at"), F.count_if(active).alias("n_entries"),
        F.array_join(F.array_sort(F.collect_set(F.when(active, F.col("list")))), ",").alias("lists"), F.min(F.when(active, F.col("valid_from"))).alias("active_since"),
    )
    return judged.select(F.col("id").alias(id_col), F.col("at").alias(time_col), "n_entries", "lists", "active_since", (F.col("n_entries") == 0).alias("kept"))
