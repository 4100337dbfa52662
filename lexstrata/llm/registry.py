"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table
from .url_filters import host_of, judge_captures


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    prepare(spark)
    return archive_round_trip(table(spark, sf_dir, "pages"))


def captures_and_events(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fetch times and dated list entries for ``pages``, which has neither: both follow from
    page_id and url alone, so SQL can derive the same rows."""
    at = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.pmod(F.col("page_id") * 37, F.lit(8760)).cast("int"))
    captures = pages.select("page_id", "url", at.alias("fetched_at"))
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), F.regexp_extract("url", r"^[^:]*://[^/?#]*/([^/?#]+)", 1).alias("first")).filter("host <> ''")
    hosts = seen.groupBy(F.col("host").alias("pattern")).agg(F.min("page_id").alias("n"))
    domains = seen.groupBy(F.substring_index("host", ".", -2).alias("pattern")).agg(F.min("page_id").alias("n"))
    prefixes = seen.filter("first <> ''").groupBy(F.concat("host", F.lit("/"), "first").alias("pattern")).agg(F.min("page_id").alias("n"))
    return captures, (
        _events(hosts.filter("n % 4 = 0"), "malware", "host", "add", 200, 0)
        .union(_events(hosts.filter("n % 12 = 0"), "malware", "host", "remove", 200, 60))
        .union(_events(hosts.filter("n % 24 = 0"), "malware", "host", "add", 200, 120))
        .union(_events(domains.filter("n % 7 = 0"), "adult", "domain", "add", 300, 0))
        .union(_events(prefixes.filter("n % 5 = 0"), "ads", "prefix", "add", 100, 0))
        .union(_events(prefixes.filter("n % 5 = 0"), "ads", "prefix", "remove", 100, 200))
    )


def _events(patterns: DataFrame, name: str, kind: str, action: str, spread: int, later: int) -> DataFrame:
    day = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=(F.col("n") % spread + later).cast("int"))
    return patterns.select(F.lit(name).alias("list"), F.lit(kind).alias("kind"), "pattern", F.lit(action).alias("action"), day.alias("at"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, events = captures_and_events(table(spark, sf_dir, "pages"))
    return judge_captures(captures, events)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_components

    prepare(spark)
    return near_components(table(spark, sf_dir, "documents"), percent=85)


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_output import token_output

    prepare(spark)
    return token_output(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    prepare(spark)
    return pack(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    prepare(spark)
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    prepare(spark)
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import score_texts

    prepare(spark)
    return score_texts(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_report

    return shard_report(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster_report

    prepare(spark)
    return cluster_report(table(spark, sf_dir, "embeddings"))


def _centroid_sql(rounds: int = 5) -> str:
    """Every distance of every round, without bounds."""
    steps = ["""
        c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS cluster, v AS c FROM x ORDER BY sha256('2:' || vec_id) LIMIT 40)
    """]
    for r in range(rounds + 1):
        steps.append(f"""
        d{r} AS (SELECT vec_id, v, cluster, CAST(list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT) AS distance FROM x, c{r})
        """)
        steps.append(f"a{r} AS (SELECT vec_id, any_value(v) AS v, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM d{r} GROUP BY vec_id)")
        if r < rounds:
            steps.append(f"s{r} AS (SELECT cluster, i, CAST(floor(sum(v[i])::DOUBLE / count(*)) AS BIGINT) AS m FROM a{r}, range(1, 65) AS g(i) GROUP BY cluster, i)")
            steps.append(f"m{r} AS (SELECT cluster, list(m ORDER BY i) AS c FROM s{r} GROUP BY cluster)")
            steps.append(f"c{r + 1} AS (SELECT c{r}.cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster))")
    return f"""
        WITH x AS (
            SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64
        ), {", ".join(steps)}
        SELECT vec_id, CAST(a{rounds}.cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY a{rounds}.cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} USING (cluster)
    """


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc, op2_url_filters, op3_mixing, op4_exact_dedup, op5_minhash_near_dedup,
        op6_token_output, op7_best_fit_packing, op8_quality_rules, op9_toxicity, op10_language_model,
        op11_filter_audit, op12_sharding, op13_centroid_clustering,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
        ), sized AS (
            SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest, max(page_id) OVER (PARTITION BY body) AS keep FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN keep END AS refers_to
        FROM sized
    """,
    "op2_url_filters": r"""
        WITH captures AS (
            SELECT page_id, url, CAST('2024-01-01' AS TIMESTAMP) + to_hours(CAST(page_id * 37 % 8760 AS INTEGER)) AS fetched_at,
                   lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@\[]*)', 1), '\.$', '')) AS host,
                   list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda s: s <> '') AS segments
            FROM pages
        ), hosts AS (
            SELECT host AS pattern, min(page_id) AS n FROM captures WHERE host <> '' GROUP BY 1
        ), domains AS (
            SELECT array_to_string(string_split(host, '.')[-2:], '.') AS pattern, min(page_id) AS n FROM captures WHERE host <> '' GROUP BY 1
        ), prefixes AS (
            SELECT host || '/' || regexp_extract(url, '^[^:]*://[^/?#]*/([^/?#]+)', 1) AS pattern, min(page_id) AS n FROM captures
            WHERE host <> '' AND regexp_extract(url, '^[^:]*://[^/?#]*/([^/?#]+)', 1) <> '' GROUP BY 1
        ), events AS (
            SELECT 'malware' AS list, 'host' AS kind, pattern, 1 AS added, n % 200 AS day FROM hosts WHERE n % 4 = 0
            UNION ALL SELECT 'malware', 'host', pattern, 0, n % 200 + 60 FROM hosts WHERE n % 12 = 0
            UNION ALL SELECT 'malware', 'host', pattern, 1, n % 200 + 120 FROM hosts WHERE n % 24 = 0
            UNION ALL SELECT 'adult', 'domain', pattern, 1, n % 300 FROM domains WHERE n % 7 = 0
            UNION ALL SELECT 'ads', 'prefix', pattern, 1, n % 100 FROM prefixes WHERE n % 5 = 0
            UNION ALL SELECT 'ads', 'prefix', pattern, 0, n % 100 + 200 FROM prefixes WHERE n % 5 = 0
        ), spans AS (
            SELECT list, kind, pattern, added, CAST('2024-01-01' AS TIMESTAMP) + to_days(CAST(day AS INTEGER)) AS valid_from,
                   CAST('2024-01-01' AS TIMESTAMP) + to_days(CAST(lead(day) OVER (PARTITION BY list, kind, pattern ORDER BY day) AS INTEGER)) AS valid_to
            FROM events
        ), keys AS (
            SELECT page_id, fetched_at, 'host' AS kind, host AS pattern FROM captures
            UNION ALL SELECT page_id, fetched_at, 'domain', unnest(list_transform(range(1, len(string_split(host, '.')) + 1),
                lambda i: array_to_string(string_split(host, '.')[i:], '.'))) FROM captures
            UNION ALL SELECT page_id, fetched_at, 'prefix', unnest(list_transform(range(1, len(segments) + 1),
                lambda i: host || '/' || array_to_string(list_slice(segments, 1, i), '/'))) FROM captures
        ), active AS (
            SELECT k.page_id, s.list, s.valid_from FROM keys k JOIN spans s USING (kind, pattern)
            WHERE added = 1 AND s.valid_from <= k.fetched_at AND (s.valid_to IS NULL OR s.valid_to > k.fetched_at)
        ), found AS (
            SELECT page_id, count(*) AS n_entries, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, min(valid_from) AS active_since FROM active GROUP BY 1
        )
        SELECT page_id, fetched_at, coalesce(n_entries, 0) AS n_entries, coalesce(lists, '') AS lists, active_since, n_entries IS NULL AS kept
        FROM captures LEFT JOIN found USING (page_id)
    """,
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_filter_audit": r"""
        WITH judged AS (
            SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY 1
        ), d AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
        ), masks AS (
            SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                   CAST(len(words) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INT)
                   + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
                   + 16 * CAST(coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS INT) AS mask
            FROM d LEFT JOIN judged USING (doc_id)
        ), counts AS (
            SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM masks GROUP BY 1, 2
        ), letters AS (
            SELECT chr(CAST(64 + i AS INT)) AS l, CAST(1 << (i - 1) AS INT) AS bit FROM range(1, 6) AS g(i)
        ), orders AS (
            SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.l, b.l, c.l, d.l, e.l] AS names, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
            FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
        ), steps AS (
            SELECT filter_order, CAST(k AS INT) AS step, names[k] AS filter, bits[k] AS bit, CAST(coalesce(list_sum(bits[1:k - 1]), 0) AS INT) AS earlier FROM orders, range(1, 6) AS g(k)
        ), audit AS (
            SELECT part, filter_order, step, filter,
                   coalesce(sum(n) FILTER (mask & (earlier | bit) = 0), 0) AS kept,
                   coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0) AS removed,
                   coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & earlier <> 0), 0) AS redundant,
                   coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
                   coalesce(sum(n_good) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0) AS good_lost,
                   coalesce(sum(n_toxic) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0) AS toxic_lost
            FROM counts, steps GROUP BY 1, 2, 3, 4
        )
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
               CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley, filter
        FROM audit
    """,
    "op13_centroid_clustering": _centroid_sql(),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
