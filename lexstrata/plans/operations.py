"""Queue, budget, settling, set operations and scheduling over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import money
from ..operators import decisions, queueing, search, snapshots
from .registry import query, table

NOW = "2024-01-25 12:00:00"
NOW_SQL = f"TIMESTAMP '{NOW}'"


def now():
    return F.lit(NOW).cast("timestamp")


@query("SELECT doc_id, source FROM documents WHERE source IN ('src0', 'src3', 'src7')")
def allow_list_filter(spark, d):
    return table(spark, d, "documents").filter(F.col("source").isin("src0", "src3", "src7")).select("doc_id", "source")


# The stages in order.
STAGES = [
    "detected", "analyzed", "facts_verified", "master_card_written", "card_verified", "cards_translated", "translations_checked",
    "content_change_request_opened", "published", "indexed", "audience_resolved", "notifications_scheduled",
]


@query("""SELECT event_id, event_id % 13 AS stage, event_id % 13 < 12 AND event_id % 13 >= 8 AS at_least_published, event_type IN ('purchase', 'signup') AS publishable,
    event_type = 'purchase' AS published, event_type NOT IN ('error') AS healthy FROM events""")
def stage_predicates(spark, d):
    """Stages compare by their place in the list; needs_review is never at least anything."""
    names = F.array(*map(F.lit, [*STAGES, "needs_review"]))
    order = F.array(*map(F.lit, STAGES))
    stage = names[(F.col("event_id") % 13).cast("int")]
    place = F.array_position(order, stage)
    kind = F.col("event_type")
    return table(spark, d, "events").select(
        "event_id", (F.array_position(names, stage) - 1).alias("stage"), ((place > 0) & (place >= STAGES.index("published") + 1)).alias("at_least_published"),
        kind.isin("purchase", "signup").alias("publishable"), (kind == "purchase").alias("published"), (~kind.isin("error")).alias("healthy"),
    )


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'ordnung') THEN 'verordnung' WHEN contains(lower(text), 'bekanntmachung') THEN 'bekanntmachung' WHEN contains(lower(text), 'satzung') THEN 'satzung'
    WHEN contains(lower(text), 'gesetz') THEN 'gesetz' WHEN source LIKE '%1' THEN 'verordnung' ELSE 'sonstige' END AS kind, contains(lower(lang || ' ' || text), 'weggefallen') OR contains(lower(text), 'aufgehoben') AS repealed FROM documents""")
def keyword_type_classifier(spark, d):
    low = F.lower("text")
    kind = F.when(F.contains(low, F.lit("verordnung")) | F.contains(low, F.lit("ordnung")), "verordnung")
    for word in ("bekanntmachung", "satzung", "gesetz"):
        kind = kind.when(F.contains(low, F.lit(word)), word)
    both = F.lower(F.concat_ws(" ", "lang", "text"))
    return table(spark, d, "documents").select(
        "doc_id", kind.when(F.endswith("source", F.lit("1")), "verordnung").otherwise("sonstige").alias("kind"),
        (F.contains(both, F.lit("weggefallen")) | F.contains(both, F.lit("aufgehoben"))).alias("repealed"),
    )


@query("SELECT event_id, CASE WHEN value < 1 THEN '' ELSE 'v' END || CASE WHEN event_type = 'view' THEN '' ELSE 't' END AS keys, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k FROM events")
def drop_empty_keys(spark, d):
    entries = F.create_map(F.lit("v"), F.when(F.col("value") >= 1, "x"), F.lit("t"), F.when(F.col("event_type") == "view", "").otherwise("y"))
    kept = F.map_filter(entries, lambda _, v: v.isNotNull() & (v != ""))
    number = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return table(spark, d, "events").select("event_id", F.array_join(F.map_keys(kept), "").alias("keys"), F.coalesce(number, F.lit(-1)).alias("k"))


@query(f"""SELECT user_id, coalesce(sum(CAST(value * 100 AS BIGINT)) FILTER (ts >= date_trunc('month', {NOW_SQL})), 0)::BIGINT AS spent,
    CASE WHEN coalesce(sum(CAST(value * 100 AS BIGINT)) FILTER (ts >= date_trunc('month', {NOW_SQL})), 0) >= 400000 THEN 'exceeded'
         WHEN coalesce(sum(CAST(value * 100 AS BIGINT)) FILTER (ts >= date_trunc('month', {NOW_SQL})), 0) >= 320000 THEN 'warning' ELSE 'ok' END AS state FROM events GROUP BY 1""")
def monthly_spend(spark, d):
    this_month = F.when(F.col("ts") >= F.date_trunc("month", now()), F.round(F.col("value") * 100).cast("long"))
    spent = table(spark, d, "events").groupBy("user_id").agg(F.coalesce(F.sum(this_month), F.lit(0)).alias("spent"))
    return spent.withColumn("state", money.budget_state(F.col("spent"), F.lit(400000)))


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority DESC, o_orderdate, o_orderkey) AS n FROM orders) WHERE n <= 50")
def queue_claim_topk(spark, d):
    """Top-k by design: the claim of at most 50 jobs a status."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    return queueing.claim(rows, 80, "o_orderpriority", "o_orderdate", "o_orderkey", by="o_orderstatus").drop("o_orderdate")


KINDS_SQL = "CASE event_type WHEN 'view' THEN 'lease' WHEN 'click' THEN 'lease' WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'cancel' ELSE 'succeed' END"


@query(f"""WITH e AS (SELECT event_id % 3000 AS job, {KINDS_SQL} AS kind, ts, event_id FROM events), f AS (SELECT *, min(CASE WHEN kind IN ('succeed', 'cancel') THEN (ts, event_id) END) OVER (PARTITION BY job) AS final FROM e),
    c AS (SELECT job, count(*) FILTER (kind = 'lease') AS attempts, arg_max(kind, (ts, event_id)) AS last FROM f WHERE final IS NULL OR (ts, event_id) <= final GROUP BY job)
    SELECT job, attempts, CASE last WHEN 'succeed' THEN 'succeeded' WHEN 'cancel' THEN 'cancelled' WHEN 'lease' THEN 'leased' ELSE CASE WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END END AS status FROM c""")
def queue_state_fold(spark, d):
    e = F.col("event_type")
    kind = F.when(e.isin("view", "click"), "lease").when(e == "error", "fail").when(e == "signup", "cancel").otherwise("succeed")
    rows = table(spark, d, "events").select((F.col("event_id") % 3000).alias("job"), kind.alias("kind"), "ts", "event_id")
    return queueing.fold_events(rows, "job", "kind", "ts", "event_id")


@query(f"""SELECT event_id, CASE WHEN event_type = 'click' AND ts + INTERVAL 10 MINUTE < {NOW_SQL} THEN 'pending' WHEN event_type = 'click' THEN 'leased' ELSE 'succeeded' END AS status,
    CASE WHEN event_type = 'click' AND ts + INTERVAL 10 MINUTE < {NOW_SQL} THEN NULL ELSE ts + INTERVAL 10 MINUTE END AS lease_until, event_type = 'view' AND ts < {NOW_SQL} - INTERVAL 60 MINUTE AS fallback FROM events""")
def lease_expiry(spark, d):
    status = F.when(F.col("event_type") == "click", "leased").otherwise("succeeded")
    rows = table(spark, d, "events").select("event_id", "event_type", "ts", status.alias("status"), (F.col("ts") + F.make_dt_interval(mins=F.lit(10))).alias("lease_until"))
    fallback = (F.col("event_type") == "view") & queueing.stale(F.col("ts"), now(), 60)
    return queueing.release_expired(rows, now()).select("event_id", "status", "lease_until", fallback.alias("fallback"))


@query(f"""SELECT event_id, ts AS created_at FROM events WHERE event_type = 'view' AND ts < {NOW_SQL} - INTERVAL 60 MINUTE ORDER BY ts, event_id LIMIT 50""")
def stale_jobs(spark, d):
    """Top-k by design: the 50 oldest jobs that are pending for over an hour."""
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "view", "pending").otherwise("succeeded").alias("status"), F.col("ts").alias("created_at"))
    return queueing.stale_jobs(rows, now(), 60, "status", "created_at", "event_id").select("event_id", "created_at")


@query(f"SELECT user_id, min(ts) AS settling_started_at FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING min(ts) <= {NOW_SQL} - INTERVAL 72 HOUR ORDER BY 2, 1 LIMIT 50")
def settled_next(spark, d):
    """Top-k by design: the 50 changes that settled first."""
    return queueing.next_settled(table(spark, d, "events").filter("event_type = 'purchase'"), "user_id", "ts", now())


@query()
def queue_with_clocks(spark, d):
    """Each job's state with leases of two hours and a fallback after three days, at the end."""
    e = F.col("event_type")
    kind = F.when(e.isin("view", "click"), "lease").when(e == "error", "fail").when(e == "signup", "extend").otherwise("succeed")
    rows = table(spark, d, "events").select((F.col("event_id") % 3000).alias("job"), kind.alias("kind"), "ts", "event_id")
    return queueing.timed_fold(rows, "job", "kind", "ts", "event_id", now(), lease_seconds=7200, fallback_minutes=4320)


@query()
def cache_with_expiry(spark, d):
    """Requests of a user for one kind of page, answered from a cache that keeps a day."""
    rows = table(spark, d, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("fingerprint"), "event_id", "ts")
    return decisions.cache_hits(rows, "fingerprint", "event_id", "ts", 86_400)


@query("SELECT event_type, count(*) AS pending, count(*) FILTER (value > 50) AS failed FROM events GROUP BY 1")
def pending_count(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("pending"), F.count_if(F.col("value") > 50).alias("failed"))


@query(f"SELECT user_id, min(ts) AS settling_started_at FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING min(ts) <= {NOW_SQL} - INTERVAL 72 HOUR")
def settled_changes(spark, d):
    return queueing.settled(table(spark, d, "events").filter("event_type = 'purchase'"), "user_id", "ts", now())


@query("SELECT conv_id, min(turn) FILTER (role = 'assistant') AS accepted, count(*) AS made FROM conversations GROUP BY 1")
def accepted_attempt(spark, d):
    rows = table(spark, d, "conversations").withColumn("valid", F.col("role") == "assistant")
    return queueing.accepted_attempts(rows, "conv_id", "turn", "valid")


@query("""WITH r AS (SELECT doc_id, sha256(coalesce(lang, '') || chr(0) || coalesce(text, '')) AS fingerprint FROM documents), c AS (SELECT fingerprint, min(doc_id) AS answer FROM r WHERE doc_id % 3 = 0 GROUP BY 1)
    SELECT doc_id, c.answer, c.answer IS NOT NULL AS hit FROM r LEFT JOIN c USING (fingerprint)""")
def response_cache_join(spark, d):
    fields = F.concat_ws("\0", F.coalesce("lang", F.lit("")), F.coalesce("text", F.lit("")))  # null fields must keep their place
    rows = table(spark, d, "documents").select("doc_id", F.sha2(fields.cast("binary"), 256).alias("fingerprint"))
    cache = rows.filter("doc_id % 3 = 0").groupBy("fingerprint").agg(F.min("doc_id").alias("answer"))
    return rows.join(cache, "fingerprint", "left").select("doc_id", "answer", F.col("answer").isNotNull().alias("hit"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a:x,a:y,b:z' WHEN 1 THEN 'b:z' WHEN 2 THEN 'a:y' ELSE 'a:x' END AS chain FROM part""")
def model_chain_preference(spark, d):
    whole, own, single = (F.array(*map(F.lit, c)) for c in (("a:x", "a:y", "b:z"), ("a:x", "a:y"), ("a:x",)))
    k = F.col("p_partkey") % 4
    chain = F.when(k <= 1, whole).when(k == 2, own).otherwise(single)
    avoid = F.when(k > 0, F.lit("a:x"))
    return table(spark, d, "part").select("p_partkey", F.array_join(queueing.preferred_models(chain, avoid), ",").alias("chain"))


@query("""WITH s AS (SELECT source, lang, count(*) AS n, count(DISTINCT text) AS texts FROM documents GROUP BY ALL)
    SELECT source, sum(n)::BIGINT AS documents, string_agg(lang || ':' || n, ',' ORDER BY lang) AS by_lang, max(n) AS largest FROM s GROUP BY 1""")
def facet_counts(spark, d):
    per = table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    parts = F.array_join(F.array_sort(F.collect_list(F.concat("lang", F.lit(":"), F.col("n").cast("string")))), ",")
    return per.groupBy("source").agg(F.sum("n").alias("documents"), parts.alias("by_lang"), F.max("n").alias("largest"))


@query("""WITH w AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents)
    SELECT word, count(*) AS documents, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM w WHERE length(word) > 2 GROUP BY 1""")
def inverted_index(spark, d):
    # Ids are unique, so a document is one row of each of its words and counting rows is enough.
    words = table(spark, d, "documents").select("doc_id", F.explode(F.filter(F.array_distinct(F.split(F.lower("text"), "[^a-z]+")), lambda w: F.length(w) > 2)).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


SYNONYMS = (("the", "der"), ("und", "and"), ("Le", "el"))


@query(r"""WITH syn(word, synonym) AS (VALUES ('the', 'der'), ('und', 'and'), ('le', 'el')), pairs AS (SELECT word AS a, synonym AS b FROM syn UNION ALL SELECT synonym, word FROM syn),
    d AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents WHERE doc_id IS NOT NULL), n AS (SELECT count(*) AS n, avg(coalesce(len(w), 0)) AS avg FROM d),
    t AS (SELECT id, len(w) AS length, unnest(w) AS term FROM d), p AS (SELECT term, id, length, count(*) AS c FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS documents FROM p GROUP BY 1),
    own AS (SELECT conv_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')[1:5])) AS term FROM conversations WHERE turn = 1 AND conv_id IS NOT NULL),
    q AS (SELECT * FROM own UNION SELECT conv_id, b FROM own JOIN pairs ON term = a),
    s AS (SELECT conv_id, id, round(sum(ln(1 + (n.n - documents + 0.5) / (documents + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * length / n.avg))), 9) AS score FROM q JOIN df USING (term) JOIN p USING (term), n GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, id) AS place FROM s)
    SELECT conv_id, CAST(place AS INTEGER) AS place, id, round(score, 6) AS score FROM r WHERE place <= 10""")
def ranked_search(spark, d):
    """Top-k report: the ten best documents for the first words of each conversation."""
    index = search.build_index(table(spark, d, "documents"), "doc_id", "text")
    asked = table(spark, d, "conversations").filter("turn = 1").select("conv_id", F.array_join(F.slice(search.words(F.col("text")), 1, 5), " ").alias("text"))
    pairs = spark.sql("SELECT inline(array(" + ", ".join(f"struct('{a}' AS word, '{b}' AS synonym)" for a, b in SYNONYMS) + "))")
    return search.search(index, asked, "conv_id", "text", 10, pairs).withColumn("score", F.round("score", 6))


@query("SELECT p_brand, max(try_cast(regexp_extract(p_type || ' v' || p_size, 'v(\\d+)', 1) AS INTEGER)) AS version FROM part GROUP BY 1")
def latest_template_version(spark, d):
    name = F.concat("p_type", F.lit(" v"), F.col("p_size").cast("string"))
    rows = table(spark, d, "part").select("p_brand", F.regexp_extract(name, r"v(\d+)", 1).try_cast("int").alias("version"))
    return rows.groupBy("p_brand").agg(F.max("version").alias("version"))


@query("""WITH w AS (SELECT doc_id, string_split(text, ' ') AS a FROM documents)
    SELECT doc_id, len(list_distinct(a)) AS distinct_words, len(list_filter(a, lambda x: x IN ('the', 'der', 'de'))) AS kept_multiplicity,
        list_contains(a, 'the') AS has_the, length(array_to_string(a, ' ')) AS joined FROM w""")
def ordered_distinct(spark, d):
    """Distinct in order of first appearance, and an intersection that keeps repeats."""
    words = F.split("text", " ")
    bag = F.filter(words, lambda x: x.isin("the", "der", "de"))
    return table(spark, d, "documents").select(
        "doc_id", F.size(F.array_distinct(words)).cast("long").alias("distinct_words"), F.size(bag).cast("long").alias("kept_multiplicity"),
        F.array_contains(words, "the").alias("has_the"), F.length(F.array_join(words, " ")).cast("long").alias("joined"),
    )


@query("""SELECT doc_id, source || ',all' || CASE WHEN lang <> source THEN ',' || lang ELSE '' END AS labels, 'b' AS merged, lang AS unknown FROM documents""")
def map_merge_precedence(spark, d):
    """Label union in order; of two maps the later value wins; tags outside a vocabulary."""
    labels = F.array_union(F.array("source", F.lit("all")), F.array("lang", F.lit("all")))
    first, second = F.create_map(F.lit("k"), F.lit("a")), F.create_map(F.lit("k"), F.lit("b"))
    keys = F.array_union(F.map_keys(first), F.map_keys(second))
    merged = F.transform(keys, lambda k: F.coalesce(F.try_element_at(second, k), F.try_element_at(first, k)))
    unknown = F.filter(F.array("lang", "source"), lambda t: ~t.startswith("src"))
    return table(spark, d, "documents").select("doc_id", F.array_join(labels, ",").alias("labels"), merged[0].alias("merged"), F.array_join(unknown, ",").alias("unknown"))


@query("""SELECT l_orderkey, bool_and(l_linestatus = 'F') AND count(*) > 0 AS all_finished, count(*) AS seen, count(*) FILTER (l_returnflag = 'R') AS failed,
    count(*) FILTER (l_returnflag = 'A') AS changed, count(*) FILTER (l_returnflag = 'R') + count(*) FILTER (l_linestatus = 'F' AND l_returnflag <> 'R') >= count(*) AS finished FROM lineitem GROUP BY 1""")
def all_members_predicate(spark, d):
    failed, done = F.col("l_returnflag") == "R", (F.col("l_linestatus") == "F") & (F.col("l_returnflag") != "R")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.every(F.col("l_linestatus") == "F").alias("all_finished"), F.count(F.lit(1)).alias("seen"), F.count_if(failed).alias("failed"),
        F.count_if(F.col("l_returnflag") == "A").alias("changed"), (F.count_if(failed) + F.count_if(done) >= F.count(F.lit(1))).alias("finished"),
    )


@query("""SELECT c_custkey, n_name AS nation, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Bau' ELSE c_mktsegment END AS label, coalesce(c_acctbal > 0, FALSE) AS enabled,
    md5('t' || c_custkey) IN (SELECT md5('t' || s_suppkey) FROM supplier WHERE s_acctbal > 0) AS active FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")
def taxonomy_lookup(spark, d):
    """Vocabulary lookup, localised name with fallback, preference default, active tokens."""
    names = F.create_map(F.lit("BUILDING"), F.lit("Bau"))
    tokens = table(spark, d, "supplier").filter("s_acctbal > 0").select(F.sha2(F.concat(F.lit("t"), F.col("s_suppkey").cast("string")), 256).alias("token"), F.lit(True).alias("_active")).distinct()
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    rows = table(spark, d, "customer").withColumn("token", F.sha2(F.concat(F.lit("t"), F.col("c_custkey").cast("string")), 256))
    joined = rows.join(nation, "c_nationkey", "left").join(tokens, "token", "left")
    label = F.coalesce(F.try_element_at(names, F.col("c_mktsegment")), F.col("c_mktsegment"))
    return joined.select("c_custkey", "nation", label.alias("label"), F.coalesce(F.col("c_acctbal") > 0, F.lit(False)).alias("enabled"), F.coalesce("_active", F.lit(False)).alias("active"))


@query(f"SELECT event_id, ts, event_type FROM events WHERE ts >= {NOW_SQL} - to_days(CASE event_type WHEN 'view' THEN 7 WHEN 'click' THEN 14 ELSE 30 END)")
def retention_purge(spark, d):
    keep = F.when(F.col("event_type") == "view", 7).when(F.col("event_type") == "click", 14).otherwise(30)
    return table(spark, d, "events").filter(F.col("ts") >= now() - F.make_dt_interval(days=keep)).select("event_id", "ts", "event_type")


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) > 1 AS mixed_attribution, count(DISTINCT o_orderpriority) AS acts FROM orders GROUP BY 1")
def mixed_attribution(spark, d):
    acts = F.countDistinct("o_orderpriority")
    return table(spark, d, "orders").groupBy("o_custkey").agg((acts > 1).alias("mixed_attribution"), acts.alias("acts"))


@query("""SELECT doc_id, round(least(score, CASE WHEN single THEN 0.85 ELSE 1.0 END), 4)::DOUBLE AS score, CASE WHEN toxic = 1 THEN 'needs_review' WHEN least(score, CASE WHEN single THEN 0.85 ELSE 1.0 END) >= 0.8 THEN 'auto_published' ELSE 'draft' END AS state
    FROM (SELECT doc_id, toxic, (doc_id % 100) / 100.0 AS score, doc_id % 2 = 0 AS single FROM labels)""")
def review_policy(spark, d):
    capped = F.least((F.col("doc_id") % 100) / 100, F.when(F.col("doc_id") % 2 == 0, 0.85).otherwise(1.0))
    state = F.when(F.col("toxic") == 1, "needs_review").when(capped >= 0.8, "auto_published").otherwise("draft")
    return table(spark, d, "labels").select("doc_id", F.round(capped, 4).alias("score"), state.alias("state"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS transitions FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type GROUP BY 1")
def status_transition_last(spark, d):
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    moved = table(spark, d, "events").withColumn("b", F.lag("event_type").over(by)).filter(~F.col("b").eqNullSafe(F.col("event_type")))
    return moved.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count(F.lit(1)).alias("transitions"))


@query("SELECT user_id || '|' || event_type || '|' || CAST(CAST(ts AS DATE) AS VARCHAR) AS idempotency_key, min(event_id) AS event_id FROM events GROUP BY 1")
def batch_replay_idempotent(spark, d):
    """The same events twice give the same messages as once."""
    events = table(spark, d, "events")
    key = F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.to_date("ts").cast("string"))
    twice = events.unionByName(events).select(key.alias("idempotency_key"), "event_id")
    return twice.groupBy("idempotency_key").agg(F.min("event_id").alias("event_id"))


@query("SELECT lang FROM (SELECT DISTINCT lang FROM documents) WHERE lang NOT IN ('en', 'de')")
def baseline_guard(spark, d):
    """One-time imports: only jurisdictions without a marker are left to import."""
    done = spark.createDataFrame([("en",), ("de",)], "lang string")
    return snapshots.missing_from(table(spark, d, "documents").select("lang").distinct(), done, "lang")


@query("SELECT event_type AS queue, count(*) FILTER (value > 80) AS failed, count(*) FILTER (value > 80) = 0 AS ready FROM events GROUP BY 1")
def failed_queue_health(spark, d):
    bad = F.count_if(F.col("value") > 80)
    return table(spark, d, "events").groupBy(F.col("event_type").alias("queue")).agg(bad.alias("failed"), (bad == 0).alias("ready"))


@query("""SELECT page_id, host, TIMESTAMP '2024-01-01' + to_seconds(row_number() OVER (PARTITION BY host ORDER BY page_id) - 1) AS fetch_at FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages)""")
def rate_limit_schedule(spark, d):
    """One request a second and host."""
    rows = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"))
    place = F.row_number().over(Window.partitionBy("host").orderBy("page_id")) - 1
    return rows.select("page_id", "host", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=place.cast("decimal(18,6)"))).alias("fetch_at"))


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1), ''), '/') AS path FROM pages),
    h AS (SELECT host, arg_min(regexp_extract(path, '^/[^/]*', 0), page_id) AS rule, min(page_id) AS n FROM p WHERE host <> '' GROUP BY 1)
    SELECT page_id, p.host, path FROM p LEFT JOIN h ON p.host = h.host WHERE h.host IS NULL OR n % 3 = 2 OR NOT starts_with(path, CASE n % 3 WHEN 0 THEN rule ELSE rule || '/' END)""")
def robots_filter(spark, d):
    """Paths that their own host's file allows. Each file bans the first folder of the host's
    first page, for all agents, for ours only, or for another one."""
    from ..sources.robots import allowed, parse_robots

    path = F.coalesce(F.nullif(F.regexp_extract("url", "^[a-z]+://[^/?#]+(/[^?#]*)", 1), F.lit("")), F.lit("/"))
    rows = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), path.alias("path"))
    first = rows.filter("host <> ''").groupBy("host").agg(F.min_by(F.regexp_extract("path", "^/[^/]*", 0), "page_id").alias("rule"), F.min("page_id").alias("n"))
    text = (
        F.when(F.col("n") % 3 == 0, F.concat(F.lit("# all\nUser-agent: *\nDisallow: "), "rule", F.lit(" # here\nCrawl-delay: 2\n")))
        .when(F.col("n") % 3 == 1, F.concat(F.lit("User-agent: *\r\nDisallow: /\r\nUser-Agent: OurBot\r\nDisallow:\r\nDisallow: "), "rule", F.lit("/\r\n")))
        .otherwise(F.concat(F.lit("User-agent: ourbot\nAllow: /\nUser-agent: other\nDisallow: "), "rule"))
    )
    return allowed(rows, parse_robots(first.select("host", text.alias("robots")), "robots", "OurBot/2.1 (+https://bot.example)"), "path", ("host",))


@query("""WITH w AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
    c AS (SELECT doc_id, CAST(floor((sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(line) - 1) / 500) AS BIGINT) AS chunk, line FROM w)
    SELECT doc_id, chunk, count(*) AS lines, sum(length(line))::BIGINT AS characters FROM c GROUP BY ALL""")
def diff_chunking(spark, d):
    """Lines to chunks of about 500 characters for a map step; lines are never cut."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    before = F.sum(F.length("line") + 1).over(Window.partitionBy("doc_id").orderBy("n")) - F.length("line") - 1
    return lines.withColumn("chunk", F.floor(before / 500)).groupBy("doc_id", "chunk").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("characters"))
