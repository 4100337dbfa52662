"""Decisions over the driver tables: predicates, budgets, fetches, repairs, rebuilding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import budget_state
from ..operators import decisions, derived, snapshots
from .registry import query, table


def _pick(names: list[str], index):
    return F.get(F.array(*map(F.lit, names)), index.cast("int"))


def _sql_pick(names: list[str], index: str) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + f"][CAST({index} AS INTEGER) + 1]"


@query("SELECT doc_id, doc_id % 3 <> 0 AND NOT contains(text, 'ist berücksichtigt') AS pending FROM documents")
def pending_amendments(spark, d):
    note = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" ist berücksichtigt"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", decisions.is_pending(note).alias("pending"))


TASKS = ["promulgation_extract", "bill_summarize", "amendment_apply", "digest_write", "card_write", "law_topics", "card_verify"]
KINDS = ["change_direct", "effective_reminder", "bill_update", "weekly_digest", "correction"]
LEGISLATIVE = ["discussed", "adopted", "promulgated", "rejected", "withdrawn"]
REQUESTS = ["official", "preview", "draft", "content"]


@query(f"""WITH o AS (SELECT o_orderkey AS k, {_sql_pick(TASKS, 'o_orderkey % 7')} AS task, {_sql_pick(KINDS, 'o_custkey % 5')} AS kind,
        {_sql_pick(LEGISLATIVE, 'o_orderkey % 5')} AS stage, {_sql_pick(REQUESTS, 'o_custkey % 4')} AS request FROM orders)
    SELECT k AS o_orderkey, task IN ('promulgation_extract', 'amendment_apply', 'change_analyze', 'card_write', 'card_verify') AS critical, kind IN ('change_direct', 'bill_update', 'correction') AS instant,
        stage IN ('rejected', 'withdrawn') AS final_negative, request = 'official' AS auto_merged, k % 3 = 0 AS nationwide FROM o""")
def kind_predicates(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    lands = F.when(k % 3 > 0, F.array(F.lit("by")))
    return table(spark, d, "orders").select(
        "o_orderkey", decisions.one_of(_pick(TASKS, k % 7), decisions.CRITICAL_TASKS).alias("critical"), decisions.one_of(_pick(KINDS, c % 5), decisions.INSTANT_KINDS).alias("instant"),
        decisions.one_of(_pick(LEGISLATIVE, k % 5), decisions.FINAL_NEGATIVE_STAGES).alias("final_negative"),
        decisions.one_of(_pick(REQUESTS, c % 4), decisions.AUTO_MERGED_KINDS).alias("auto_merged"), decisions.is_nationwide(lands).alias("nationwide"),
    )


@query("""WITH p AS (SELECT p_partkey, [p_brand, 'stage', p_type, 'id', p_name, CASE WHEN p_size % 2 = 0 THEN 'dates' ELSE 'topics' END] AS f FROM part),
    k AS (SELECT p_partkey, f, list_filter(['id', 'kind', 'stage', 'dates', 'amounts', 'audience', 'topics'], lambda x: list_contains(f, x)) AS known FROM p)
    SELECT p_partkey, array_to_string(list_concat(known, list_filter(f, lambda x: NOT list_contains(known, x))), ',') AS fields FROM k""")
def field_order(spark, d):
    last = F.when(F.col("p_size") % 2 == 0, "dates").otherwise("topics")
    fields = F.array("p_brand", F.lit("stage"), "p_type", F.lit("id"), "p_name", last)
    return table(spark, d, "part").select("p_partkey", F.array_join(decisions.ordered_fields(fields), ",").alias("fields"))


@query(f"""WITH o AS (SELECT o_orderkey AS k, o_totalprice / 200000 AS ratio, {_sql_pick(TASKS, 'o_orderkey % 7')} AS task FROM orders)
    SELECT k AS o_orderkey, CASE WHEN ratio >= 1 THEN 'exceeded' WHEN ratio >= 0.8 THEN 'warning' ELSE 'ok' END AS state,
        CASE WHEN ratio < 1 THEN TRUE WHEN k % 2 = 0 THEN task IN ('promulgation_extract', 'amendment_apply', 'card_write', 'card_verify') ELSE k % 3 = 0 END AS allowed FROM o""")
def budget_policy(spark, d):
    k = F.col("o_orderkey")
    state = budget_state(F.col("o_totalprice"), F.lit(200000.0))
    allowed = decisions.may_run(state, F.when(k % 2 == 0, "pause").otherwise("degrade"), _pick(TASKS, k % 7), k % 3 == 0)
    return table(spark, d, "orders").select("o_orderkey", state.alias("state"), allowed.alias("allowed"))


@query("""WITH e AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 304 WHEN 1 THEN 404 WHEN 2 THEN 503 WHEN 3 THEN NULL ELSE 200 END AS status, sha256(event_type) AS h,
        CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN sha256('view') ELSE sha256(event_type) END AS known FROM events)
    SELECT event_id, CASE WHEN status IS NULL OR status >= 400 THEN 'failed' WHEN status = 304 THEN 'not_modified' WHEN known IS NULL THEN 'new' WHEN h = known THEN 'unchanged' ELSE 'changed' END AS outcome,
        CASE WHEN status >= 200 AND status < 300 THEN 'rules' WHEN status >= 400 AND status < 500 THEN 'all' ELSE 'nothing' END AS robots FROM e""")
def fetch_decisions(spark, d):
    k = F.col("event_id")
    status = F.when(k % 7 == 0, 304).when(k % 7 == 1, 404).when(k % 7 == 2, 503).when(k % 7 == 3, F.lit(None)).otherwise(200)
    found = snapshots.content_hash(F.col("event_type"))
    known = F.when(k % 4 == 0, F.lit(None).cast("string")).when(k % 4 == 1, snapshots.content_hash(F.lit("view"))).otherwise(found)
    return table(spark, d, "events").select("event_id", decisions.fetch_outcome(status, found, known).alias("outcome"), decisions.robots_answer(status).alias("robots"))


@query("""WITH days AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), seen AS (SELECT user_id, max(CAST(ts AS DATE)) AS last FROM events GROUP BY 1)
    SELECT user_id, (SELECT count(*) FROM days WHERE day > last) AS misses, (SELECT count(*) FROM days WHERE day > last) >= 3 AND user_id % 2 = 0 AS repealed FROM seen""")
def confirmed_missing(spark, d):
    """Days since the last sighting; three of them and a source that says "gone" repeal."""
    events = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"))
    calendar = events.select("day").distinct().agg(F.sort_array(F.collect_set("day")).alias("days"))  # a row a day
    last = events.groupBy("user_id").agg(F.max("day").alias("last")).join(F.broadcast(calendar))
    misses = F.size(F.filter("days", lambda x: x > F.col("last"))).cast("long")
    return last.select("user_id", misses.alias("misses"), decisions.confirmed_missing(misses, F.col("user_id") % 2 == 0).alias("repealed"))


@query("""WITH a AS (SELECT l_orderkey, (l_linenumber - 1) // 4 AS place, row_number() OVER (PARTITION BY l_orderkey, (l_linenumber - 1) // 4 ORDER BY l_linenumber, l_quantity) AS n, l_quantity > 40 AS valid FROM lineitem),
    m AS (SELECT * FROM a WHERE n <= 3), f AS (SELECT l_orderkey, min(place * 100 + n) FILTER (valid) AS best FROM m GROUP BY 1)
    SELECT l_orderkey, CAST(best // 100 AS INTEGER) AS place, CAST(best % 100 AS INTEGER) AS attempt, (SELECT count(*) FROM m WHERE m.l_orderkey = f.l_orderkey AND (best IS NULL OR place * 100 + n <= best)) AS made FROM f""")
def repair_loop(spark, d):
    place = F.expr("(l_linenumber - 1) div 4").cast("int")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", place.alias("place"), (F.col("l_quantity") > 40).alias("valid"))
    return decisions.accepted_answers(rows, "l_orderkey", "place", ["l_linenumber", "l_quantity"], "valid").select("l_orderkey", "place", "attempt", F.col("made").cast("long").alias("made"))


@query("""WITH r AS (SELECT user_id, arg_max(CASE WHEN event_type = 'error' THEN 'none' ELSE event_type END, (ts, event_id)) AS state FROM events GROUP BY 1)
    SELECT user_id, state AS replayed, state AS stepwise FROM r WHERE state <> 'none'""")
def rebuild_all(spark, d):
    """A derived table replayed from the whole log, beside the one kept by two upserts."""
    log = table(spark, d, "events").withColumn("state", F.when(F.col("event_type") != "error", F.col("event_type")))
    half = F.lit("2024-01-15").cast("timestamp")
    last = lambda rows: rows.groupBy("user_id").agg(F.max_by(F.coalesce("state", F.lit("none")), F.struct("ts", "event_id")).alias("state"))
    kept = snapshots.upsert(last(log.filter(F.col("ts") < half)), last(log.filter(F.col("ts") >= half)), ["user_id"], []).filter("state <> 'none'")
    return decisions.rebuilt(log, "user_id", "state", ["ts", "event_id"]).join(kept.withColumnRenamed("state", "stepwise"), "user_id", "full_outer").select("user_id", F.col("state").alias("replayed"), "stepwise")


EVENT_TABLES = {
    "days": derived.Derived(("events",), lambda e: e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))),
    "users": derived.Derived(("days",), lambda d: d.groupBy("user_id").agg(F.sum("n").alias("n"), F.max("n").alias("busiest"))),
    "loads": derived.Derived(("users", "days"), lambda u, d: d.join(u.select("user_id", "busiest"), "user_id").filter("n = busiest").groupBy("day").agg(F.count(F.lit(1)).alias("users"))),
    "ranks": derived.Derived(("users",), lambda u: u.groupBy("busiest").agg(F.count(F.lit(1)).alias("users"))),
}


@query("""WITH days AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL), users AS (SELECT user_id, sum(n) AS n, max(n) AS busiest FROM days GROUP BY 1),
    loads AS (SELECT day FROM users JOIN days USING (user_id) WHERE days.n = busiest GROUP BY 1), ranks AS (SELECT busiest FROM users GROUP BY 1)
    SELECT 'days' AS "table", (SELECT count(*) FROM days) AS rows, (SELECT count(*) FROM days) AS kept_rows, 'equal' AS status UNION ALL SELECT 'users', (SELECT count(*) FROM users), (SELECT count(*) FROM users), 'differs'
    UNION ALL SELECT 'loads', (SELECT count(*) FROM loads), (SELECT count(*) FROM loads), 'equal' UNION ALL SELECT 'ranks', (SELECT count(*) FROM ranks), NULL, 'missing'""")
def derived_tables(spark, d):
    """Tables replayed from the log beside kept ones, of which one holds a wrong number and one is lost."""
    made = derived.rebuilt(EVENT_TABLES, {"events": table(spark, d, "events")})
    spoilt = made["users"].withColumn("n", F.col("n") + F.when(F.col("user_id") == made["users"].agg(F.min("user_id")).first()[0], 1).otherwise(0))
    return derived.compared(spark, made, {"days": made["days"].repartition(3), "users": spoilt, "loads": made["loads"]})
