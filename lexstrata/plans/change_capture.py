"""Ingest, snapshot comparison, versions and change groups."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import snapshots, versions
from .registry import query, table

OLD_SQL = "old AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 7 = 0 THEN text || ' x' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 0)"
NEW_SQL = "new AS (SELECT doc_id, source, lang, text FROM documents WHERE doc_id % 11 <> 0)"
OUTCOMES_SQL = """outcomes AS (
    SELECT doc_id, CASE WHEN o.doc_id IS NULL THEN 'created' WHEN n.doc_id IS NULL THEN 'missing'
                        WHEN o.text IS NOT DISTINCT FROM n.text THEN 'unchanged' ELSE 'updated' END AS outcome,
           coalesce(strlen(o.text), 0) AS bytes_before, coalesce(strlen(n.text), 0) AS bytes_after
    FROM old o FULL JOIN new n USING (doc_id))"""


def old_and_new(spark, d):
    """Two snapshots that follow from doc_id: rows that vanish, appear, change and stay."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "text")
    old = docs.filter("doc_id % 10 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" x"))).otherwise(F.col("text")))
    return old, docs.filter("doc_id % 11 <> 0")


@query(f"""WITH {OLD_SQL}, {NEW_SQL}, joined AS (
    SELECT CASE WHEN o.doc_id IS NULL THEN 'created' WHEN sha256(o.text) = sha256(n.text) THEN 'unchanged' ELSE 'updated' END AS outcome, n.source
    FROM new n LEFT JOIN old o USING (doc_id))
    SELECT source, outcome, count(*) AS documents FROM joined GROUP BY ALL""")
def ingest_unchanged_detection(spark, d):
    old, new = old_and_new(spark, d)
    known = old.select("doc_id", snapshots.content_hash(F.col("text")).alias("content_hash"))
    found = snapshots.fetch_outcomes(new, known, "doc_id", "text")
    return found.join(new.select("doc_id", "source"), "doc_id").groupBy("source", "outcome").agg(F.count(F.lit(1)).alias("documents"))


@query("SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_fingerprint_per_key(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return snapshots.latest_per_key(rows, ["user_id"], "ts", "event_id")


@query(f"""WITH {OLD_SQL}, {NEW_SQL}, fresh AS (
    SELECT source, sha256(text) AS content_hash, doc_id, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS n FROM new)
    SELECT source, content_hash, doc_id FROM fresh WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM old WHERE old.source = fresh.source AND sha256(old.text) = fresh.content_hash)""")
def fingerprint_record_if_absent(spark, d):
    old, new = old_and_new(spark, d)
    hashed = lambda df: df.select("source", snapshots.content_hash(F.col("text")).alias("content_hash"), "doc_id")
    return snapshots.insert_absent(hashed(old), hashed(new), ["source", "content_hash"], "doc_id")


_DECLARED = "CASE doc_id % 7 WHEN 0 THEN 'application/xml' WHEN 1 THEN 'application/json; charset=utf-8' WHEN 2 THEN 'text/html' WHEN 3 THEN 'application/pdf' WHEN 4 THEN 'application/x-zip' WHEN 5 THEN 'application/xhtml+xml' ELSE 'text/plain' END"


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '--' || coalesce(source, 'unknown') || ' (x)/' ELSE coalesce(source, 'unknown') END AS s, CASE WHEN doc_id % 13 = 0 THEN '%PDF' || text ELSE text END AS text, {_DECLARED} AS t FROM documents)
    SELECT doc_id, CASE WHEN text <> '' THEN trim(regexp_replace(s, '[^a-zA-Z0-9._-]+', '-', 'g'), '-') || '/' || strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y/%m/%d') || '/' || sha256(text) || '.'
        || CASE WHEN starts_with(text, 'PK' || chr(3) || chr(4)) THEN 'zip' WHEN starts_with(text, '%PDF') THEN 'pdf' WHEN contains(t, 'xml') THEN 'xml' WHEN contains(t, 'json') THEN 'json' WHEN contains(t, 'html') THEN 'html'
            WHEN contains(t, 'pdf') THEN 'pdf' WHEN contains(t, 'zip') THEN 'zip' ELSE 'bin' END END AS path FROM d""")
def content_address_path(spark, d):
    from ..sources.content_store import address

    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(365)).cast("int"))
    source = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("--"), F.coalesce("source", F.lit("unknown")), F.lit(" (x)/"))).otherwise(F.col("source"))
    content = F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("%PDF"), "text")).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", address(source, day, content, F.expr(_DECLARED)).alias("path"))


@query("""SELECT doc_id, doc_id % 3 <> 0 AND text <> '' AS there, CASE WHEN doc_id % 3 <> 0 AND text <> '' THEN sha256(text) END AS content_sha FROM documents WHERE doc_id IS NOT NULL""")
def store_reads(spark, d):
    """Reads and existence by address, of a store that lacks every third document."""
    from ..sources.content_store import address, held

    docs = table(spark, d, "documents").filter("doc_id is not null")
    path = F.coalesce(address(F.concat(F.lit("s"), F.col("doc_id").cast("string")), F.lit("2024-01-01").cast("date"), F.col("text")), F.lit("/none"))
    store = docs.filter("doc_id % 3 <> 0 and text <> ''").select(path.alias("path"), F.col("text").alias("content"))
    found = held(docs.select("doc_id", F.concat(F.lit("/"), path).alias("path")), store)
    return found.select("doc_id", F.col("exists").alias("there"), F.sha2(F.col("content").cast("binary"), 256).alias("content_sha"))


@query(f"WITH {OLD_SQL}, {NEW_SQL}, {OUTCOMES_SQL} SELECT *, outcome IN ('created', 'updated', 'repealed') AS changes_repository FROM outcomes")
def snapshot_diff_outcomes(spark, d):
    found = snapshots.compare_snapshots(*old_and_new(spark, d), "doc_id", "text")
    return found.withColumn("changes_repository", snapshots.changes_the_repository(F.col("outcome")))


@query(f"WITH {OLD_SQL}, {NEW_SQL} SELECT doc_id, source FROM old ANTI JOIN new USING (doc_id)")
def vanished_documents(spark, d):
    old, new = old_and_new(spark, d)
    return snapshots.missing_from(old, new, "doc_id").select("doc_id", "source")


@query(f"""WITH {OLD_SQL}, {NEW_SQL}, f AS (SELECT lang || '/' || source || '/' || doc_id || '.md' AS path, doc_id FROM old), w AS (SELECT lang || '/' || source || '/' || doc_id || '.md' AS path FROM new)
    SELECT path FROM f WHERE path NOT IN (SELECT path FROM w) AND path NOT LIKE '%/README.md'""")
def orphan_files(spark, d):
    old, new = old_and_new(spark, d)
    path = F.concat("lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path")
    return snapshots.missing_from(old.select(path), new.select(path), "path").filter(~F.col("path").endswith("/README.md"))


@query("""WITH days AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), users AS (SELECT DISTINCT user_id FROM events),
    seen AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), grid AS (
    SELECT u.user_id, d.day, s.user_id IS NOT NULL AS present FROM users u CROSS JOIN days d LEFT JOIN seen s ON s.user_id = u.user_id AND s.day = d.day),
    isl AS (SELECT *, sum(CAST(present AS INT)) OVER (PARTITION BY user_id ORDER BY day) AS i FROM grid)
    SELECT user_id, day, present, CAST(CASE WHEN present THEN 0 ELSE sum(CAST(NOT present AS INT)) OVER (PARTITION BY user_id, i ORDER BY day) END AS INTEGER) AS misses FROM isl""")
def vanish_confirmation_counter(spark, d):
    events = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"))
    days = events.select("day").distinct()
    users = events.select("user_id").distinct()
    # The calendar has a row a day, so the grid is users times days, one explode of a bounded list.
    calendar = days.agg(F.sort_array(F.collect_set("day")).alias("days"))
    grid = users.join(F.broadcast(calendar)).select("user_id", F.explode("days").alias("day"))
    seen = events.distinct().withColumn("present", F.lit(True))
    full = grid.join(seen, ["user_id", "day"], "left").withColumn("present", F.coalesce("present", F.lit(False)))
    return snapshots.absence_streaks(full, "user_id", "day", "present")


@query("""WITH h AS (SELECT user_id, event_id, ts, event_type, sha256(event_type) AS content_hash, lag(sha256(event_type)) OVER w AS before, row_number() OVER w AS r
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, event_id, ts AS valid_from, event_type, content_hash, row_number() OVER w AS version, lead(ts) OVER w AS valid_to
    FROM h WHERE r = 1 OR content_hash IS DISTINCT FROM before WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def scd2_versions(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.col("ts").alias("valid_from"), "event_type")
    found = versions.new_versions(rows, "user_id", "event_type", "valid_from", "event_id")
    return versions.validity(found, "user_id", "valid_from", "valid_from", "event_id")


@query("""WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
    SELECT user_id, max(CASE WHEN n = 2 THEN event_type END) AS before, max(CASE WHEN n = 1 THEN event_type END) AS after FROM r WHERE n <= 2 GROUP BY 1""")
def before_after_versions(spark, d):
    return versions.before_and_after(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id")


@query(f"WITH {OLD_SQL}, {NEW_SQL} SELECT doc_id, CASE WHEN n.doc_id IS NULL THEN 'repealed' ELSE 'in_force' END AS status FROM old LEFT JOIN new n USING (doc_id)")
def mark_vanished_repealed(spark, d):
    old, new = old_and_new(spark, d)
    seen = new.select("doc_id", F.lit("in_force").alias("status"))
    return old.select("doc_id").join(seen, "doc_id", "left").select("doc_id", F.coalesce("status", F.lit("repealed")).alias("status"))


@query("""WITH r AS (SELECT o_custkey AS change_id, o_orderkey, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderpriority END AS note,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
    SELECT change_id, count(*) AS members, first(note ORDER BY o_orderkey) FILTER (note IS NOT NULL) AS note,
        string_agg(CAST(o_orderkey AS VARCHAR), ', ' ORDER BY n) FILTER (n <= 3) || CASE WHEN count(*) > 3 THEN ' und ' || (count(*) - 3) || ' weitere' ELSE '' END AS title
    FROM r GROUP BY 1""")
def change_grouping_first_non_null(spark, d):
    note = F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority"))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("change_id"), "o_orderkey", note.alias("note"))
    return versions.group_changes(rows, "change_id", "o_orderkey", "note", "o_orderkey")


@query("""WITH r AS (SELECT c_mktsegment AS segment, c_name, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n, c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders))
    SELECT segment, string_agg(c_name, ', ' ORDER BY n) FILTER (n <= 3) || CASE WHEN count(*) > 3 THEN ' und ' || (count(*) - 3) || ' weitere' ELSE '' END AS title FROM r GROUP BY 1""")
def change_title_top3(spark, d):
    customers = table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey", "left_semi")
    rows = customers.select(F.col("c_mktsegment").alias("segment"), "c_name", F.lit(None).cast("string").alias("note"), "c_custkey")
    return versions.group_changes(rows, "segment", "c_name", "note", "c_custkey").select("segment", "title")


@query("SELECT doc_id, '2026-01-31-' || lang || '-' || source || '-' || substr(sha256(text), 1, 8) AS change_id FROM documents")
def fallback_change_id(spark, d):
    head = F.substring(snapshots.content_hash(F.col("text")), 1, 8)
    return table(spark, d, "documents").select("doc_id", F.concat_ws("-", F.lit("2026-01-31"), "lang", "source", head).alias("change_id"))


@query("""SELECT CASE WHEN event_type = 'view' THEN NULL ELSE 'c' || (user_id % 40) END AS change_id, count(*) AS commits, count(*) FILTER (event_type = 'signup') AS baseline,
    min(ts) AS first_commit, max(ts) AS last_commit, arg_min(event_id, (ts, event_id)) AS first_event FROM events GROUP BY 1""")
def commit_grouping_counts(spark, d):
    change = F.when(F.col("event_type") != "view", F.concat(F.lit("c"), (F.col("user_id") % 40).cast("string")))
    rows = table(spark, d, "events").withColumn("change_id", change)
    return rows.groupBy("change_id").agg(
        F.count(F.lit(1)).alias("commits"), F.count_if(F.col("event_type") == "signup").alias("baseline"), F.min("ts").alias("first_commit"),
        F.max("ts").alias("last_commit"), F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"),
    )


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)/([a-z]{2,4})/([0-9]+)', 1) AS host, regexp_extract(url, '^https?://([^/?#]+)/([a-z]{2,4})/([0-9]+)', 2) AS lang,
        try_cast(regexp_extract(url, '^https?://([^/?#]+)/([a-z]{2,4})/([0-9]+)', 3) AS BIGINT) AS doc_id FROM pages)
    SELECT DISTINCT p.page_id, p.doc_id, p.lang FROM p JOIN documents d ON d.doc_id = p.doc_id AND d.lang = p.lang""")
def commit_file_norm_join(spark, d):
    pattern = r"^https?://([^/?#]+)/([a-z]{2,4})/([0-9]+)"
    part = lambda k: F.regexp_extract("url", pattern, k)
    files = table(spark, d, "pages").select("page_id", part(2).alias("lang"), F.expr(f"try_cast(regexp_extract(url, '{pattern}', 3) as bigint)").alias("doc_id"))
    return files.join(table(spark, d, "documents").select("doc_id", "lang"), ["doc_id", "lang"]).select("page_id", "doc_id", "lang").distinct()


@query("SELECT conv_id, turn, role AS author, strlen(text) AS bytes FROM conversations WHERE text IS NOT NULL")
def log_record_split(spark, d):
    """Records separated by 0x1e, fields by 0x1f: written and split again."""
    record = F.concat_ws("\x1f", F.col("turn").cast("string"), "role", "text")
    logs = table(spark, d, "conversations").filter("text is not null").groupBy("conv_id").agg(F.array_join(F.collect_list(record), "\x1e").alias("log"))
    fields = F.split("record", "\x1f")
    cut = logs.select("conv_id", F.explode(F.split("log", "\x1e")).alias("record"))
    return cut.select("conv_id", fields[0].cast("long").alias("turn"), fields[1].alias("author"), F.octet_length(fields[2]).cast("long").alias("bytes"))


@query("""SELECT l_orderkey, count(*) AS files, sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_quantity AS BIGINT) END)::BIGINT AS added,
    sum(CAST(l_discount * 100 AS BIGINT))::BIGINT AS removed FROM lineitem GROUP BY 1""")
def numstat_rollup(spark, d):
    """Lines 'added TAB removed TAB path' where a dash (binary file) counts as 0."""
    added = F.when(F.col("l_returnflag") == "R", "-").otherwise(F.col("l_quantity").cast("long").cast("string"))
    lines = table(spark, d, "lineitem").select("l_orderkey", F.concat_ws("\t", added, F.round(F.col("l_discount") * 100).cast("long").cast("string"), F.lit("f")).alias("line"))
    number = lambda k: F.coalesce(F.split("line", "\t")[k].try_cast("long"), F.lit(0))
    return lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("files"), F.sum(number(0)).alias("added"), F.sum(number(1)).alias("removed"))


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type IN ('purchase', 'signup') THEN props END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS author FROM events""")
def blame_forward_fill(spark, d):
    rows = table(spark, d, "events").withColumn("author", F.when(F.col("event_type").isin("purchase", "signup"), F.col("props")))
    return versions.forward_fill(rows, "user_id", "author", "ts", "event_id").select("event_id", "user_id", "author")


@query(f"""WITH {OLD_SQL}, {NEW_SQL}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, -1 AS s FROM old UNION ALL SELECT doc_id, unnest(string_split(text, chr(10))), 1 FROM new),
    b AS (SELECT doc_id, line, sum(s) AS d FROM l GROUP BY ALL)
    SELECT doc_id, sum(greatest(d, 0))::BIGINT AS added, sum(greatest(-d, 0))::BIGINT AS removed FROM b GROUP BY 1""")
def line_diff_counts(spark, d):
    return versions.line_changes(*old_and_new(spark, d), "doc_id", "text")


@query("""SELECT coalesce(s.k, n.k) AS k, coalesce(n.name, s.name) AS name, coalesce(s.health, n.health) AS health FROM
    (SELECT CAST(s_suppkey AS BIGINT) AS k, s_name AS name, s_acctbal AS health FROM supplier) s FULL JOIN (SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, 0.0::DOUBLE AS health FROM nation) n ON s.k = n.k""")
def upsert_registry(spark, d):
    current = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("health"))
    incoming = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"), F.lit(0.0).alias("health"))
    return snapshots.upsert(current, incoming, ["k"], keep=["health"])


@query("SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS place FROM conversations")
def position_numbering(spark, d):
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return table(spark, d, "conversations").select("conv_id", "turn", "role", place.alias("place"))


@query("""WITH s AS (SELECT user_id, event_id, ts, event_type AS stage, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
    SELECT user_id, event_id, before, stage FROM s WHERE before IS DISTINCT FROM stage""")
def stage_history(spark, d):
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").select("user_id", "event_id", F.lag("event_type").over(by).alias("before"), F.col("event_type").alias("stage"))
    return rows.filter(~F.col("before").eqNullSafe(F.col("stage")))


@query("SELECT user_id, max(ts) AS last_ts, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1")
def top1_per_path(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_ts"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 50")
def bounded_scan(spark, d):
    """Top-k report: the first 50 documents of a listing."""
    return table(spark, d, "documents").select("doc_id", "source").orderBy("doc_id").limit(50)


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def listing_desc(spark, d):
    """Top-k report: the newest 100 events."""
    return table(spark, d, "events").select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)


@query("SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, count(*) AS pages, min(page_id) AS first_page FROM pages GROUP BY 1")
def url_path_group_join(spark, d):
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host")
    return table(spark, d, "pages").groupBy(host).agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page"))


@query(f"WITH {OLD_SQL}, {NEW_SQL}, a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM old), b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM new), " + """
    x AS (SELECT doc_id, line, count(*) AS n FROM a GROUP BY ALL), y AS (SELECT doc_id, line, count(*) AS n FROM b GROUP BY ALL),
    z AS (SELECT doc_id, coalesce(x.n, 0) AS p, coalesce(y.n, 0) AS q FROM x FULL JOIN y USING (doc_id, line))
    SELECT doc_id, round(100.0 * sum(least(p, q)) / sum(greatest(p, q)), 2)::DOUBLE AS matched_percent FROM z GROUP BY 1""")
def preview_accuracy(spark, d):
    """Share of lines that two versions have in common, as multisets."""
    count = lambda df, n: df.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias(n))
    old, new = old_and_new(spark, d)
    both = count(old, "p").join(count(new, "q"), ["doc_id", "line"], "full_outer").fillna(0, ["p", "q"])
    share = 100 * F.sum(F.least("p", "q")) / F.sum(F.greatest("p", "q"))
    return both.groupBy("doc_id").agg(F.round(share, 2).alias("matched_percent"))
