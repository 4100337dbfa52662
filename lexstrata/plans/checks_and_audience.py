"""Quality rules, audience matching and notification plans over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import encoding_issues, html_outside
from ..operators import audience, card_checks, notifications, quality, snapshots
from .change_capture import NEW_SQL, OLD_SQL, OUTCOMES_SQL, old_and_new
from .registry import query, table

SHORT_NEW_SQL = "new AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 13 = 0 THEN '' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0)"


def _shortened(spark, d):
    old, new = old_and_new(spark, d)
    return old, new.withColumn("text", F.when(F.col("doc_id") % 13 == 0, "").otherwise(F.col("text")))


@query(f"""WITH {OLD_SQL}, {SHORT_NEW_SQL}, {OUTCOMES_SQL} SELECT CAST(doc_id AS VARCHAR) AS subject, 'error' AS severity, 'law_text_deleted' AS code, NULL::VARCHAR AS path FROM outcomes
    WHERE outcome <> 'repealed' AND bytes_before > 0 AND greatest(0.0, (bytes_before - bytes_after) / bytes_before) > 0.4 AND doc_id % 17 <> 0""")
def deletion_ratio_guard(spark, d):
    outcomes = snapshots.compare_snapshots(*_shortened(spark, d), "doc_id", "text")
    repealed = table(spark, d, "documents").filter("doc_id % 17 = 0").select("doc_id")
    return quality.deletion_issues(outcomes, "doc_id", repealed_at_source=repealed)


@query(f"""WITH {OLD_SQL}, {NEW_SQL}, {OUTCOMES_SQL}, g AS (SELECT lang, outcome FROM outcomes JOIN documents USING (doc_id))
    SELECT lang AS subject, 'error' AS severity, 'too_many_laws_changed' AS code, NULL::VARCHAR AS path FROM g GROUP BY lang
    HAVING count(*) >= 20 AND count(*) FILTER (outcome IN ('created', 'updated', 'repealed')) / count(*) > 0.2""")
def changed_ratio_guard(spark, d):
    outcomes = snapshots.compare_snapshots(*old_and_new(spark, d), "doc_id", "text")
    return quality.run_size_issues(outcomes.join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id"), "lang", 0.2)


@query("SELECT DISTINCT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def fact_quote_check(spark, d):
    """Which benchmark passages a document quotes: word index first, then containment."""
    return quality.phrase_matches(table(spark, d, "documents"), table(spark, d, "benchmark"), "text", "text", "doc_id", "item_id").distinct()


@query("""SELECT doc_id, w.word FROM documents, (VALUES ('the and'), ('der'), ('not legal advice at all')) w(word) WHERE contains(text, w.word)""")
def forbidden_wording(spark, d):
    phrases = spark.createDataFrame([("the and",), ("der",), ("not legal advice at all",)], "word string").withColumn("id", F.col("word"))
    found = quality.phrase_matches(table(spark, d, "documents"), phrases, "text", "word", "doc_id", "id")
    return found.select("doc_id", F.col("id").alias("word"))


@query("""WITH g AS (SELECT DISTINCT word AS term, CASE WHEN length(word) % 3 = 0 THEN word ELSE upper(word) END AS rendering
        FROM (SELECT string_split(text, ' ')[2] || ' ' || string_split(text, ' ')[3] || ' ' || string_split(text, ' ')[4] || ' ' || string_split(text, ' ')[5] AS word FROM benchmark)),
    c AS (SELECT doc_id, text AS master, CASE WHEN doc_id % 2 = 0 THEN text ELSE upper(text) END AS translation FROM documents)
    SELECT CAST(doc_id AS VARCHAR) AS subject, 'warning' AS severity, 'translation.glossary_term_missing' AS code, NULL::VARCHAR AS path
    FROM c JOIN g ON contains(master, term) WHERE NOT contains(translation, rendering)""")
def glossary_missing(spark, d):
    """Terms a text mentions whose expected rendering is not in its translation: here the
    translation is the text itself or its capitals, and so is the rendering of a term."""
    words = F.split("text", " ")
    term = F.concat_ws(" ", *[F.get(words, F.lit(k)) for k in range(1, 5)])
    terms = table(spark, d, "benchmark").filter(F.size(words) >= 5).select(term.alias("term")).distinct()
    glossary = terms.withColumn("rendering", F.when(F.length("term") % 3 == 0, F.col("term")).otherwise(F.upper("term")))
    other = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.upper("text"))
    cards = table(spark, d, "documents").filter("text is not null").select("doc_id", F.create_map(F.lit("summary"), "text").alias("master"), F.create_map(F.lit("summary"), other).alias("translation"))
    return card_checks.glossary_issues(cards, glossary, "doc_id")


@query("""WITH q AS (SELECT l_orderkey, l_linenumber, l_quantity AS v, CAST(CAST(l_quantity + CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS VARCHAR) AS s FROM lineitem),
    w AS (SELECT *, CAST(CAST(v AS BIGINT) AS VARCHAR) AS i, CASE WHEN l_linenumber % 2 = 0 THEN s || ',5' ELSE s || '.25' END AS h FROM q)
    SELECT l_orderkey, l_linenumber, contains(s, i) AS whole, contains(h, CAST(CAST(round(v + 0.5) AS BIGINT) AS VARCHAR)) OR contains(h, i || '.5') OR contains(h, i || ',5') AS half FROM w""")
def value_in_quote(spark, d):
    """Quotes of a value, one in three of another value; halves written with a comma or as quarters."""
    v, n = F.col("l_quantity"), F.col("l_linenumber")
    said = (v + F.when(n % 3 == 0, 1).otherwise(0)).cast("long").cast("string")
    whole, half = F.concat(F.lit("um "), said, F.lit(" Euro")), F.concat(F.lit("um "), said, F.when(n % 2 == 0, ",5").otherwise(".25"), F.lit(" Euro"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", quality.value_in_quote(whole, v).alias("whole"), quality.value_in_quote(half, v + 0.5).alias("half"))


MONTHS_SQL = "['januar', 'februar', 'märz', 'april', 'mai', 'juni', 'juli', 'august', 'september', 'oktober', 'november', 'dezember']"


@query(f"""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS p FROM orders), i AS (
    SELECT k, 'error' AS severity, 'fact.quote_missing' AS code, 'amounts[0]' AS path FROM o WHERE k % 4 = 0
    UNION ALL SELECT k, 'error', 'fact.quote_not_found', 'amounts[0].source_quote' FROM o WHERE k % 4 = 1
    UNION ALL SELECT k, 'error', 'fact.value_not_in_quote', 'amounts[0].new' FROM o WHERE k % 4 = 2 AND NOT contains('auf ' || c || ' euro', CAST(c + k % 3 AS VARCHAR))
    UNION ALL SELECT k, 'warning', 'fact.value_not_in_quote', 'amounts[0].old' FROM o WHERE k % 4 >= 2 AND NOT contains('auf ' || c || ' euro', CAST(c - k % 5 AS VARCHAR))
    UNION ALL SELECT k, 'error', 'fact.value_not_in_quote', 'amounts[0].new' FROM o WHERE k % 4 = 3 AND NOT contains('auf ' || c || ' euro', CAST(c + k % 3 AS VARCHAR))
    UNION ALL SELECT k, 'error', 'fact.rule_not_found', 'dates.effective[0].rule_text' FROM o WHERE k % 6 = 1
    UNION ALL SELECT k, 'error', 'fact.derived_incomplete', 'dates.effective[0]' FROM o WHERE k % 5 < 3 AND (k % 6 > 1 OR k % 7 = 0)
    UNION ALL SELECT k, 'error', 'fact.derived_mismatch', 'dates.effective[0].date' FROM o WHERE k % 5 < 3 AND k % 6 <= 1 AND k % 7 > 0 AND (k % 6 = 1 OR k % 2 = 1 OR k % 9 = 0)
    UNION ALL SELECT k, 'warning', 'fact.date_not_found', 'dates.effective[0].date' FROM o WHERE k % 5 >= 3 AND k % 6 > 1 AND (CAST(p AS DATE) + CASE WHEN k % 9 = 0 THEN 2 ELSE 1 END) <> CAST(p AS DATE) + CASE WHEN k % 8 < 4 THEN 1 ELSE 4 END)
    SELECT CAST(k AS VARCHAR) AS subject, severity, code, path FROM i""")
def fact_issues(spark, d):
    """Amounts with missing, strange, right and wrong quotes; dates with known, unknown and no
    rules, derived rightly, wrongly and without the day of promulgation."""
    k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.to_date("o_orderdate")
    rule = "tritt am Tag nach der Verkündung in Kraft"
    stated = F.date_add(p, F.when(k % 8 < 4, 1).otherwise(4))
    haystack = F.concat(F.lit("Der Betrag steigt\u00a0auf "), c.cast("string"), F.lit(f" Euro. Das Gesetz {rule}. Stichtag: "), card_checks.dates.spellings(stated)[(k % 4).cast("int")], F.lit("."))
    quote = F.when(k % 4 == 0, " ").when(k % 4 == 1, "auf viele Taler").otherwise(F.concat(F.lit("auf "), c.cast("string"), F.lit("  Euro")))
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", haystack.alias("text"))
    amounts = rows.select(k.alias("subject"), F.lit(0).alias("place"), quote.alias("source_quote"), (c + k % 3).cast("double").alias("new"), (c - k % 5).cast("double").alias("old"), "text")
    entries = rows.select(
        k.alias("subject"), F.lit("effective").alias("section"), F.lit(0).alias("place"), F.when(k % 6 == 0, rule).when(k % 6 == 1, "im nächsten Sommer").alias("rule_text"),
        (k % 5 < 3).alias("derived"), F.date_add(p, F.when(k % 9 == 0, 2).otherwise(1)).alias("date"), F.when(k % 7 > 0, p).alias("promulgated"), "text",
    )
    return quality.merged(card_checks.amount_issues(amounts), card_checks.date_issues(entries))


CARD_KEYS = ["summary", "changes", "who"]


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS pr FROM orders), i AS (
    SELECT k, 'error' AS severity, 'translation.placeholder_missing' AS code, NULL AS path FROM o WHERE k % 3 = 0
    UNION ALL SELECT k, 'error', 'translation.placeholder_added', NULL FROM o WHERE k % 4 = 0
    UNION ALL SELECT k, 'error', 'translation.bare_value', 'sections.changes' FROM o WHERE k % 5 = 0
    UNION ALL SELECT k, 'error', 'translation.section_missing', 'sections.who' FROM o WHERE k % 6 = 1
    UNION ALL SELECT k, 'error', 'translation.unknown_section', 'sections.more' FROM o WHERE k % 7 = 0
    UNION ALL SELECT k, 'error', 'card.summary_too_long', 'sections.summary' FROM o WHERE k % 8 = 0
    UNION ALL SELECT k, 'error', 'translation.wrong_language', NULL FROM o WHERE k % 9 = 0 AND k % 8 > 0
    UNION ALL SELECT k, 'error', 'card.forbidden_wording', 'sections.who' FROM o WHERE k % 6 <> 1 AND pr = '1-URGENT' AND k % 2 = 1
    UNION ALL SELECT k, 'warning', 'translation.glossary_term_missing', NULL FROM o WHERE pr IN ('2-HIGH', '3-MEDIUM') AND k % 10 > 0)
    SELECT CAST(k AS VARCHAR) AS subject, severity, code, path FROM i""")
def translation_issues(spark, d):
    """Translations with each kind of fault, several in one where the conditions meet."""
    k, pr = F.col("o_orderkey"), F.col("o_orderpriority")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    when = lambda test, x, y="": F.when(test, x).otherwise(y)
    master = F.create_map(
        F.lit("summary"), text("Das Gesetz wird geändert: {{ amount:a.new }} und {{date:effective.0}} "), F.lit("changes"), F.lit("Die Frist und der Betrag"),
        F.lit("who"), text("Betrifft ", when(pr.isin("2-HIGH", "3-MEDIUM"), "den langen Weg zum Amt", "alle"), " hier"),
    )
    filler = F.when(k % 9 == 0, "das gesetz und die frist wird nicht für alle gelten").otherwise("the law and the term changes for you and that country")
    entries = [
        text(F.when(k % 3 > 0, "{{amount:a.new}} ").otherwise(""), "{{date:effective.0}} ", when(k % 4 == 0, "{{amount:b}} "), filler, when(k % 8 == 0, F.repeat(F.lit(" law"), 100))),
        text("changed", when(k % 5 == 0, " by 48.300 units in all")),
        F.when(k % 6 != 1, text("all people", when((pr == "1-URGENT") & (k % 2 == 1), " You SHOULD sue now"), when(k % 10 == 0, " go the long way to the office"))).otherwise(" "),
    ]
    known = F.map_from_arrays(F.array(*map(F.lit, CARD_KEYS)), F.array(*entries))
    other = F.when(k % 7 == 0, F.map_concat(known, F.create_map(F.lit("more"), F.lit("")))).otherwise(known)
    cards = table(spark, d, "orders").select(k.alias("subject"), F.lit("en").alias("lang"), master.alias("master"), other.alias("translation"))
    phrases = spark.createDataFrame([("you should sue", "en", "advice"), ("und", "de", "opinion")], "phrase string, lang string, category string")
    glossary = spark.createDataFrame([("langen Weg zum Amt", "long way to the office"), ("kurzen Weg zum Amt", "x")], "term string, rendering string")
    return card_checks.translation_issues(cards, CARD_KEYS, phrases, glossary)


SECTIONS = ["system", "user", "assistant"]


@query("""WITH h AS (SELECT DISTINCT conv_id FROM conversations), n AS (SELECT conv_id, s FROM h, (VALUES ('system'), ('user'), ('assistant')) v(s))
    SELECT CAST(n.conv_id AS VARCHAR) AS subject, 'error' AS severity, 'translation.section_missing' AS code, n.s AS path FROM n
    WHERE NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = n.conv_id AND c.role = n.s AND trim(c.text) <> '')""")
def section_completeness(spark, d):
    return quality.section_issues(table(spark, d, "conversations"), "conv_id", "role", "text", SECTIONS)


LENGTH_SQL = """SELECT DISTINCT CAST(conv_id AS VARCHAR) AS subject, 'error' AS severity, 'card.summary_too_long' AS code, 'user' AS path FROM conversations WHERE role = 'user' AND length(text) > 280
    UNION ALL SELECT CAST(conv_id AS VARCHAR), 'warning', 'card.too_long', NULL FROM conversations GROUP BY conv_id HAVING sum(length(text)) > 1500"""


@query(LENGTH_SQL)
def length_limits(spark, d):
    return quality.length_issues(table(spark, d, "conversations"), "conv_id", "role", "text", "user", total_limit=1500)


@query(f"""WITH i AS (SELECT * FROM ({LENGTH_SQL}) UNION ALL SELECT DISTINCT CAST(page_id AS VARCHAR), 'error', 'disallowed_html', lower(t) FROM
        (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<\\s*/?\\s*([a-zA-Z][a-zA-Z0-9]*)', 1))) AS t FROM pages) WHERE lower(t) NOT IN ('table', 'thead', 'tbody', 'tfoot', 'tr', 'th', 'td', 'sup', 'sub', 'br'))
    SELECT subject, bool_and(severity <> 'error') AS passed, count(*) AS issues, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM i GROUP BY 1""")
def quality_report_rollup(spark, d):
    tags = table(spark, d, "pages").select("page_id", F.explode(F.array_distinct(F.transform(html_outside(F.col("html")), F.lower))).alias("tag"))
    markup = quality.issues(tags, F.lit(True), F.col("page_id"), quality.ERROR, "disallowed_html", F.col("tag"))
    return quality.report(quality.merged(length_limits(spark, d), markup))


@query("SELECT doc_id, TRUE AS deterministic, 0::BIGINT AS issues FROM documents")
def determinism_check(spark, d):
    """Rendered twice from differently dealt rows, hashes agree."""
    render = lambda df: df.select("doc_id", F.sha2(F.regexp_replace("text", r"\s+", " "), 256).alias("h"), F.size(encoding_issues(F.col("text").cast("binary"))).cast("long").alias("issues"))
    docs = table(spark, d, "documents")
    once, again = render(docs), render(docs.repartition("doc_id")).select("doc_id", F.col("h").alias("h2"))
    return once.join(again, "doc_id").select("doc_id", (F.col("h") == F.col("h2")).alias("deterministic"), "issues")


PEOPLE_SQL = """people AS (SELECT c_custkey, [CASE WHEN c_custkey % 2 = 0 THEN 'work.a' ELSE 'work.b' END, 'home.' || (c_custkey % 3)] AS tags, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'l' || (c_custkey % 4) END AS land,
        ['t' || (c_custkey % 6)] AS interests, CASE WHEN c_custkey % 7 = 0 THEN ['work'] ELSE ['work', 'home', 'kids'] END AS answered FROM customer),
    changes AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN [] ELSE ['l' || (p_size % 4)] END AS lands, p_size % 10 = 0 AS general, CASE WHEN p_size % 2 = 0 THEN ['work.a'] ELSE [] END AS all_of,
        CASE WHEN p_size % 4 = 1 THEN ['home.1', 'home.2'] ELSE [] END AS any_of, CASE WHEN p_size % 9 = 0 THEN ['work.b'] ELSE [] END AS none_of, ['t' || (p_size % 8)] AS topics, p_size % 4 AS impact FROM part),
    g AS (SELECT *, list_distinct(list_transform(list_concat(all_of, any_of, none_of), lambda t: string_split(t, '.')[1])) AS asked FROM people JOIN changes ON len(lands) = 0 OR list_contains(lands, land)),
    m AS (SELECT *, list_has_any(none_of, tags) AS excluded, (len(all_of) + len(any_of) > 0 AND list_has_all(tags, all_of) AND (len(any_of) = 0 OR list_has_any(any_of, tags))) OR (general AND impact >= 2) AS fits,
        NOT list_has_all(answered, asked) OR (land IS NULL AND len(lands) > 0) AS capped, list_has_any(topics, interests)
        OR list_has_any(list_transform(any_of, lambda t: string_split(t, '.')[1]), list_transform(tags, lambda t: string_split(t, '.')[1])) OR (general AND impact = 1) AS partly FROM g),
    levels AS (SELECT c_custkey, p_partkey, CASE WHEN fits AND NOT excluded AND NOT capped THEN 'direct' WHEN NOT excluded AND (fits OR partly) THEN 'possible' ELSE 'other' END AS level,
        array_to_string(list_sort(list_intersect(tags, list_concat(all_of, any_of))), ',') AS because FROM m)"""


def people_and_changes(spark, d):
    k = F.col("c_custkey")
    text = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    people = table(spark, d, "customer").select(
        "c_custkey", F.array(F.when(k % 2 == 0, "work.a").otherwise("work.b"), text("home.", k % 3)).alias("tags"), F.when(k % 5 != 0, text("l", k % 4)).alias("land"),
        F.array(text("t", k % 6)).alias("interests"), F.when(k % 7 == 0, F.array(F.lit("work"))).otherwise(F.array(F.lit("work"), F.lit("home"), F.lit("kids"))).alias("answered"),
    )
    s = F.col("p_size")
    some = lambda test, *tags: F.when(test, F.array(*map(F.lit, tags))).otherwise(F.array().cast("array<string>"))
    changes = table(spark, d, "part").select(
        "p_partkey", F.when(s % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(text("l", s % 4))).alias("lands"), (s % 10 == 0).alias("general"),
        some(s % 2 == 0, "work.a").alias("all_of"), some(s % 4 == 1, "home.1", "home.2").alias("any_of"), some(s % 9 == 0, "work.b").alias("none_of"),
        F.array(text("t", s % 8)).alias("topics"), (s % 4).alias("impact"),
    )
    return people, changes


def matches(spark, d):
    people, changes = people_and_changes(spark, d)
    return audience.class_matches(people, changes, "c_custkey", "p_partkey")


@query(f"WITH {PEOPLE_SQL} SELECT p_partkey, level, count(*) AS people FROM levels GROUP BY ALL")
def audience_match_level(spark, d):
    """People of each level for every change: counted by profile and rule, then by change."""
    _, changes = people_and_changes(spark, d)
    per_rule = matches(spark, d).groupBy("rule", "level").agg(F.sum("people").alias("people"))
    return audience.members(changes, audience.RULE, "p_partkey", "rule").join(per_rule, "rule").select("p_partkey", "level", "people")


@query(f"""WITH {PEOPLE_SQL}, pc AS (SELECT min(c_custkey) AS profile, tags, land, interests, answered, count(*) AS people FROM people GROUP BY ALL),
    cc AS (SELECT min(p_partkey) AS rule, lands, general, all_of, any_of, none_of, topics, impact, count(*) AS changes FROM changes GROUP BY ALL)
    SELECT profile, rule, people, changes, because FROM levels JOIN pc ON c_custkey = profile JOIN cc ON p_partkey = rule WHERE level <> 'other'""")
def audience_explanation(spark, d):
    """Pairs of a profile and a rule that match, each named by its smallest member."""
    return matches(spark, d).filter("level <> 'other'").select("profile", "rule", "people", "changes", "because")


@query("""WITH o AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders GROUP BY 1)
    SELECT o_custkey, CASE WHEN a > DATE '1998-06-01' THEN 'upcoming' WHEN b > DATE '1998-06-01' THEN 'partially_in_force' ELSE 'in_force' END AS state FROM o""")
def effective_state(spark, d):
    ends = table(spark, d, "orders").groupBy("o_custkey").agg(F.array(F.min(F.to_date("o_orderdate")), F.max(F.to_date("o_orderdate"))).alias("dates"))
    return ends.select("o_custkey", audience.effective_state(F.col("dates"), F.lit("1998-06-01").cast("date")).alias("state"))


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS e, CAST(CAST(o_orderdate AS DATE) - CAST(o_orderkey % 20 AS INTEGER) AS DATE) AS k FROM orders),
    r AS (SELECT o_orderkey, d.d AS days_before, CAST(e - d.d AS DATE) AS remind_on, k FROM o, (VALUES (14), (1), (0)) d(d)), f AS (SELECT * FROM r WHERE remind_on >= k)
    SELECT o_orderkey, days_before, remind_on FROM f WHERE days_before <> 0 OR NOT EXISTS (SELECT 1 FROM f g WHERE g.o_orderkey = f.o_orderkey AND g.days_before = 1)""")
def reminder_schedule(spark, d):
    day = F.to_date("o_orderdate")
    rows = table(spark, d, "orders").select("o_orderkey", day.alias("effective"), F.date_sub(day, (F.col("o_orderkey") % 20).cast("int")).alias("known"))
    return audience.reminders(rows, "o_orderkey", "effective", "known")


@query("SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 3 THEN 'instant' ELSE 'digest' END AS channel FROM events")
def instant_rate_limit(spark, d):
    return audience.rate_limited(table(spark, d, "events"), "user_id", "ts", "event_id").select("event_id", "channel")


@query("""SELECT event_id, CASE WHEN hour(ts) >= 22 THEN date_trunc('day', ts) + INTERVAL 32 HOUR WHEN hour(ts) < 8 THEN date_trunc('day', ts) + INTERVAL 8 HOUR ELSE ts END AS send_at FROM events""")
def quiet_hours_defer(spark, d):
    return table(spark, d, "events").select("event_id", audience.after_quiet_hours(F.col("ts")).alias("send_at"))


_ACTION_SQL = "CASE event_type WHEN 'view' THEN 'schedule' WHEN 'click' THEN 'reschedule' WHEN 'purchase' THEN 'sent' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'cancel' ELSE 'other' END"


@query(f"""WITH e AS (SELECT left(user_id || '|change_direct|email|' || event_id % 5 || '|', 128) AS k, {_ACTION_SQL} AS a, ts, event_id, ts + INTERVAL 1 DAY AS planned, props AS error FROM events WHERE ts IS NOT NULL), f AS (SELECT * FROM e WHERE a <> 'other')
    SELECT k AS notification, CASE arg_max(a, (ts, event_id)) WHEN 'schedule' THEN 'scheduled' WHEN 'reschedule' THEN 'deferred' WHEN 'cancel' THEN 'cancelled' ELSE arg_max(a, (ts, event_id)) END AS status,
        arg_max(planned, (ts, event_id)) FILTER (a IN ('schedule', 'reschedule')) AS scheduled_at, arg_max(ts, (ts, event_id)) FILTER (a = 'sent') AS sent_at,
        CASE WHEN arg_max(a, (ts, event_id)) FILTER (a IN ('sent', 'failed')) = 'failed' THEN left(arg_max(error, (ts, event_id)) FILTER (a = 'failed'), 512) END AS error FROM f GROUP BY 1""")
def notification_lifecycle(spark, d):
    """Status of each notification after all that happened to it."""
    e = table(spark, d, "events")
    key = notifications.idempotency_key(F.col("user_id"), F.lit("change_direct"), F.lit("email"), F.col("event_id") % 5, F.lit(""))
    rows = e.select(key.alias("notification"), F.expr(_ACTION_SQL).alias("action"), "ts", "event_id", (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("planned"), F.col("props").alias("error"))
    return notifications.lifecycle(rows, "notification", "action", "ts", "event_id", "planned", "error")


@query("""WITH r AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 3 AS first FROM events),
    s AS (SELECT *, CASE WHEN first THEN CASE WHEN hour(ts) >= 22 THEN date_trunc('day', ts) + INTERVAL 32 HOUR WHEN hour(ts) < 8 THEN date_trunc('day', ts) + INTERVAL 8 HOUR ELSE ts END END AS send_at FROM r)
    SELECT event_id, CASE WHEN first THEN 'instant' ELSE 'digest' END AS channel, send_at, CASE WHEN send_at = ts THEN 'scheduled' ELSE 'deferred' END AS status FROM s""")
def notification_plan(spark, d):
    """At most three messages a day and recipient, none in quiet hours, the rest in the digest."""
    return notifications.sending_plan(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id").select("event_id", "channel", "send_at", "status")


@query("""WITH p(phrase, category) AS (VALUES ('que la', 'advice'), ('and the', 'opinion'), ('der', NULL)), c AS (SELECT conv_id, role, arg_max(text, turn) AS text FROM conversations GROUP BY ALL)
    SELECT CAST(conv_id AS VARCHAR) AS subject, 'sections.' || role AS path, phrase, category, chr(34) || phrase || chr(34) || CASE category WHEN 'advice' THEN ' reads as legal advice; describe what the law provides instead.'
        WHEN 'opinion' THEN ' is an evaluation; the text has to stay neutral.' ELSE ' is not allowed in a card.' END AS message FROM c, p WHERE contains(lower(text), phrase)""")
def wording_categories(spark, d):
    """Forbidden phrases in the last text of each role, by category."""
    last = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.max_by("text", "turn").alias("text")).filter("text is not null")
    cards = last.groupBy(F.col("conv_id").alias("subject")).agg(F.map_from_entries(F.collect_list(F.struct("role", "text"))).alias("sections")).withColumn("lang", F.lit("en"))
    phrases = spark.createDataFrame([("Que la", "en", "advice"), ("and the", "en", "opinion"), ("der", "en", None), ("and", "de", "advice")], "phrase string, lang string, category string")
    return card_checks.wording_hits(cards, "sections", phrases)
