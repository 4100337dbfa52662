"""Text, date and money functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, language, money, text
from .registry import query, table

SLUG_SQL = "trim(regexp_replace(lower(replace(replace(replace(replace(replace(replace(replace({0}, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'Ä', 'ae'), 'Ö', 'oe'), 'Ü', 'ue'), 'ß', 'ss')), '[^a-z0-9]+', '-', 'g'), '-')"
TRIM_SQL = "trim({0}, ' ' || chr(9) || chr(10) || chr(13) || chr(11))"
COLLAPSE_SQL = TRIM_SQL.format(r"regexp_replace(translate({0}, chr(160) || chr(8239) || chr(8201), '   '), '[ \t\n\r\f\x0b]+', ' ', 'g')")


@query(f"SELECT doc_id, {SLUG_SQL.format('text')} AS slug FROM documents")
def slugify(spark, d):
    return table(spark, d, "documents").select("doc_id", text.slugify(F.col("text")).alias("slug"))


DESIGNATIONS_SQL = """CASE p_size % 7 WHEN 0 THEN '§ ' || p_size || 'a' WHEN 1 THEN '§§ ' || p_size || ' bis ' || (p_size + 2) WHEN 2 THEN 'Art. ' || p_size
    WHEN 3 THEN 'Anlage ' || p_size WHEN 4 THEN p_name WHEN 5 THEN 'Anhang' ELSE '' END"""


@query(f"""WITH p AS (SELECT p_partkey, p_size, {DESIGNATIONS_SQL} AS designation, p_name FROM part)
    SELECT p_partkey, designation, CASE p_size % 7 WHEN 0 THEN 'p' || p_size || 'a' WHEN 1 THEN 'p' || p_size || '-' || (p_size + 2) WHEN 2 THEN 'art' || p_size WHEN 3 THEN 'anl' || p_size
        WHEN 4 THEN {SLUG_SQL.format('p_name')} WHEN 5 THEN 'anl' ELSE 'n-bjnr' || p_partkey END AS norm_key FROM p""")
def norm_key(spark, d):
    designation = F.expr("""CASE p_size % 7 WHEN 0 THEN concat('§ ', p_size, 'a') WHEN 1 THEN concat('§§ ', p_size, ' bis ', p_size + 2) WHEN 2 THEN concat('Art. ', p_size)
        WHEN 3 THEN concat('Anlage ', p_size) WHEN 4 THEN p_name WHEN 5 THEN 'Anhang' ELSE '' END""")
    rows = table(spark, d, "part").select("p_partkey", designation.alias("designation"))
    document = F.concat(F.lit("BJNR"), F.col("p_partkey").cast("string"))
    return rows.select("p_partkey", "designation", text.norm_key(F.col("designation"), document).alias("norm_key"))


@query(f"SELECT doc_id, {COLLAPSE_SQL.format('text')} AS flat FROM documents")
def whitespace_collapse(spark, d):
    return table(spark, d, "documents").select("doc_id", text.collapse(F.col("text")).alias("flat"))


INLINE_SQL = r"regexp_replace({0}, '([\\`*_\[\]<])', '\\\1', 'g')"


@query(rf"""SELECT doc_id, regexp_replace(CASE WHEN left(ltrim({INLINE_SQL.format('text')}, ' ' || chr(9) || chr(10) || chr(13) || chr(11)), 1) IN ('#', '>', '|', '+', '-', '=', '~')
        THEN regexp_replace({INLINE_SQL.format('text')}, '^([ \t\n\r\x0b]*)(.)', '\1\\\2') ELSE {INLINE_SQL.format('text')} END, '^([ \t\n\r\x0b]*\d{{1,9}})([.)])(\s|$)', '\1\\\2\3') AS escaped,
    {INLINE_SQL.format('text')} AS inline, text AS plain, replace(text, '|', '\|') AS cell FROM documents""")
def markdown_escape(spark, d):
    """A line, its inline part, that part without its escapes again, and a table cell."""
    t = F.col("text")
    plain = text.unescape_markdown(text.escape_inline(t))
    return table(spark, d, "documents").select("doc_id", text.escape_line(t).alias("escaped"), text.escape_inline(t).alias("inline"), plain.alias("plain"), text.escape_table_cell(t).alias("cell"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;') AS escaped FROM pages""")
def html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", text.escape_html(F.col("html")).alias("escaped"))


@query("SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS plain FROM pages")
def strip_tags(spark, d):
    return table(spark, d, "pages").select("page_id", text.strip_tags(F.col("html")).alias("plain"))


@query("""SELECT page_id, CASE WHEN url LIKE 'https://%' THEN url ELSE 'https://base.example/' || ltrim(regexp_replace(url, '^[a-z]+://[^/]*', ''), '/') END AS absolute,
    nullif(regexp_extract(url, '/([a-z0-9]+)(?:[?#].*)?$', 1), '') AS slug, trim(lower(regexp_replace(url, '[^A-Za-z0-9]+', '-', 'g')), '-') AS label FROM pages""")
def absolute_url(spark, d):
    url = F.col("url")
    source = F.when(url.startswith("https://"), url).otherwise(F.regexp_replace(url, "^[a-z]+://[^/]*", ""))
    return table(spark, d, "pages").select(
        "page_id", text.absolute_url(source, F.lit("https://base.example/")).alias("absolute"), text.group(url, "/([a-z0-9]+)(?:[?#].*)?$").alias("slug"), text.footnote_label(url).alias("label")
    )


NOTE_SQL = """(CASE WHEN o_orderkey % 5 = 0 THEN 'no note' ELSE (CASE WHEN o_orderkey % 3 = 0 THEN 'Art. ' || (o_orderkey % 17 + 1) || ' Abs. 2 ' ELSE '' END)
    || (CASE WHEN o_orderkey % 2 = 0 THEN 'G' ELSE 'Bek.' END) || ' v. ' || day(o_orderdate) || '.' || month(o_orderdate) || '.' || year(o_orderdate) || ' I '
    || (CASE WHEN o_orderkey % 4 = 0 THEN 'Nr. ' || (o_orderkey % 400 + 1) ELSE CAST(o_orderkey % 3000 + 1 AS VARCHAR) END) END)"""
CITED_SQL = f"""WITH c AS (SELECT o_orderkey, year(o_orderdate) AS y, o_orderkey % 400 + 1 AS n, o_orderkey % 3000 + 1 AS p, o_orderkey % 4 = 0 AS by_number, o_orderkey % 5 <> 0 AS good,
    o_orderkey % 3 = 0 AS art, o_orderkey % 17 + 1 AS a, o_orderkey % 2 = 0 AS law, {NOTE_SQL} AS note FROM orders)"""


def _notes(spark, d):
    day = F.col("o_orderdate")
    k = F.col("o_orderkey")
    article = F.when(k % 3 == 0, F.format_string("Art. %d Abs. 2 ", k % 17 + 1)).otherwise("")
    kind = F.when(k % 2 == 0, "G").otherwise("Bek.")
    place = F.when(k % 4 == 0, F.format_string("Nr. %d", k % 400 + 1)).otherwise((k % 3000 + 1).cast("string"))
    note = F.when(k % 5 == 0, "no note").otherwise(F.concat(article, kind, F.format_string(" v. %d.%d.%d I ", F.day(day), F.month(day), F.year(day)), place))
    return table(spark, d, "orders").select("o_orderkey", note.alias("note")).withColumn("cited", text.citation(F.col("note")))


@query(f"""{CITED_SQL} SELECT o_orderkey, note, CASE WHEN good AND art THEN 'Art. ' || a || ' Abs. 2' END AS article, CASE WHEN good THEN CASE WHEN law THEN 'G' ELSE 'Bek.' END END AS kind,
    CASE WHEN good THEN y || '-bund-bgbl-i-' || CASE WHEN by_number THEN CAST(n AS VARCHAR) ELSE 's' || p END END AS change_id,
    CASE WHEN good THEN CASE WHEN by_number THEN 'BGBl. ' || y || ' I Nr. ' || n ELSE 'BGBl. I ' || y || ', ' || p END END AS citation,
    CASE WHEN good AND by_number THEN 'https://www.recht.bund.de/eli/bund/BGBl-1/' || y || '/' || n || '/' END AS url, good AND NOT law AS republication FROM c""")
def citation_parse(spark, d):
    c = F.col("cited")
    republication = F.coalesce(c["kind"] == "Bek.", F.lit(False))
    return _notes(spark, d).select(
        "o_orderkey", "note", text.article_label(c).alias("article"), c["kind"].alias("kind"), text.change_id(c).alias("change_id"),
        text.citation_label(c).alias("citation"), text.eli_url(c).alias("url"), republication.alias("republication"),
    )


@query("""SELECT conv_id, turn, '{{amount:a.' || (turn % 3) || '}}|{{date:' || role || '}}|{{amount:a.' || (turn % 3) || '}}' AS found,
    CASE WHEN turn % 2 = 0 THEN '' ELSE '{{date:' || role || '}}' END AS missing, 'x 5 {{date:' || role || '}} 5' AS replaced FROM conversations""")
def placeholder_extract(spark, d):
    t, role = F.col("turn"), F.col("role")
    amount, day = F.format_string("{{ amount : a.%d }}", t % 3), F.concat(F.lit("{{date:"), role, F.lit("}}"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("x "), amount, F.lit(" "), day, F.lit(" "), amount).alias("master"), F.when(t % 2 == 0, day).otherwise("none").alias("other"), F.format_string("{{amount:a.%d}}", t % 3).alias("key"))
    found = text.placeholders(F.col("master"))
    canonical = F.regexp_replace("master", text.PLACEHOLDER, "{{$1:$2}}")
    missing = F.filter(F.array_except(found, text.placeholders(F.col("other"))), lambda p: p.startswith("{{date"))
    return rows.select(
        "conv_id", "turn", F.array_join(found, "|").alias("found"), F.array_join(missing, "|").alias("missing"),
        text.replace_placeholders(canonical, F.array("key"), F.array(F.lit("5"))).alias("replaced"),
    )


@query()
def bare_values(spark, d):
    """Lookahead has no counterpart in the checking engine; unit tests cover it."""
    return table(spark, d, "documents").select("doc_id", F.array_join(text.bare_values(F.col("text")), "|").alias("found"))


@query()
def number_normalise(spark, d):
    return table(spark, d, "documents").select("doc_id", text.grouped_numbers_joined(F.col("text")).alias("normal"))


def _hits(words: list[str]) -> str:
    return "len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{x}'" for x in words) + ")))"


EXTRA_STOPWORDS = language.STOPWORDS | {"fr": ["de", "la", "et", "les", "des", "que"], "es": ["de", "la", "el", "los", "para", "que"]}


@query(f"""WITH t AS (SELECT doc_id, lower(regexp_replace(text, '<[^>]*>', '', 'g')) AS p FROM documents),
    s AS (SELECT doc_id, p, list_filter(regexp_split_to_array(p, '[^\\p{{L}}]+'), lambda x: x <> '') AS w, len(regexp_extract_all(p, '\\p{{L}}')) AS letters FROM t),
    k AS (SELECT doc_id, letters, {", ".join(f"{_hits(EXTRA_STOPWORDS[c])} AS {c}" for c in ("en", "de", "fr", "es"))} FROM s), b AS (SELECT *, greatest(en, de, fr, es) AS m FROM k)
    SELECT doc_id, CASE WHEN letters < 40 OR m = 0 OR (en = m)::INT + (de = m)::INT + (fr = m)::INT + (es = m)::INT > 1 THEN NULL
        WHEN en = m THEN 'en' WHEN de = m THEN 'de' WHEN fr = m THEN 'fr' ELSE 'es' END AS language FROM b""")
def language_detect(spark, d):
    found = language.detect_language(F.col("text"), latin=("en", "de", "fr", "es"), stopwords=EXTRA_STOPWORDS)
    return table(spark, d, "documents").select("doc_id", found.alias("language"))


@query(r"""WITH f AS (SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN text || chr(7) WHEN 2 THEN chr(65279) || text ELSE text END AS t FROM documents)
    SELECT doc_id, 'control_characters' AS code FROM f WHERE regexp_matches(t, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]')
    UNION ALL SELECT doc_id, 'byte_order_mark' FROM f WHERE contains(t, chr(65279))""")
def encoding_checks(spark, d):
    t, k = F.col("text"), F.col("doc_id") % 4
    content = F.when(k == 1, F.concat(t, F.lit("\x07"))).when(k == 2, F.concat(F.lit("﻿"), t)).otherwise(t).cast("binary")
    return table(spark, d, "documents").select("doc_id", F.explode(text.encoding_issues(content)).alias("code"))


@query(r"""WITH t AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<\s*/?\s*([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM pages)
    SELECT page_id, tag FROM t WHERE lower(tag) NOT IN ('table', 'thead', 'tbody', 'tfoot', 'tr', 'th', 'td', 'sup', 'sub', 'br')""")
def html_allow_list(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(text.html_outside(F.col("html"))).alias("tag"))


@query(f"SELECT doc_id, CASE WHEN length({COLLAPSE_SQL.format('text')}) > 120 THEN substr({COLLAPSE_SQL.format('text')}, 1, 117) || '…' ELSE {COLLAPSE_SQL.format('text')} END AS short FROM documents")
def shorten_120(spark, d):
    return table(spark, d, "documents").select("doc_id", text.shorten(F.col("text")).alias("short"))


@query("""SELECT doc_id, substr(source, 1, 16) AS kind, substr(CAST(doc_id AS VARCHAR) || ':' || lang, 1, 96) AS ident, source AS provider, CAST(doc_id AS VARCHAR) || ':' || lang AS model,
    'change/' || source || '-' || doc_id AS branch, 'impact:' || (doc_id % 4) || ',lang:' || lang AS labels FROM documents""")
def subject_split(spark, d):
    subject = F.concat("source", F.lit(":"), F.col("doc_id").cast("string"), F.lit(":"), "lang")
    parts, model = text.subject_parts(subject), text.model_reference(subject)
    labels = F.array_join(F.array(F.format_string("impact:%d", F.col("doc_id") % 4), F.concat(F.lit("lang:"), "lang")), ",")
    return table(spark, d, "documents").select(
        "doc_id", parts["type"].alias("kind"), parts["id"].alias("ident"), model["provider"].alias("provider"), model["model"].alias("model"),
        F.format_string("change/%s-%d", "source", "doc_id").alias("branch"), labels.alias("labels"),
    )


@query("""SELECT o_orderkey, 'Update' || chr(10) || chr(10) || 'Source: ' || o_custkey || chr(10) || 'Change-Id: ' || o_orderkey || chr(10) || 'Note: ' || o_orderpriority || chr(10) AS message, CAST(o_custkey AS VARCHAR) AS source FROM orders""")
def trailer_block(spark, d):
    line, note = F.format_string("Change-Id: %d", "o_orderkey"), F.concat(F.lit("Note: "), F.coalesce("o_orderpriority", F.lit("")))
    message = text.with_trailers(F.lit("Update\n"), F.array(note, line, F.format_string("Source: %d", "o_custkey"), line))
    rows = table(spark, d, "orders").select("o_orderkey", message.alias("message"))
    return rows.select("o_orderkey", "message", text.trailers_of(F.col("message"))["Source"].alias("source"))


RULES = [
    "Am Tag nach der Verkündung", "am Tage der Verkündung", "am ersten Tag des dritten auf die Verkündung folgenden Kalendermonats",
    "zwei Monate nach der Verkündung", "Am 1. Januar 2027 oder später", "nach Ermessen",
]


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS k, CAST(o_orderdate AS DATE) AS p FROM orders)
    SELECT o_orderkey, CASE k WHEN 0 THEN CAST(p + INTERVAL 1 DAY AS DATE) WHEN 1 THEN p WHEN 2 THEN CAST(date_trunc('month', p) + INTERVAL 3 MONTH AS DATE)
        WHEN 3 THEN CAST(CAST(date_trunc('month', p) + INTERVAL 2 MONTH AS DATE) + CAST(day(p) - 1 AS INTEGER) AS DATE) WHEN 4 THEN DATE '2027-01-01' END AS effective,
        coalesce(k = 1, FALSE) AS agrees FROM o""")
def effective_date_rules(spark, d):
    rule = F.array(*[F.lit(r) for r in RULES])[(F.col("o_orderkey") % 6).cast("int")]
    rows = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("p"), rule.alias("rule"))
    rows = rows.withColumn("effective", dates.effective_date(F.col("rule"), F.col("p")))
    return rows.select("o_orderkey", "effective", F.coalesce(F.col("effective") == F.col("p"), F.lit(False)).alias("agrees"))


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS p FROM orders)
    SELECT o_orderkey, p AS named, p AS numbered, CAST(NULL AS DATE) AS impossible, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE p END AS strict,
        strftime(p, '%G-W%V') AS week, strftime(p, '%d.%m.%Y') || '|' || strftime(p, '%Y/%m/%d') AS formats FROM o""")
def explicit_date_parse(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("p"))
    spelt = dates.spellings(F.col("p"))
    strict = F.when(F.col("o_orderkey") % 3 == 0, spelt[1]).otherwise(spelt[3])
    return rows.select(
        "o_orderkey", dates.explicit_date(F.concat(F.lit("gilt ab "), spelt[0])).alias("named"), dates.explicit_date(spelt[1]).alias("numbered"),
        dates.explicit_date(F.lit("am 30.02.2026")).alias("impossible"), dates.iso_date(strict).alias("strict"), dates.iso_week(F.col("p")).alias("week"),
        F.concat_ws("|", F.date_format("p", "dd.MM.yyyy"), F.date_format("p", "yyyy/MM/dd")).alias("formats"),
    )


@query("""WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS p, CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS q FROM orders), t AS (SELECT *, 'ab ' || CASE k % 4
        WHEN 0 THEN day(q) || '. ' || ['januar', 'februar', 'märz', 'april', 'mai', 'juni', 'juli', 'august', 'september', 'oktober', 'november', 'dezember'][month(q)] || ' ' || year(q)
        WHEN 1 THEN strftime(q, '%d.%m.%Y') WHEN 2 THEN day(q) || '.' || month(q) || '.' || year(q) ELSE strftime(q, '%Y-%m-%d') END AS s FROM o)
    SELECT k AS o_orderkey, contains(s, strftime(p, '%d.%m.%Y')) OR contains(s, strftime(p, '%Y-%m-%d')) OR contains(s, day(p) || '.' || month(p) || '.' || year(p))
        OR contains(s, day(p) || '. ' || ['januar', 'februar', 'märz', 'april', 'mai', 'juni', 'juli', 'august', 'september', 'oktober', 'november', 'dezember'][month(p)] || ' ' || year(p)) AS contained FROM t""")
def date_spellings(spark, d):
    """One text in three names the day after."""
    p, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    text_ = dates.spellings(F.date_add(p, F.when(k % 3 == 0, 1).otherwise(0)))[(k % 4).cast("int")]
    return table(spark, d, "orders").select("o_orderkey", F.exists(dates.spellings(p), lambda s: F.contains(F.concat(F.lit("ab "), text_), s)).alias("contained"))


@query("SELECT strftime(ts, '%G-W%V') AS week, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def iso_week_digest(spark, d):
    week = dates.iso_week(F.to_date("ts")).alias("week")
    return table(spark, d, "events").groupBy(week).agg(F.count(F.lit(1)).alias("events"), F.countDistinct("user_id").alias("users"))



@query("""SELECT l_orderkey, l_linenumber, p_size % 10 = 0 OR p_partkey IS NULL AS is_free,
    CAST(round(CASE WHEN p_size % 10 = 0 THEN 0 ELSE (greatest(CAST(l_quantity AS BIGINT) * 1000 - l_linenumber * 2000, 0)::DECIMAL(18,0) * p_size + l_linenumber::DECIMAL(18,0) * 1000
        + CAST(l_quantity AS BIGINT)::DECIMAL(18,0) * 20 * p_size) * 9 END) AS BIGINT) AS cost_e7 FROM lineitem LEFT JOIN part ON p_partkey = l_partkey""")
def usage_cost_decimal(spark, d):
    """Quantities stand for tokens, part sizes for prices; costs are whole 1e-7 steps."""
    size = F.when(F.col("p_size") % 10 != 0, F.col("p_size")).cast("decimal(10,4)")
    q = F.col("l_quantity").cast("long")
    cached = F.col("l_linenumber").cast("long") * 2000
    half = F.when(size.isNotNull(), F.lit("0.5").cast("decimal(10,4)"))
    price_cached = F.when(size.isNotNull(), half).otherwise(F.lit(0).cast("decimal(10,4)"))
    cost = money.usage_cost(q * 1000, q * 10, cached, size, size * 2, price_cached, F.lit("0.9").cast("decimal(10,4)"))
    joined = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"), "left")
    return joined.select("l_orderkey", "l_linenumber", money.is_free(size, size).alias("is_free"), (cost * 10000000).cast("long").alias("cost_e7"))


@query("SELECT o_orderkey, greatest(1, ceil(length(o_orderpriority) / 3.0))::BIGINT AS depth, greatest(1, least(CAST(o_custkey AS INTEGER), 50)) AS clamped, round(o_totalprice / 1000, 0) AS rounded FROM orders")
def heading_depth(spark, d):
    depth = F.greatest(F.lit(1), F.ceil(F.length("o_orderpriority") / 3))
    return table(spark, d, "orders").select(
        "o_orderkey", depth.alias("depth"), money.clamp(F.col("o_custkey").cast("int"), 1, 50).alias("clamped"), money.half_up(F.col("o_totalprice") / 1000).alias("rounded")
    )


@query("SELECT o_orderkey, TRUE AS same, TRUE AS refused FROM orders")
def aes_round_trip(spark, d):
    """Authenticated encryption: the text comes back, and another key gives null."""
    key, other = F.lit("0123456789abcdef"), F.lit("fedcba9876543210")
    sealed = F.aes_encrypt(F.col("o_orderpriority"), key, F.lit("GCM"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", sealed.alias("sealed"))
    return rows.select("o_orderkey", (F.aes_decrypt("sealed", key, F.lit("GCM")).cast("string") == F.col("o_orderpriority")).alias("same"), F.try_aes_decrypt("sealed", other, F.lit("GCM")).isNull().alias("refused"))


@query("SELECT event_id, event_id % 2 = 0 AS valid FROM events")
def hmac_verify(spark, d):
    from ..functions.signing import hmac_sha256_hex

    rows = table(spark, d, "events").select("event_id", "props")
    sent = F.when(F.col("event_id") % 2 == 0, hmac_sha256_hex(F.col("props"), "secret")).otherwise("sha256=00")
    return rows.select("event_id", (sent == hmac_sha256_hex(F.col("props"), "secret")).alias("valid"))
