"""Documents, sentences, cards, prompts and JSON answers over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json_rules
from ..functions.text import collapse, placeholders
from ..operators import cards, documents, sentences
from .registry import query, table


@query()
def html_to_markdown(spark, d):
    return documents.to_markdown(table(spark, d, "pages"), ["page_id"], "html")


@query()
def structure_nodes(spark, d):
    return documents.structure_nodes(table(spark, d, "pages"), ["page_id"], "html")


@query()
def sentence_split(spark, d):
    return sentences.split_sentences(table(spark, d, "documents"), ["doc_id"], "text")


_PLAIN = "replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&')"
_CELL = r"regexp_replace(trim(regexp_replace(" + _PLAIN.format("{0}") + r", '\s+', ' ', 'g')), '([\\`*_\[\]<])', '\\\1', 'g')"


@query(rf"""WITH l AS (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS h, regexp_extract_all(html, '<li><a href="[^"]*">(.*?)</a>', 1, 's') AS t FROM pages)
    SELECT page_id, page_id % 2 = 1 AND len(h) > 0 AS ragged, CASE WHEN page_id % 2 = 0 OR len(h) = 0 THEN '| Ziel | Text |' || chr(10) || '| --- | --- |' || array_to_string(list_transform(range(1, len(h) + 1), lambda i:
            chr(10) || '| ' || {_CELL.format('h[i]')} || ' | ' || replace({_CELL.format('t[i]')}, '|', '\|') || ' |'), '')
        ELSE '<table>' || chr(10) || '<tr><td>Ziel</td><td>Text</td></tr>' || array_to_string(list_transform(range(1, len(h) + 1), lambda i: chr(10) || '<tr><td>' || replace(replace(replace(replace(replace(trim(regexp_replace({_PLAIN.format('t[i]')}, '\s+', ' ', 'g')),
            '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#039;') || '</td></tr>'), '') || chr(10) || '</table>' END AS written FROM l""")
def table_to_gfm(spark, d):
    """Tables of each page's links: regular ones in pipe lines, those whose rows lack a cell in HTML."""
    anchor = r"(?s)<li><a href=\"([^\"]*)\">(.*?)</a>"
    rows = table(spark, d, "pages").select("page_id", F.regexp_extract_all("html", F.lit(anchor), F.lit(1)).alias("h"), F.regexp_extract_all("html", F.lit(anchor), F.lit(2)).alias("t"))
    first = lambda x: F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<td>"), x["h"], F.lit("</td>"))).otherwise("")
    body = F.transform(F.arrays_zip("h", "t"), lambda x: F.concat(F.lit("<tr>"), first(x), F.lit("<td>"), x["t"], F.lit("</td></tr>")))
    markup = F.concat(F.lit("<table><tr><th>Ziel</th><th>Text</th></tr>"), F.array_join(body, ""), F.lit("</table>"))
    rows = rows.select("page_id", markup.alias("markup"))
    return rows.select("page_id", documents.is_ragged(documents.table_rows(F.col("markup"))).alias("ragged"), documents.render_table(F.col("markup")).alias("written"))


ORDER = ["system", "user", "assistant"]
HEADINGS = {"system": "System", "user": "Question", "assistant": "Answer"}
CARD_SQL = """s AS (SELECT conv_id, role, trim(arg_max(text, turn), ' ' || chr(10)) AS text FROM conversations GROUP BY ALL),
    w AS (SELECT conv_id, coalesce(max(text) FILTER (role = 'system'), '') AS a, coalesce(max(text) FILTER (role = 'user'), '') AS b, coalesce(max(text) FILTER (role = 'assistant'), '') AS c FROM s GROUP BY 1)"""


def _cards(spark, d):
    """The last text of each role of a conversation, as the sections of one card."""
    last = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.max_by("text", "turn").alias("text"))
    picks = [F.max(F.when(F.col("role") == r, F.btrim(F.col("text"), F.lit(" \n")))).alias(r) for r in ORDER]
    wide = last.groupBy("conv_id").agg(*picks)
    sections = F.map_filter(F.create_map(*[x for r in ORDER for x in (F.lit(r), F.col(r))]), lambda _, v: v.isNotNull() & (v != ""))
    return wide.select("conv_id", sections.alias("sections"))


@query(f"WITH {CARD_SQL} SELECT conv_id, a AS system, b AS question, c AS answer, sha256(a || chr(0) || b || chr(0) || c) AS master_hash FROM w")
def card_parse(spark, d):
    """Cards written to anchored Markdown and parsed again; staleness hash of the result."""
    written = _cards(spark, d).select("conv_id", cards.render_card(F.col("sections"), ORDER, HEADINGS).alias("body"))
    parsed = written.select("conv_id", cards.parse_card(F.col("body")).alias("m"))
    part = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(""))
    none = F.array().cast("array<string>")
    return parsed.select("conv_id", part("system").alias("system"), part("user").alias("question"), part("assistant").alias("answer"), cards.master_hash(F.col("m"), ORDER, none).alias("master_hash"))


@query("SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 3 = 0")
def stale_translations(spark, d):
    none = F.array().cast("array<string>")
    masters = _cards(spark, d).select("conv_id", cards.master_hash(F.col("sections"), ORDER, none).alias("master_hash"))
    made_from = F.when(F.col("conv_id") % 3 == 0, F.lit("old")).otherwise(F.col("master_hash"))
    return cards.stale(masters.select("conv_id", made_from.alias("master_hash")), masters, "conv_id", "master_hash").select("conv_id")


@query("""SELECT doc_id, 'changes/' || (2020 + doc_id % 5) || '/c' || doc_id || '/' || f.name AS path, CASE f.name WHEN 'facts.yml' THEN 'id: c' || doc_id || chr(10) || 'lang: ' || lang || chr(10) ELSE '---' || chr(10) || 'lang: ' || lang || chr(10) || '---' || chr(10) || text END AS content,
    CASE f.name WHEN 'facts.yml' THEN NULL ELSE 'lang: ' || lang END AS header FROM documents, (VALUES ('facts.yml'), ('card.md')) f(name)""")
def render_files(spark, d):
    """Two files a document, (path, content) rows; the front matter is split off again."""
    k = F.col("doc_id").cast("string")
    folder = F.concat(F.lit("changes/"), (2020 + F.col("doc_id") % 5).cast("string"), F.lit("/c"), k, F.lit("/"))
    facts = F.concat(F.lit("id: c"), k, F.lit("\nlang: "), "lang", F.lit("\n"))
    card = F.concat(F.lit("---\nlang: "), "lang", F.lit("\n---\n"), "text")
    files = F.explode(F.create_map(F.lit("facts.yml"), facts, F.lit("card.md"), card)).alias("name", "content")
    rows = table(spark, d, "documents").select("doc_id", folder.alias("folder"), files)
    return rows.select("doc_id", F.concat("folder", "name").alias("path"), "content", cards.front_matter(F.col("content"))["header"].alias("header"))


@query("SELECT doc_id, 'Summarise in ' || lang || ': ' || text AS prompt, 'v3' AS version FROM documents")
def prompt_render(spark, d):
    prompt = F.replace(F.replace(F.lit("Summarise in {lang}: {text}"), F.lit("{lang}"), F.col("lang")), F.lit("{text}"), F.col("text"))
    return table(spark, d, "documents").select("doc_id", prompt.alias("prompt"), F.lit("v3").alias("version"))


@query("""SELECT conv_id, arg_max(text, turn) FILTER (role = 'system') AS status, count(*) FILTER (role = 'user') AS pending, string_agg(CASE WHEN role = 'assistant' THEN CAST(turn AS VARCHAR) END, ' ' ORDER BY turn) AS notes,
    min(turn) FILTER (role = 'assistant') AS first_official FROM conversations GROUP BY 1""")
def note_routing(spark, d):
    """Notes by kind: of one the last wins, another is counted, others are joined in order."""
    role, turn = F.col("role"), F.col("turn")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(role == "assistant", turn))), lambda t: t.cast("string")), " ")
    return table(spark, d, "conversations").groupBy("conv_id").agg(
        F.max_by("text", F.when(role == "system", turn)).alias("status"), F.count_if(role == "user").alias("pending"),
        F.nullif(joined, F.lit("")).alias("notes"), F.min(F.when(role == "assistant", turn)).alias("first_official"),
    )


@query("SELECT conv_id, turn, role = 'system' AS heading FROM conversations WHERE role <> 'assistant' OR turn % 2 = 1")
def document_filter_split(spark, d):
    rows = table(spark, d, "conversations").filter("role <> 'assistant' or turn % 2 = 1")
    return rows.select("conv_id", "turn", (F.col("role") == "system").alias("heading"))


SCHEMA = {
    "type": "object", "required": ["k", "name"], "additionalProperties": False,
    "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 90}, "name": {"type": "string"}},
}


@query("""WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
    SELECT event_id, array_to_string(list_filter(['$ is missing the required property "name".', CASE WHEN event_id % 3 = 0 THEN '$ has the unexpected property "extra".' END, CASE WHEN k < 10 THEN '$.k must be at least 10.' END,
        CASE WHEN k > 90 THEN '$.k must be at most 90.' END], lambda x: x IS NOT NULL), '|') AS errors FROM e""")
def json_schema_errors(spark, d):
    answer = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Sure: ```json\n"), F.regexp_replace("props", "}$", ', "extra": []}'), F.lit("\n``` done"))).otherwise(F.col("props"))
    value = json_rules.decoded(answer)
    return table(spark, d, "events").select("event_id", F.array_join(json_rules.schema_errors(value, SCHEMA), "|").alias("errors"))


REGISTRY = {
    ("view", 1): {"type": "object", "required": ["k"]}, ("view", 2): {"type": "object", "properties": {"k": {"type": "integer", "maximum": 50}}, "additionalProperties": False},
    ("purchase", 1): {"type": "object", "properties": {"k": {"type": "string"}}}, ("purchase", 2): {"anyOf": [{"properties": {"k": {"type": "integer", "minimum": 60}}}, {"properties": {"k": {"enum": [1, 2, 3]}}}]},
}


@query("""WITH e AS (SELECT event_id, event_type AS t, CASE WHEN event_id % 4 < 3 THEN event_id % 4 + 1 END AS asked, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), v AS (SELECT *, coalesce(asked, CASE WHEN t IN ('view', 'purchase') THEN 2 END) AS v FROM e)
    SELECT event_id, t AS schema_name, CAST(v AS INTEGER) AS version, CASE WHEN t NOT IN ('view', 'purchase') OR v = 3 THEN 'There is no schema ' || t || ' ' || coalesce(CAST(v AS VARCHAR), '?') || '.'
        WHEN t = 'view' AND v = 1 THEN '' WHEN t = 'view' THEN CASE WHEN k > 50 THEN '$.k must be at most 50.' ELSE '' END WHEN v = 1 THEN '$.k must be of type string, integer given.'
        WHEN k >= 60 OR k IN (1, 2, 3) THEN '' ELSE '$ does not match any of the allowed shapes (anyOf).' END AS errors FROM v""")
def schema_registry(spark, d):
    """Rows that name schemas of different kinds and versions, checked in one pass."""
    k = F.col("event_id") % 4
    version = F.when(k < 3, (k + 1).cast("int"))
    newest = F.when(F.col("event_type").isin("view", "purchase"), 2)
    errors = json_rules.registry_errors(F.try_parse_json("props"), F.col("event_type"), version, REGISTRY)
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("schema_name"), F.coalesce(version, newest).alias("version"), F.array_join(errors, "|").alias("errors"))


@query("SELECT event_id, event_id % 3 = 0 AS is_list, event_id % 3 = 1 AS is_object FROM events")
def empty_object_vs_list(spark, d):
    text = F.array(F.lit("[]"), F.lit("{}"), F.lit("1"))[(F.col("event_id") % 3).cast("int")]
    name = F.schema_of_variant(F.parse_json(text))
    return table(spark, d, "events").select("event_id", name.startswith("ARRAY").alias("is_list"), name.startswith("OBJECT").alias("is_object"))


@query("SELECT user_id, arg_max(event_id, event_id) AS answer FROM events WHERE event_type <> 'error' AND event_id % 5 <> 0 GROUP BY 1")
def jsonl_last_wins(spark, d):
    """Answer lines to a map by id: broken and failed lines are skipped, the last wins."""
    line = F.when(F.col("event_id") % 5 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("user_id").alias("custom_id"), F.col("event_id").alias("answer"), F.col("event_type").alias("status"))))
    read = F.from_json("line", "custom_id long, answer long, status string, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    rows = table(spark, d, "events").select(line.alias("line"), "event_id").select(read.alias("a"), "event_id").filter("a._corrupt is null and a.custom_id is not null and a.status <> 'error'")
    return rows.groupBy(F.col("a.custom_id").alias("user_id")).agg(F.max_by("a.answer", "event_id").alias("answer"))


_TITLE_SQL = r"trim(regexp_replace(regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))"


@query("""WITH l AS (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS h FROM pages)
    SELECT page_id, CAST(len(h) AS INTEGER) AS items, array_to_string(list_transform(range(1, 6), lambda i: coalesce(CASE WHEN i <= 3 THEN h[i] END, '-')), ' ') AS padded,
        CAST(coalesce(list_sum(list_transform(h, lambda x: length(x))), 0) AS BIGINT) AS total, len(list_filter(h, lambda x: length(x) > 5)) > 0 AS any_long, array_to_string(list_reverse(h), ' ') AS turned FROM l""")
def list_functional_ops(spark, d):
    """The links of a page: the first three padded to five, lengths summed, any long one, turned round."""
    rows = table(spark, d, "pages").select("page_id", F.regexp_extract_all("html", F.lit(r"<li><a href=\"([^\"]*)\">"), F.lit(1)).alias("h"))
    head = F.slice("h", 1, 3)
    padded = F.concat(head, F.array_repeat(F.lit("-"), F.lit(5) - F.size(head)))
    total = F.aggregate("h", F.lit(0).cast("long"), lambda acc, x: acc + F.length(x))
    return rows.select("page_id", F.size("h").alias("items"), F.array_join(padded, " ").alias("padded"), total.alias("total"), F.exists("h", lambda x: F.length(x) > 5).alias("any_long"), F.array_join(F.reverse("h"), " ").alias("turned"))


@query(rf"SELECT page_id, {_PLAIN.format(_TITLE_SQL)} AS text, url AS attribute FROM pages")
def xml_path_text(spark, d):
    """Text and attribute by path in XML that holds each page's own heading and address."""
    from .laws import xml_text

    body = F.coalesce(xml_text(F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1)), F.lit(""))
    xml = F.concat(F.lit("<a><b id='"), F.replace(xml_text(F.col("url")), F.lit("'"), F.lit("&#39;")), F.lit("'><c> "), body, F.lit(" </c></b></a>"))
    return table(spark, d, "pages").select("page_id", collapse(F.xpath_string(xml, F.lit("/a/b/c"))).alias("text"), F.xpath_string(xml, F.lit("/a/b/@id")).alias("attribute"))


@query("SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS characters, FALSE AS has_placeholders FROM conversations GROUP BY 1")
def master_rules_only(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("characters"), F.max(F.size(placeholders(F.col("text")))).alias("n"))
    return rows.select("conv_id", "characters", (F.col("n") > 0).alias("has_placeholders"))


@query(rf"SELECT page_id, regexp_extract('http://x.example/' || lower(regexp_replace(url, '[^A-Za-z0-9]+', '-', 'g')) || '/xml.zip', '/([a-z0-9_-]+)/xml\.zip$', 1) AS slug, {_PLAIN.format(_TITLE_SQL)} AS title FROM pages")
def toc_scan(spark, d):
    """Table of contents in XML, one item a page with its own heading; slug from the item's link."""
    from .laws import xml_text

    title = F.coalesce(xml_text(F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1)), F.lit(""))
    link = F.concat(F.lit("http://x.example/"), F.lower(F.regexp_replace("url", "[^A-Za-z0-9]+", "-")), F.lit("/xml.zip"))
    parsed = F.from_xml(F.concat(F.lit("<item><title>"), title, F.lit("</title><link>"), link, F.lit("</link></item>")), "title string, link string")
    rows = table(spark, d, "pages").select("page_id", parsed.alias("i"))
    return rows.select("page_id", F.regexp_extract("i.link", r"/([a-z0-9_-]+)/xml\.zip$", 1).alias("slug"), F.coalesce(collapse(F.col("i.title")), F.lit("")).alias("title"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'p1' WHEN 1 THEN 'p1-2' ELSE 'art3' END AS norm_key, CASE page_id % 3 WHEN 1 THEN 'repealed' ELSE 'in_force' END AS status FROM pages WHERE TRUE")
def law_norms(spark, d):
    """XML laws written from page ids: three pages share a law, keys become unique in it."""
    k = F.col("page_id")
    designation = F.array(F.lit("§ 1"), F.lit("§ 1"), F.lit("Art. 3"))[(k % 3).cast("int")]
    text = F.when(k % 3 == 1, "(weggefallen)").otherwise("Es gilt.")
    norm = F.concat(F.lit("<norm doknr='BJNR"), k.cast("string"), F.lit("'><metadaten><enbez>"), designation, F.lit("</enbez><titel>T"), k.cast("string"), F.lit("</titel></metadaten><textdaten><text><Content><P>"), text, F.lit("</P></Content></text></textdaten></norm>"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), norm.alias("n")))), lambda x: x["n"])
    laws = table(spark, d, "pages").groupBy(F.expr("page_id div 3").alias("law")).agg(F.concat(F.lit("<dokumente>"), F.array_join(ordered, ""), F.lit("</dokumente>")).alias("xml"))
    norms = documents.law_norms(laws, ["law"], "xml")
    return norms.select(F.substring("title", 2, 20).cast("long").alias("page_id"), "norm_key", "status")
