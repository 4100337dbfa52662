"""Markup to Markdown as block rows: headings, paragraphs, lists, tables, structure.

Documents are cut into blocks by one pattern; blocks are rows (document, place, tag, raw),
rendered by column expressions and joined again. A null document has no blocks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import collapse, escape_html, escape_line, escape_table_cell, group, norm_key, strip_tags, trimmed
from ..shipping import ship_package

BLOCK_TAGS = "h[1-6]|p|li|tr|pre|dt|dd|blockquote|title"
DROPPED = r"(?is)<(script|style|nav|head)\b.*?</\1\s*>|<!--.*?-->"
# Entities of plain markup.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescape(text: Column) -> Column:
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def inline(raw: Column) -> Column:
    """One line of Markdown: sup and sub stay, bold and links are kept, other tags go."""
    text = F.regexp_replace(raw, r"(?is)<a\b[^>]*?href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>", "\u0001$2\u0002$1\u0003")
    text = F.regexp_replace(text, r"(?i)<(/?)(?:b|strong)\b[^>]*>", "\u0004")
    text = F.regexp_replace(text, r"(?i)<(/?)(sup|sub)\b[^>]*>", "\u0005$1$2\u0006")
    text = escape_line(collapse(unescape(strip_tags(text))))
    for mark, written in (("\u0001", "["), ("\u0002", "]("), ("\u0003", ")"), ("\u0004", "**"), ("\u0005", "<"), ("\u0006", ">")):
        text = F.replace(text, F.lit(mark), F.lit(written))
    return text


def blocks(documents: DataFrame, keys: list[str], markup: str) -> DataFrame:
    """keys, place, tag, depth (of open lists), raw. A block ends where the next one or the
    end of its parent begins, so unclosed paragraphs are no problem."""
    body = F.regexp_replace(markup, DROPPED, " ")
    opened = F.split(body, rf"(?i)(?=<(?:{BLOCK_TAGS})\b)|(?=</?(?:ul|ol|dl|table)\b)|(?<=</(?:ul|ol|dl)>)")
    rows = documents.select(*keys, F.posexplode(opened).alias("place", "piece"))
    by = Window.partitionBy(*keys).orderBy("place")
    step = F.when(F.col("piece").rlike(r"(?i)^<(?:ul|ol|dl)\b"), 1).when(F.col("piece").rlike(r"(?i)^</(?:ul|ol|dl)\b"), -1).otherwise(0)
    rows = rows.withColumn("depth", F.sum(step).over(by))
    tag = F.lower(group(F.col("piece"), rf"(?i)^<({BLOCK_TAGS})\b"))
    raw = F.regexp_replace(F.regexp_replace("piece", r"^<[^>]*>", ""), rf"(?is)</(?:{BLOCK_TAGS})\s*>.*$", "")
    return rows.select(*keys, "place", tag.alias("tag"), "depth", raw.alias("raw")).filter("tag is not null")


def render_blocks(rows: DataFrame) -> DataFrame:
    """Adds line: the Markdown of a block; blocks without text go."""
    text = inline(F.col("raw"))
    level = F.when(F.col("tag").rlike("^h[1-6]$"), F.substring("tag", 2, 1).cast("int"))
    indent = F.repeat(F.lit("  "), F.greatest(F.col("depth") - 1, F.lit(0)).cast("int"))
    line = (
        F.when(level.isNotNull(), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text)).when(F.col("tag").isin("li", "dd"), F.concat(indent, F.lit("- "), text))
        .when(F.col("tag") == "blockquote", F.concat(F.lit("> "), text)).otherwise(text)
    )
    return rows.filter("tag <> 'tr'").withColumn("line", line).filter(text != "")


def to_markdown(documents: DataFrame, keys: list[str], markup: str) -> DataFrame:
    """keys, markdown, blocks: list items on lines of their own, other blocks apart."""
    rows = render_blocks(blocks(documents, keys, markup))
    both_items = F.col("tag").isin("li", "dd") & F.coalesce(F.lag("tag").over(Window.partitionBy(*keys).orderBy("place")).isin("li", "dd"), F.lit(False))
    rows = rows.withColumn("line", F.concat(F.when(both_items, "\n").otherwise("\n\n"), "line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "")
    return rows.groupBy(*keys).agg(F.concat(F.btrim(text, F.lit("\n")), F.lit("\n")).alias("markdown"), F.count(F.lit(1)).alias("blocks"))


def structure_nodes(documents: DataFrame, keys: list[str], markup: str) -> DataFrame:
    """Headings as a flat tree: keys, node, parent, depth, title, blocks under it.

    The parent is the last heading before it with a smaller level: for each level the last
    such place is carried forward, and the nearest of the smaller levels wins.
    """
    rows = render_blocks(blocks(documents, keys, markup)).withColumn("level", F.when(F.col("tag").rlike("^h[1-6]$"), F.substring("tag", 2, 1).cast("int")))
    by = Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.max(F.when(F.col("level") == k, F.col("place"))).over(by) for k in range(1, 7)}
    above = F.greatest(*[F.when(F.col("level") > k, last[k]) for k in last], F.lit(None).cast("int"))
    rows = rows.withColumn("parent", F.when(F.col("level").isNotNull(), above))
    rows = rows.withColumn("under", F.last(F.when(F.col("level").isNotNull(), F.col("place")), ignorenulls=True).over(by))
    counts = rows.filter("level is null and under is not null").groupBy(*keys, F.col("under").alias("place")).agg(F.count(F.lit(1)).alias("blocks"))
    heads = rows.filter("level is not null").join(counts, [*keys, "place"], "left")
    title = F.regexp_replace("line", "^#+ ", "")
    return heads.select(*keys, F.col("place").alias("node"), "parent", F.col("level").alias("depth"), title.alias("title"), F.coalesce("blocks", F.lit(0)).alias("blocks"))


CELL = r"(?is)<t[hd]\b([^>]*)>(.*?)</t[hd]>"


def table_rows(markup: Column) -> Column:
    """A table's cells: an array of rows of raw cells."""
    return F.transform(_row_markup(markup), lambda r: F.regexp_extract_all(r, F.lit(CELL), F.lit(2)))


def _row_markup(markup: Column) -> Column:
    return F.regexp_extract_all(markup, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))


def _html_cell(cell: Column) -> Column:
    """A cell with its row and column spans, so that merged cells keep their places."""
    head = F.regexp_extract(cell, CELL, 1)
    span = lambda name: F.regexp_extract(head, rf"(?i)\b{name}\s*=\s*[\"']?(\d+)", 1)
    written = [F.when(span(n) > "1", F.concat(F.lit(f' {n}="'), span(n), F.lit('"'))).otherwise("") for n in ("rowspan", "colspan")]
    return F.concat(F.lit("<td"), *written, F.lit(">"), escape_html(collapse(unescape(strip_tags(F.regexp_extract(cell, CELL, 2))))), F.lit("</td>"))


def is_ragged(rows: Column) -> Column:
    return F.size(F.array_distinct(F.transform(rows, F.size))) > 1


def column_span(first: Column, last: Column) -> Column:
    """Columns between two names that end in their number."""
    number = lambda c: F.nullif(F.regexp_replace(c, r"\D+", ""), F.lit("")).try_cast("int")
    return F.greatest(F.coalesce(number(last) - number(first) + 1, F.lit(1)), F.lit(1))


def render_table(markup: Column) -> Column:
    """GFM where all rows have the same width and no cell is merged, HTML otherwise."""
    rows = table_rows(markup)
    merged = markup.rlike(r"(?i)\b(?:row|col)span\s*=\s*[\"']?(?:[2-9]|\d\d)")
    cells = F.transform(rows, lambda r: F.transform(r, lambda c: escape_table_cell(inline(c))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = line(F.transform(cells[0], lambda _: F.lit("---")))
    gfm = F.array_join(F.concat(F.array(line(cells[0]), rule), F.transform(F.slice(cells, 2, F.greatest(F.size(cells), F.lit(1))), line)), "\n")
    html_row = lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(F.regexp_extract_all(r, F.lit(CELL), F.lit(0)), _html_cell), ""), F.lit("</tr>"))
    html = F.concat(F.lit("<table>\n"), F.array_join(F.transform(_row_markup(markup), html_row), "\n"), F.lit("\n</table>"))
    return F.when(F.size(rows) == 0, "").when(merged | is_ragged(rows), html).otherwise(gfm)


def law_norms(documents: DataFrame, keys: list[str], xml: str) -> DataFrame:
    """Norms of an XML law: keys, place, norm_key, designation, title, status, body, content_hash.

    Only norms with a designation or text count; headings alone belong to the structure,
    and a generated table of contents is dropped. Keys that repeat in a document get -2,
    -3 and so on, in its order.
    """
    norms = documents.select(*keys, F.posexplode(F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<norm\b.*?</norm>"), F.lit(0))).alias("place", "norm"))
    read = lambda path: F.nullif(trimmed(F.xpath_string("norm", F.lit(path))), F.lit(""))
    content = F.regexp_extract("norm", r"(?s)<Content>(.*?)</Content>", 1)
    body = F.array_join(F.filter(F.transform(F.regexp_extract_all(content, F.lit(r"(?s)<P\b[^>]*>(.*?)</P>"), F.lit(1)), inline), lambda p: p != ""), "\n\n")
    rows = norms.select(
        *keys, "place", read("/norm/@doknr").alias("document_id"), read("/norm/metadaten/enbez").alias("designation"), read("/norm/metadaten/titel").alias("title"), body.alias("body")
    )
    rows = rows.filter("designation is not null or body <> ''").filter("coalesce(designation, '') not in ('Inhaltsübersicht', 'Inhaltsverzeichnis')")
    low = F.lower(F.concat_ws(" ", "title", "body"))
    status = F.when(F.contains(low, F.lit("weggefallen")) | F.contains(low, F.lit("aufgehoben")), "repealed").otherwise("in_force")
    rows = rows.withColumns({"base": norm_key(F.col("designation"), F.col("document_id")), "status": status})
    return unique_keys(rows, keys, "base", "place").withColumn("content_hash", F.sha2(F.col("body").cast("binary"), 256)).withColumnRenamed("unique_key", "norm_key").drop("base", "document_id")


def unique_keys(rows: DataFrame, keys: list[str], base: str, order: str) -> DataFrame:
    """Adds unique_key, handed out in the order of a document: a key that is taken gets the
    first free number from 2 on, whether the taken one was numbered or written so. Only the
    keys of a document come together; ``order`` tells its rows apart."""

    def each(documents: pd.Series) -> pd.Series:
        return documents.map(numbered_keys)

    ship_package(rows.sparkSession)
    number = F.pandas_udf(each, "array<string>")
    narrow = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(base).alias("b")))).alias("all"))
    named = narrow.select(*keys, F.explode(F.arrays_zip(F.col("all.o").alias("o"), number(F.col("all.b")).alias("unique_key"))).alias("x"))
    return rows.join(named.select(*keys, F.col("x.o").alias(order), F.col("x.unique_key").alias("unique_key")), [*keys, order])


def numbered_keys(keys) -> list[str | None]:
    taken: set[str] = set()
    out = []
    for key in keys:
        unique, k = key, 2
        while key is not None and unique in taken:
            unique, k = f"{key}-{k}", k + 1
        taken.add(unique)
        out.append(unique)
    return out
