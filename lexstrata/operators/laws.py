"""Laws from their containers: norms with Markdown bodies, keys and structure, and law records.

A norm is a row; its XML is folded once into fields and lines (``operators.law_markup``), and all
that follows is columns, joins and aggregates: sentences, escapes, list indents, keys, headings,
metadata. Only names and depths of a law's norms, never their texts, come together in one row.

Defined cases: a container with an error gives no law (``failed_containers`` names it); a header
without text is no norm; a generated table of contents and headings without text are none either;
fields that are missing or blank are null; an empty folder gives empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, escape_line, escape_list_marker, norm_key
from ..shipping import ship_package
from ..sources.files import shared_folder
from .documents import numbered_keys
from .law_markup import Norm
from .sentences import sentences

# Names that the normaliser knows, and texts it writes.
CONTENTS, INTRODUCTION, REMARKS = "Inhaltsübersicht", "Eingangsformel", "hinweise"
REPEALED_TEXT, NO_TEXT = "(weggefallen)", "(kein Text)"
FOLD_CHARACTERS = 1 << 20
FOLDED = """designation string, title string, long_title string, short_title string, abbreviation string, law_key string, issued string,
    unit struct<code: string, label: string, title: string>, notes array<struct<kind: string, text: string>>, places array<struct<kind: string, periodical: string, page: string>>,
    lines array<struct<block: int, kind: string, depth: int, marker: string, text: string>>,
    cells array<struct<grid: int, section: string, row: int, column: int, width: int, height: int, text: string>>, norm_id string"""


def in_pieces(batch: pd.DataFrame, text: str, most: int = FOLD_CHARACTERS) -> Iterator[pd.DataFrame]:
    """Slices of a batch whose texts begin within ``most`` characters of each other."""
    starts = batch[text].str.len().cumsum().shift(fill_value=0) // most
    for _, piece in batch.groupby(starts.to_numpy(), sort=True):
        yield piece


def fold_norms(norms: DataFrame, base_url: str) -> DataFrame:
    """slug, document_id, position and the folded fields, lines and cells of each norm."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (piece for whole in batches for piece in in_pieces(whole, "xml")):
            rows = []
            for slug, document_id, position, xml in zip(batch["slug"], batch["document_id"], batch["position"], batch["xml"], strict=True):
                n = Norm(f"{base_url.rstrip('/')}/{slug}").read(xml)
                f, u = n.fields, n.unit
                rows.append((
                    slug, document_id, position, *(f.get(k) for k in ("enbez", "titel", "langue", "kurzue", "amtabk", "jurabk", "ausfertigung-datum")),
                    u and (u.get("gliederungskennzahl"), u.get("gliederungsbez"), u.get("gliederungstitel")),
                    [(x.get("standtyp"), x.get("standkommentar")) for x in n.notes], [(x["typ"], x.get("periodikum"), x.get("zitstelle")) for x in n.places],
                    [tuple(x) for x in n.lines], n.cells, n.document_id,
                ))
            yield pd.DataFrame(rows, columns=columns)

    ship_package(norms.sparkSession)
    schema = "slug string, document_id string, position int, " + FOLDED
    good = norms.filter("error is null").select("slug", "document_id", "position", "xml")
    columns = ["slug", "document_id", "position", "designation", "title", "long_title", "short_title", "abbreviation", "law_key", "issued", "unit", "notes", "places", "lines", "cells", "norm_id"]
    broken = norms.filter("error is not null").select("slug").distinct()
    folded = good.join(broken, "slug", "left_anti").repartition("slug", "position").mapInPandas(fold, schema)
    texts = ["designation", "title", "long_title", "short_title", "abbreviation", "law_key", "issued"]
    return folded.withColumns({c: F.nullif(collapse(F.col(c)), F.lit("")) for c in texts})


def normalised(norms: DataFrame, base_url: str) -> DataFrame:
    """Folded norms with their bodies, written to the shared folder: parsed once, however many
    tables are made of them."""
    return written(bodies(fold_norms(norms, base_url)), "law-norms")


def written(rows: DataFrame, name: str) -> DataFrame:
    spark, path = rows.sparkSession, shared_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def failed_containers(norms: DataFrame) -> DataFrame:
    return norms.filter("error is not null").select("path", "slug", "error")


def line_text(line: Column) -> Column:
    """A line of a block: sentences on lines of their own, items under their printed marker."""

    def item(found: Column) -> Column:
        indent = F.repeat(F.lit("  "), line["depth"])
        label = F.coalesce(F.concat(F.nullif(escape_list_marker(line["marker"]), F.lit("")), F.lit(" ")), F.lit(""))
        first = F.concat(indent, F.lit("- "), label, F.coalesce(F.get(found, F.lit(0)), F.lit("")))
        rest = F.transform(F.slice(found, 2, F.greatest(F.size(found), F.lit(1))), lambda s: F.concat(indent, F.lit("  "), s))
        return F.rtrim(F.array_join(F.concat(F.array(first), rest), "\n"))

    found = F.transform(sentences(line["text"]), escape_line)
    return F.when(line["kind"] == "verbatim", line["text"]).when(line["kind"] == "item", item(found)).otherwise(F.array_join(found, "\n"))


def bodies(folded: DataFrame) -> DataFrame:
    """Adds body: lines of one block on lines, blocks a line apart."""
    written = folded.withColumn("_written", F.transform("lines", lambda x: F.struct(x["block"].alias("block"), line_text(x).alias("text"))))
    gap = lambda i: F.when(F.get("_written", i)["block"] == F.get("_written", i - 1)["block"], "\n").otherwise("\n\n")
    body = F.array_join(F.transform("_written", lambda x, i: F.concat(F.when(i == 0, "").otherwise(gap(i)), x["text"])), "")
    return written.withColumn("body", F.btrim(body, F.lit(" \t\n\r\x00\x0b"))).drop("_written", "lines")


def outline(norms: Column) -> Column:
    """For each of a law's norms in order (key or null, depth of its heading or 0): its key
    made unique, the heading it stands under or opens, and that heading's parent."""

    def one(norms) -> list[tuple]:
        path: list[int] = []
        out = []
        for i, (n, key) in enumerate(zip(norms, numbered_keys([n["key"] for n in norms]))):
            depth, parent = n["depth"], None
            if depth:
                path = path[: depth - 1]
                parent = path[-1] if path else None
                path.append(i)
            out.append((key, path[-1] if path else None, parent))
        return out

    def each(laws: pd.Series) -> pd.Series:
        return laws.map(one)

    ship_package()
    return F.pandas_udf(each, "array<struct<unique_key: string, node: int, parent: int>>")(norms)


def law_tables(folded: DataFrame, base_url: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(laws, norms, structure) of normalised norms.

    norms: slug, place, norm_key, designation, title, status, markdown, norm_id, node. structure: slug, node,
    parent, label, title, norm_keys. laws: slug, document_id, kind, title, short_title, abbreviation,
    official_abbreviation, issued, promulgation, status_note, last_amending_act, pending_amendments, source_url.
    Nodes are places of headings in the law.
    """
    header, empty = F.col("position") == 0, F.col("body") == ""
    other = folded.filter(~header & (F.col("designation").isNull() | (F.col("designation") != CONTENTS)))
    opens = F.when(F.col("unit").isNotNull(), F.greatest(F.ceil(F.length(F.coalesce("unit.code", F.lit(""))) / 3).cast("int"), F.lit(1)))
    bare = F.col("unit").isNotNull() & empty & F.col("designation").isNull()
    named = other.select("slug", "position", "designation", "title", "unit", "body", "norm_id", opens.alias("depth"), F.when(~bare, norm_key(F.col("designation"), F.col("norm_id"))).alias("key"))
    # The header's own text is the law's first norm; it gives way to an explicit introduction.
    introduced = other.groupBy("slug").agg(F.max(F.coalesce(F.col("designation") == INTRODUCTION, F.lit(False))).alias("has_introduction"))
    first = folded.filter(header & ~empty).join(introduced, "slug", "left")
    first = first.select("slug", "position", "designation", "title", F.lit(None).cast(folded.schema["unit"].dataType).alias("unit"), "body", "norm_id", F.lit(None).cast("int").alias("depth"), F.when(F.col("has_introduction"), REMARKS).otherwise(INTRODUCTION.lower()).alias("key"))
    rows = named.unionByName(first)

    narrow = rows.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("position", "key", F.coalesce("depth", F.lit(0)).alias("depth")))).alias("all"))
    placed = narrow.select("slug", "all", outline(F.col("all")).alias("out")).select("slug", F.posexplode(F.arrays_zip("all", "out")).alias("order", "x"))
    placed = placed.select("slug", F.col("x.all.position").alias("position"), "order", F.col("x.out.unique_key").alias("norm_key"), F.col("x.out.node").alias("node"), F.col("x.out.parent").alias("parent"))
    joined = rows.drop("key").join(placed, ["slug", "position"])

    low = F.lower(F.concat_ws(" ", "title", "body"))
    repealed = F.contains(low, F.lit("weggefallen")) | F.contains(low, F.lit("aufgehoben"))
    status = F.when(repealed, "repealed").otherwise("in_force")
    markdown = F.when(~empty, F.col("body")).when(repealed, REPEALED_TEXT).otherwise(NO_TEXT)
    kept = joined.filter("norm_key is not null")
    kept = kept.select("slug", F.col("order").alias("place"), "norm_key", "designation", "title", status.alias("status"), markdown.alias("markdown"), "norm_id", "node")

    under = kept.filter("node is not null").groupBy("slug", "node").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "norm_key"))), lambda x: x["norm_key"]).alias("norm_keys"))
    heads = joined.filter("depth is not null").select("slug", "node", "parent", F.nullif("unit.label", F.lit("")).alias("label"), F.nullif("unit.title", F.lit("")).alias("title"))
    structure = heads.join(under, ["slug", "node"], "left").withColumn("norm_keys", F.coalesce("norm_keys", F.array().cast("array<string>")))
    return law_records(folded.filter(header), base_url), kept, structure


def law_kind(long_title: Column, short_title: Column, abbreviation: Column) -> Column:
    """The kind of a law, by the first word that its titles hold."""
    text = F.lower(F.concat_ws(" ", F.coalesce(long_title, F.lit("")), F.coalesce(short_title, F.lit(""))))
    has = lambda w: F.contains(text, F.lit(w))
    kind = F.when(has("ordnung"), "verordnung").when(has("bekanntmachung"), "bekanntmachung").when(has("satzung"), "satzung").when(has("gesetz"), "gesetz")
    return kind.when(F.coalesce(abbreviation.endswith("V"), F.lit(False)), "verordnung").otherwise("sonstige")


def law_records(headers: DataFrame, base_url: str) -> DataFrame:
    said = F.filter(F.transform("notes", lambda x: F.struct(x["kind"].alias("kind"), F.nullif(collapse(x["text"]), F.lit("")).alias("text"))), lambda x: x["text"].isNotNull())
    of = lambda *kinds: F.transform(F.filter(said, lambda x: x["kind"].isin(*kinds)), lambda x: x["text"])
    rest = F.transform(F.filter(said, lambda x: x["kind"].isNull() | ~x["kind"].isin("Stand", "Hinweis")), lambda x: x["text"])
    official = F.filter("places", lambda x: (x["kind"] == "amtlich") & (F.coalesce(x["periodical"], F.lit("")) != "") & (F.coalesce(x["page"], F.lit("")) != ""))
    return headers.select(
        "slug", "document_id", law_kind(F.col("long_title"), F.col("short_title"), F.col("abbreviation")).alias("kind"), F.coalesce("long_title", "short_title", "slug").alias("title"), "short_title",
        F.coalesce("abbreviation", "law_key").alias("abbreviation"), F.col("abbreviation").alias("official_abbreviation"),
        F.when(F.col("issued").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("issued").try_cast("date")).alias("issued"),
        F.get(F.transform(official, lambda x: F.concat_ws(" ", x["periodical"], x["page"])), F.lit(0)).alias("promulgation"),
        F.nullif(F.array_join(rest, " "), F.lit("")).alias("status_note"), F.try_element_at(of("Stand"), F.lit(-1)).alias("last_amending_act"),
        of("Hinweis").alias("pending_amendments"), F.concat(F.lit(base_url.rstrip("/") + "/"), "slug", F.lit("/")).alias("source_url"),
    )


def table_cells(folded: DataFrame) -> DataFrame:
    """slug, position, grid (table of the norm), section, row, column, width, height, text of each cell."""
    return folded.select("slug", "position", F.explode("cells").alias("c")).select("slug", "position", "c.*")
