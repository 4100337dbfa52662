"""Cards: sections under ``## Heading {#key}``, front matter, staleness hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed

ANCHOR = r"(?m)^## [^\n]*\{#([a-z_]+)\}\s*$"


def front_matter(file: Column) -> Column:
    """Struct of header (null without one) and body."""
    has = file.startswith("---\n") & (F.locate("\n---\n", file, 4) > 0)
    end = F.locate("\n---\n", file, 4)
    header = F.when(has, F.substr(file, F.lit(5), end - 5))
    body = F.when(has, F.substr(file, end + 5)).otherwise(file)
    return F.struct(header.alias("header"), body.alias("body"))


def parse_card(body: Column) -> Column:
    """Map of section key to trimmed text; of repeated keys the last wins."""
    keys = F.regexp_extract_all(body, F.lit(ANCHOR), F.lit(1))
    texts = F.slice(F.split(body, ANCHOR), 2, F.greatest(F.size(keys), F.lit(1)))
    pairs = F.arrays_zip(keys.alias("k"), F.transform(texts, trimmed).alias("v"))
    last = F.filter(F.transform(pairs, lambda p, i: F.struct(i.alias("i"), p.alias("p"))), lambda x: ~F.exists(F.slice(keys, x["i"] + 2, F.size(keys)), lambda k: k == x["p"]["k"]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["p"]["k"], x["p"]["v"])))


def render_card(sections: Column, order: list[str], headings: dict[str, str]) -> Column:
    parts = [F.when(F.coalesce(F.try_element_at(sections, F.lit(k)), F.lit("")) != "", F.concat(F.lit(f"## {headings[k]} {{#{k}}}\n\n"), F.try_element_at(sections, F.lit(k)), F.lit("\n"))) for k in order]
    return F.concat_ws("\n", *parts)


def master_hash(sections: Column, order: list[str], placeholders: Column) -> Column:
    """Hash of the section bodies in fixed order and the sorted placeholders."""
    bodies = [F.coalesce(F.try_element_at(sections, F.lit(k)), F.lit("")) for k in order]
    return F.sha2(F.array_join(F.concat(F.array(*bodies), F.sort_array(placeholders)), "\0").cast("binary"), 256)


def stale(translations: DataFrame, masters: DataFrame, subject: str, hash_: str) -> DataFrame:
    """Translations made from another state of their master, or without one."""
    now = masters.select(subject, F.col(hash_).alias("_now"))
    return translations.join(now, subject, "left").filter(~F.col(hash_).eqNullSafe(F.col("_now"))).drop("_now")
