"""Issue rows for facts and translations.

Facts: an amount needs a quote that the text holds, and the quote its value; a date follows
from its rule, or stands in the text. Translations: the same placeholders and sections as the
master, no values written out, the right language, no forbidden wording, and the glossary's
renderings. Issues are (subject, severity, code, path), one row each.

Null quotes, rules and sections count as empty; a null value or date is not checked; a card
without sections has no issues but those of its master.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text
from ..functions.language import detect_language
from ..sources.files import shared_folder
from .quality import ERROR, WARNING, issues, merged, phrase_matches, value_in_quote

SUMMARY_LIMIT = 280
CARD_LIMIT = 8000
_ISSUE = "struct<severity:string,code:string,path:string>"


def _issue(severity: str, code: str, path: Column | None = None) -> Column:
    path = F.lit(None).cast("string") if path is None else path
    return F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), path.alias("path")).cast(_ISSUE)


def _some(*checks: tuple[Column, Column]) -> Column:
    """The issues whose test holds."""
    return F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), issue) for when, issue in checks]))


def _rows(df: DataFrame, subject: str, found: Column) -> DataFrame:
    return df.select(F.col(subject).cast("string").alias("subject"), F.explode(found).alias("_i")).select("subject", "_i.severity", "_i.code", "_i.path")


def _filled(c: str | Column) -> Column:
    return F.coalesce(text.trimmed(F.col(c) if isinstance(c, str) else c), F.lit(""))


def amount_issues(amounts: DataFrame, subject: str = "subject") -> DataFrame:
    """``amounts``: subject, place, source_quote, new, old, text (that the quote comes from)."""
    quote = text.grouped_numbers_joined(_filled("source_quote"))
    path = F.concat(F.lit("amounts["), F.col("place").cast("string"), F.lit("]"))
    quoted = F.contains(text.grouped_numbers_joined(F.col("text")), quote)
    wrong = lambda c: F.col(c).isNotNull() & ~value_in_quote(quote, F.col(c))
    values = _some(
        (wrong("new"), _issue(ERROR, "fact.value_not_in_quote", F.concat(path, F.lit(".new")))),
        (wrong("old"), _issue(WARNING, "fact.value_not_in_quote", F.concat(path, F.lit(".old")))),
    )
    found = (
        F.when(quote == "", F.array(_issue(ERROR, "fact.quote_missing", path)))
        .when(~F.coalesce(quoted, F.lit(False)), F.array(_issue(ERROR, "fact.quote_not_found", F.concat(path, F.lit(".source_quote")))))
        .otherwise(values)
    )
    return _rows(amounts, subject, found)


def date_issues(entries: DataFrame, subject: str = "subject") -> DataFrame:
    """``entries``: subject, section, place, rule_text, derived, date, promulgated, text."""
    rule, day, since = _filled("rule_text"), F.col("date"), F.col("promulgated")
    haystack = text.grouped_numbers_joined(F.col("text"))
    path = F.concat(F.lit("dates."), "section", F.lit("["), F.col("place").cast("string"), F.lit("]"))
    derived = F.coalesce("derived", F.lit(False))
    complete = day.isNotNull() & (rule != "") & since.isNotNull()
    agrees = F.coalesce(dates.effective_date(rule, since) == day, F.lit(False))
    spelt = F.exists(dates.spellings(day), lambda s: F.contains(haystack, text.grouped_numbers_joined(s)))
    found = _some(
        ((rule != "") & ~F.coalesce(F.contains(haystack, text.grouped_numbers_joined(rule)), F.lit(False)), _issue(ERROR, "fact.rule_not_found", F.concat(path, F.lit(".rule_text")))),
        (derived & ~complete, _issue(ERROR, "fact.derived_incomplete", path)),
        (derived & complete & ~agrees, _issue(ERROR, "fact.derived_mismatch", F.concat(path, F.lit(".date")))),
        (~derived & day.isNotNull() & (rule == "") & ~F.coalesce(spelt, F.lit(False)), _issue(WARNING, "fact.date_not_found", F.concat(path, F.lit(".date")))),
    )
    return _rows(entries, subject, found)


def _values(sections: Column) -> Column:
    return F.coalesce(F.map_values(sections), F.array().cast("array<string>"))


def _bare_values(sections: Column) -> Column:
    each = lambda e: F.transform(text.bare_values(e["value"]), lambda _: _issue(ERROR, "translation.bare_value", F.concat(F.lit("sections."), e["key"])))
    return F.flatten(F.transform(F.filter(F.map_entries(sections), lambda e: e["value"].isNotNull()), each))


def _lengths(sections: Column, limit: int) -> Column:
    total = F.aggregate(_values(sections), F.lit(0), lambda n, t: n + F.coalesce(F.length(t), F.lit(0)))
    return _some(
        (F.length(text.trimmed(sections["summary"])) > SUMMARY_LIMIT, _issue(ERROR, "card.summary_too_long", F.lit("sections.summary"))),
        (total > limit, _issue(WARNING, "card.too_long")),
    )


# What is said of a phrase of each category, and of any other.
SAID = {"advice": "reads as legal advice; describe what the law provides instead.", "opinion": "is an evaluation; the text has to stay neutral."}
SAID_OTHERWISE = "is not allowed in a card."


def wording_hits(cards: DataFrame, sections: str, phrases: DataFrame, subject: str = "subject", lang: str = "lang") -> DataFrame:
    """subject, path, phrase, category, message of each forbidden phrase in a section.

    ``phrases``: phrase, lang, and a category if they have one. A phrase counts in cards of
    its language only, ignoring case; of repeated phrases the smallest category counts.
    """
    category = F.col("category") if "category" in phrases.columns else F.lit(None).cast("string")
    listed = phrases.groupBy(F.lower("phrase").alias("_p"), F.col("lang").alias("_plang")).agg(F.min(category).alias("category"))
    listed = listed.withColumn("_pkey", F.concat_ws(":", "_plang", "_p"))
    each = cards.select(F.col(subject).cast("string").alias("subject"), F.col(lang).alias("_lang"), F.explode(sections).alias("_key", "_text"))
    each = each.withColumn("_row", F.concat_ws("\0", F.coalesce("subject", F.lit("")), F.coalesce("_lang", F.lit("")), "_key")).withColumn("_low", F.lower("_text"))
    # No phrase counts in other languages. Lists are sent to the texts, which share a few languages and phrases.
    each = each.join(F.broadcast(listed.select(F.col("_plang").alias("_lang")).distinct()), "_lang", "left_semi")
    hits = phrase_matches(each, listed, "_low", "_p", "_row", "_pkey")
    named = hits.join(each.select("_row", "subject", "_lang", "_key"), "_row").join(F.broadcast(listed), "_pkey").filter("_lang = _plang")
    said = F.coalesce(F.create_map(*[F.lit(x) for pair in SAID.items() for x in pair])[F.coalesce("category", F.lit(""))], F.lit(SAID_OTHERWISE))
    message = F.concat(F.lit('"'), "_p", F.lit('" '), said)
    return named.select("subject", F.concat(F.lit("sections."), "_key").alias("path"), F.col("_p").alias("phrase"), "category", message.alias("message"))


def wording_issues(cards: DataFrame, sections: str, phrases: DataFrame, subject: str = "subject", lang: str = "lang") -> DataFrame:
    """An issue for each of the :func:`wording_hits`."""
    hits = wording_hits(cards, sections, phrases, subject, lang)
    return issues(hits, F.lit(True), F.col("subject"), ERROR, "card.forbidden_wording", F.col("path"))


def glossary_issues(cards: DataFrame, glossary: DataFrame, subject: str = "subject") -> DataFrame:
    """Terms the master mentions whose rendering the translation lacks. ``cards``: subject,
    master, translation (maps); ``glossary``: term, rendering."""
    joined = cards.select(F.col(subject).cast("string").alias("subject"), F.array_join(_values(F.col("master")), "\n").alias("_m"), F.array_join(_values(F.col("translation")), "\n").alias("_t"))
    listed = glossary.select("term", "rendering").dropDuplicates(["term"])
    mentioned = phrase_matches(joined, listed, "_m", "term", "subject", "term").distinct()
    pairs = mentioned.join(F.broadcast(listed), "term").join(joined.select("subject", "_t"), "subject")
    return issues(pairs, ~F.contains("_t", "rendering"), F.col("subject"), WARNING, "translation.glossary_term_missing")


def master_issues(cards: DataFrame, phrases: DataFrame, subject: str = "subject", limit: int = CARD_LIMIT) -> DataFrame:
    """The checks that need no translation. ``cards``: subject, lang, master (map)."""
    found = F.concat(_bare_values(F.col("master")), _lengths(F.col("master"), limit))
    return merged(_rows(cards, subject, found), wording_issues(cards, "master", phrases, subject))


def translation_issues(cards: DataFrame, keys: list[str], phrases: DataFrame, glossary: DataFrame, subject: str = "subject", limit: int = CARD_LIMIT, **detection) -> DataFrame:
    """All checks of a translation. ``cards``: subject, lang, master, translation (maps). They
    are written to the shared folder first: three kinds of checks read them, phrases twice."""
    spark, path = cards.sparkSession, shared_folder(cards.sparkSession, "cards")
    cards.select(subject, "lang", "master", "translation").write.parquet(path)
    cards = spark.read.schema(cards.select(subject, "lang", "master", "translation").schema).parquet(path)
    master, other = F.col("master"), F.col("translation")
    named = lambda sections: F.array_distinct(F.flatten(F.transform(F.filter(_values(sections), lambda t: t.isNotNull()), text.placeholders)))
    held = lambda sections, key: F.coalesce(text.trimmed(sections[key]), F.lit(""))
    plain = F.regexp_replace(F.array_join(F.transform(_values(other), text.trimmed), "\n"), text.PLACEHOLDER, " ")
    found = F.concat(
        F.transform(F.array_except(named(master), named(other)), lambda _: _issue(ERROR, "translation.placeholder_missing")),
        F.transform(F.array_except(named(other), named(master)), lambda _: _issue(ERROR, "translation.placeholder_added")),
        _bare_values(other),
        _some(*[((held(master, k) != "") & (held(other, k) == ""), _issue(ERROR, "translation.section_missing", F.lit(f"sections.{k}"))) for k in keys]),
        F.transform(F.filter(F.map_keys(other), lambda k: ~k.isin(*keys)), lambda k: _issue(ERROR, "translation.unknown_section", F.concat(F.lit("sections."), k))),
        _lengths(other, limit),
        _some((detect_language(plain, **detection) != F.col("lang"), _issue(ERROR, "translation.wrong_language"))),
    )
    return merged(_rows(cards, subject, found), wording_issues(cards, "translation", phrases, subject), glossary_issues(cards, glossary, subject))
