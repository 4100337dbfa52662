"""Dates: effective-date rules, explicit and spelled dates, ISO weeks.

Rules are read as lists of words: a known word (the promulgation, a month) is found first,
and the words before it are compared one by one and looked up in tables.

``plus_months`` overflows into the next month (31 January + 1 month is 3 March in a
common year), as the rules being matched do; ``overflow=False`` clamps instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .text import collapse, first_place, preceded_by, tokens_of

# German month names, ordinals and number words.
MONTHS = {
    "januar": 1, "februar": 2, "märz": 3, "maerz": 3, "april": 4, "mai": 5, "juni": 6,
    "juli": 7, "august": 8, "september": 9, "oktober": 10, "november": 11, "dezember": 12,
}
ORDINALS = {
    "ersten": 1, "zweiten": 2, "dritten": 3, "vierten": 4, "fünften": 5, "fuenften": 5, "sechsten": 6,
    "siebten": 7, "siebenten": 7, "achten": 8, "neunten": 9, "zehnten": 10, "elften": 11, "zwölften": 12, "zwoelften": 12,
}
NUMBER_WORDS = {
    "einem": 1, "einen": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "fuenf": 5, "sechs": 6, "sieben": 7,
    "acht": 8, "neun": 9, "zehn": 10, "elf": 11, "zwölf": 12, "zwoelf": 12,
}
# Spellings of days and months as units, and of the month that follows.
DAY_UNITS = ("tag", "tage", "tagen")
MONTH_UNITS = ("monat", "monate", "monaten")
WHOLE_MONTHS = ("monats", "kalendermonats")
MONTH_NAMES = ["januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember"]


def _lookup(values: dict[str, int], key: Column) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v))]
    return F.create_map(*pairs)[key]


def checked_date(year: Column, month: Column, day: Column) -> Column:
    """A date, or null where the calendar has none."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int")), "yyyy-MM-dd")


def iso_date(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def _date_in(tokens: Column) -> Column:
    """The first day that tokens (spaces among them) spell, by month name or else by number.
    ``found`` tells a day the calendar does not have from none at all."""
    token = lambda i: F.get(tokens, i)
    number = lambda i, *sizes: F.coalesce(token(i).rlike(r"^\d+$") & F.length(token(i)).isin(*sizes), F.lit(False))
    stop = lambda i: F.coalesce(token(i) == ".", F.lit(False))
    name = lambda i: i + F.when(token(i + 2) == " ", 3).otherwise(2)

    def named(i: Column) -> Column:
        m = name(i)
        return number(i, 1, 2) & stop(i + 1) & F.coalesce(token(m).isin(*MONTHS) & (token(m + 1) == " "), F.lit(False)) & number(m + 2, 4)

    def plain(i: Column) -> Column:
        return number(i, 1, 2) & stop(i + 1) & number(i + 2, 1, 2) & stop(i + 3) & number(i + 4, 4)

    def read(at: Column) -> Column:
        n, p = at["named"], at["plain"]
        by_name = checked_date(token(name(n) + 2), _lookup(MONTHS, token(name(n))), token(n))
        by_number = checked_date(token(p + 4), token(p + 2), token(p))
        day = F.when(n.isNotNull(), by_name).when(p.isNotNull(), by_number)
        return F.struct(F.coalesce(n, p).isNotNull().alias("found"), day.alias("day"))

    return let(F.struct(first_place(tokens, named).alias("named"), first_place(tokens, plain).alias("plain")), read)


def explicit_date(text: Column) -> Column:
    """``1. Januar 2027`` or ``01.01.2027``; null for impossible days."""
    return let(tokens_of(collapse(F.lower(text)), spaces=True), lambda t: _date_in(t)["day"])


def plus_months(day: Column, months: Column, overflow: bool = True) -> Column:
    if not overflow:
        return F.add_months(day, months)
    return F.date_add(F.add_months(F.trunc(day, "MM"), months), F.dayofmonth(day) - 1)


def _counted(words: Column, unit: tuple[str, ...]) -> Column:
    """Place of the promulgation in "<count> <unit> nach der Verkündung"."""
    return first_place(words, lambda i: (F.get(words, i) == "verkündung") & preceded_by(words, i, unit, "nach", "der") & F.get(words, i - 4).isNotNull())


def _calculated(words: Column, promulgated: Column, overflow: bool) -> Column:
    """The day that the words before the promulgation, or before a following month, give."""
    first = F.trunc(promulgated, "MM")
    single = ("tag", "tage")
    start = ("am", "ersten", "tag", "des")
    after = first_place(words, lambda i: (F.get(words, i) == "verkündung") & preceded_by(words, i, "am", single, "nach", "der"))
    same = first_place(words, lambda i: (F.get(words, i) == "verkündung") & preceded_by(words, i, "am", single, "der"))
    # Where "[auf die Verkündung] folgenden Monats" begins.
    head = lambda i: i - 1 - F.when(preceded_by(words, i - 1, "auf", "die", "verkündung"), 3).otherwise(0)
    follows = lambda i: F.get(words, i).isin(*WHOLE_MONTHS) & preceded_by(words, i, "folgenden")
    nth = first_place(words, lambda i: follows(i) & preceded_by(words, head(i) - 1, *start) & (head(i) > 4))
    next_ = first_place(words, lambda i: follows(i) & preceded_by(words, head(i), *start))

    def day(at: Column) -> Column:
        count = lambda i: F.coalesce(F.get(words, i - 4).try_cast("int"), _lookup(NUMBER_WORDS, F.get(words, i - 4)))
        return (
            F.when(at["after"].isNotNull(), F.date_add(promulgated, 1))
            .when(at["same"].isNotNull(), promulgated)
            .when(at["nth"].isNotNull(), F.add_months(first, _lookup(ORDINALS, F.get(words, head(at["nth"]) - 1))))
            .when(at["next"].isNotNull(), F.add_months(first, F.lit(1)))
            .when(at["months"].isNotNull(), plus_months(promulgated, count(at["months"]), overflow))
            .when(at["days"].isNotNull(), F.date_add(promulgated, count(at["days"])))
        )

    places = {"after": after, "same": same, "nth": nth, "next": next_, "months": _counted(words, MONTH_UNITS), "days": _counted(words, DAY_UNITS)}
    return let(F.struct(*[p.alias(n) for n, p in places.items()]), day)


def effective_date(rule: Column, promulgated: Column, overflow: bool = True) -> Column:
    """The day a rule takes effect: the day it names, else the day its words give from the
    promulgation; null for a rule that is not understood."""

    def read(tokens: Column) -> Column:
        spelt = F.when(F.exists(tokens, lambda t: t.rlike(r"^\d{4}$")), _date_in(tokens)["day"])
        words = F.filter(tokens, lambda t: t.rlike(r"(?U)^\w"))
        known = F.exists(words, lambda w: w.isin("verkündung", *WHOLE_MONTHS))
        return F.coalesce(spelt, F.when(known, let(words, lambda w: _calculated(w, promulgated, overflow))))

    return let(tokens_of(collapse(F.lower(rule)), spaces=True), read)


def spellings(day: Column) -> Column:
    """The four ways a text may spell a day, in lower case."""
    month = F.array(*[F.lit(m) for m in MONTH_NAMES])[F.month(day) - 1]
    d, m, y = F.dayofmonth(day), F.month(day), F.year(day)
    return F.array(F.format_string("%d. %s %d", d, month, y), F.format_string("%02d.%02d.%d", d, m, y), F.format_string("%d.%d.%d", d, m, y), F.date_format(day, "yyyy-MM-dd"))


def iso_week(day: Column) -> Column:
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), day), F.weekofyear(day))
