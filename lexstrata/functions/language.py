"""Language of a text from its script, marker letters and stop words; null when unsure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .text import strip_tags

# Fixed values.
MINIMUM_LETTERS = 40
UKRAINIAN_ONLY = "іїєґ"
RUSSIAN_ONLY = "ыэъё"
TURKISH_ONLY = "ışğ"
STOPWORDS = {
    "ru": ["что", "если", "который", "может", "нужно", "также", "этот", "вы", "для"],
    "uk": ["що", "якщо", "який", "може", "потрібно", "також", "цей", "ви", "для"],
    "en": ["the", "and", "that", "this", "from", "with", "you", "for", "law"],
    "tr": ["ve", "bir", "için", "olan", "bu", "ile", "daha", "gerek"],
    "de": ["und", "der", "die", "das", "nicht", "wird", "werden", "für", "gesetz"],
}


def _by_stopwords(words: Column, candidates: list[str], stopwords: dict[str, list[str]]) -> Column:
    """The language with most hits, every occurrence counted; a tie or no hit is null."""

    def winner(hits: Column) -> Column:
        best = F.array_max(F.array(*[hits[c] for c in candidates]))
        winners = F.array_compact(F.array(*[F.when(hits[c] == best, c) for c in candidates]))
        return F.when((best > 0) & (F.size(winners) == 1), winners[0])

    count = lambda known: F.size(F.filter(words, lambda w: w.isin(*known)))
    return let(F.struct(*[count(stopwords[c]).alias(c) for c in candidates]), winner)


def detect_language(text: Column, latin: tuple[str, ...] = ("en", "tr", "de"), stopwords: dict[str, list[str]] = STOPWORDS) -> Column:
    def of_plain(plain: Column) -> Column:
        letters, cyrillic = (F.length(F.regexp_replace(plain, f"[^{c}]+", "")) for c in (r"\p{L}", r"\p{IsCyrillic}"))
        count = lambda chars: F.length(plain) - F.length(F.translate(plain, chars, ""))
        # Split once; only stop words of some candidate go on.
        every = sorted({w for known in stopwords.values() for w in known})
        stops = F.filter(F.split(plain, r"\P{L}+"), lambda w: w.isin(*every))
        by_words = lambda c: let(stops, lambda words: _by_stopwords(words, c, stopwords))
        markers = F.struct(count(UKRAINIAN_ONLY).alias("uk"), count(RUSSIAN_ONLY).alias("ru"))
        east = let(markers, lambda m: F.when(m["uk"] > m["ru"], "uk").when(m["ru"] > m["uk"], "ru").otherwise(by_words(["ru", "uk"])))
        west = by_words(list(latin))
        if "tr" in latin:
            west = F.when(plain.rlike(f"[{TURKISH_ONLY}]"), "tr").otherwise(west)
        sizes = F.struct(letters.alias("letters"), cyrillic.alias("cyrillic"))
        return let(sizes, lambda n: F.when(n["letters"] >= MINIMUM_LETTERS, F.when(n["cyrillic"] > n["letters"] / 2, east).otherwise(west)))

    return let(F.lower(strip_tags(text)), of_plain)
