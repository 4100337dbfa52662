"""Text functions as column expressions. All of them keep null as null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

# Spaces that count as a plain space, and letters written out in slugs.
WIDE_SPACES = "\u00a0\u202f\u2009"
TRANSLITERATION = {"ä": "ae", "ö": "oe", "ü": "ue", "Ä": "ae", "Ö": "oe", "Ü": "ue", "ß": "ss"}
TRIM = " \t\n\r\x00\x0b"
# Markdown characters escaped anywhere, and at the start of a line; list markers.
INLINE_ESCAPES = r"[\\`*_\[\]<]"
LEADING_ESCAPES = r"^([ \t\n\r\x00\x0B]*)([#>|+\-=~])"
LIST_NUMBER = r"^([ \t\n\r\x00\x0B]*\d{1,9})([.)])(\s|$)"
LIST_MARKER = r"^([\p{L}\d]{1,6})([.)])"
# How designations begin, and what stands between two numbers of a range.
SECTION, ARTICLES, ANNEXES, RANGE_WORDS = "§", ("artikel", "art"), ("anlage", "anhang"), ("bis", "und", "-", ",")
# Fixed value: how a tag begins.
TAG = r"<\s*/?\s*([a-zA-Z][a-zA-Z0-9]*)"
# Trailers that go first, in this order.
FIRST_TRAILERS = ("Source", "Source-Url", "Amending-Act", "Amending-Act-Url", "Change-Id")
# The form of a placeholder, and the tags that stay.
PLACEHOLDER = r"\{\{\s*([a-z_]+)\s*:\s*([A-Za-z0-9_./\-]+)\s*\}\}"
ALLOWED_HTML = ["table", "thead", "tbody", "tfoot", "tr", "th", "td", "sup", "sub", "br"]
# Kinds of acts in a gazette citation, parts of the gazette, and units of amounts.
ACT_KINDS = ("Bek", "VO", "G", "V")
GAZETTE_PARTS = ("I", "II")
UNITS = ("€", "EUR", "Euro", "%", "Prozent")


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(TRIM))


def collapse(text: Column) -> Column:
    """Runs of white space, wide spaces included, become one space; ends are trimmed."""
    return trimmed(F.regexp_replace(F.translate(text, WIDE_SPACES, "   "), r"\s+", " "))


def slugify(text: Column) -> Column:
    for letter, written in TRANSLITERATION.items():
        text = F.replace(text, F.lit(letter), F.lit(written))
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def group(text: Column, pattern: str, index: int = 1) -> Column:
    """A group of the first match; null when nothing matches or the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, index), F.lit(""))


def _numbered(text: Column) -> Column:
    """Struct: the number with its letters that ``text`` begins with, or null; what is behind."""

    def read(t: Column) -> Column:
        number = group(t, r"^(\d+[a-z]*)")
        return F.struct(number.alias("number"), F.ltrim(F.substr(t, F.length(number) + 1)).alias("rest"))

    return let(F.ltrim(text), read)


def _behind(text: Column, words: tuple[str, ...], mark: str = "") -> Column:
    """What follows the first of ``words`` that ``text`` begins with, in any case, and a
    ``mark`` behind it; null where it begins with none."""
    cut = F.lit(None).cast("int")
    for w in reversed(words):
        for end in dict.fromkeys(("", mark)):
            cut = F.when(F.startswith(F.lower(text), F.lit(w + end)), len(w + end)).otherwise(cut)
    return F.substr(text, cut + 1)


def norm_key(designation: Column, document_id: Column) -> Column:
    """Stable key of a designation: section, range of sections, article, annex, slug.

    Read from the left: signs or a word that name the kind, then a number, then for two
    section signs a word of a range and a second number.
    """
    fallback = F.concat(F.lit("n-"), F.coalesce(F.nullif(F.lower(trimmed(document_id)), F.lit("")), F.lit("unknown")))

    def read(text: Column) -> Column:
        bare = F.ltrim(text, F.lit(SECTION))
        signs = F.length(text) - F.length(bare)
        plain = F.concat(F.lit("p"), _numbered(bare)["number"])
        joint = let(_numbered(bare), lambda n: F.concat(F.lit("p"), n["number"], F.lit("-"), _numbered(_behind(n["rest"], RANGE_WORDS))["number"]))
        article = F.concat(F.lit("art"), F.lower(_numbered(_behind(text, ARTICLES, "."))["number"]))
        annex = F.concat(F.lit("anl"), F.lower(F.regexp_extract(F.ltrim(_behind(text, ANNEXES, ".")), r"(?i)^([\dIVX]*[a-z]?)", 1)))
        return F.coalesce(F.when(signs == 2, joint), F.when(signs > 0, plain), article, annex, F.nullif(slugify(text), F.lit("")), fallback)

    return let(F.coalesce(collapse(designation), F.lit("")), read)


def escape_inline(text: Column) -> Column:
    """Characters that could become emphasis, code, links or tags."""
    return F.regexp_replace(text, f"({INLINE_ESCAPES})", r"\\$1")


def escape_line(line: Column) -> Column:
    """Inline characters, a leading block character, and a leading list number."""
    leading = F.regexp_replace(escape_inline(line), LEADING_ESCAPES, r"$1\\$2")
    return F.regexp_replace(leading, LIST_NUMBER, r"$1\\$2$3")


def escape_list_marker(marker: Column) -> Column:
    """A printed marker such as ``1.`` or ``aa)`` that no renderer counts anew."""
    return F.regexp_replace(escape_inline(trimmed(marker)), LIST_MARKER, r"$1\\$2")


def escape_table_cell(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def unescape_markdown(text: Column) -> Column:
    """The text without inline escapes, as HTML cells need it."""
    return F.regexp_replace(text, r"\\([\\`*_\[\]<])", "$1")


def escape_html(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]*>", "")


def footnote_label(source_id: Column) -> Column:
    return F.btrim(F.lower(F.regexp_replace(source_id, "[^A-Za-z0-9]+", "-")), F.lit("-"))


def absolute_url(source: Column, base: Column) -> Column:
    joined = F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), F.ltrim(source, F.lit("/")))
    return F.when(source.rlike("(?i)^https?://"), source).otherwise(joined)


def shorten(text: Column, limit: int = 120) -> Column:
    flat = collapse(text)
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 3), F.lit("…"))).otherwise(flat)


def tokens_of(text: Column, spaces: bool = False) -> Column:
    """Words (letters, digits, underscores) and single other characters, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+|\s|[^\w\s]" if spaces else r"(?U)\w+|[^\w\s]"), F.lit(0))


def first_place(items: Column, test: Callable[[Column], Column]) -> Column:
    """The first index for which ``test`` holds (null counts as no), or null."""
    return F.get(F.filter(F.sequence(F.lit(0), F.size(items) - 1), lambda i: F.coalesce(test(i), F.lit(False))), F.lit(0))


def preceded_by(items: Column, place: Column, *expected: str | tuple[str, ...]) -> Column:
    """The items right before ``place`` are the expected ones, each one or one of several."""
    found = F.lit(True)
    for k, item in enumerate(reversed(expected), 1):
        found = found & (place >= k) & F.get(items, place - k).isin(*([item] if isinstance(item, str) else item))
    return F.coalesce(found, F.lit(False))


def citation(note: Column) -> Column:
    """Struct of a citation's fields: article, paragraph, kind, day, month, year, part, and
    number or page; null without a citation.

    Read field by field: the first kind of act with "v." and a date behind it, then the part
    of the gazette, then its number or page; an article is looked for before the kind.
    """

    def read(tokens: Column) -> Column:
        token = lambda i: F.get(tokens, i)
        digits = lambda i, most=9: F.coalesce(token(i).rlike(r"^\d+$") & (F.length(token(i)) <= most), F.lit(False))
        date_at = lambda i: i + F.when(token(i) == "Bek", 4).otherwise(3)

        def cited(i: Column) -> Column:
            d = date_at(i)
            dated = preceded_by(tokens, d, "v", ".") & digits(d, 2) & (token(d + 1) == ".") & digits(d + 2, 2) & (token(d + 3) == ".") & (F.length(token(d + 4)) == 4) & digits(d + 4)
            place = digits(d + 6, 6) | ((token(d + 6) == "Nr") & (token(d + 7) == ".") & digits(d + 8))
            marked = (token(i) != "Bek") | (token(i + 1) == ".")
            return token(i).isin(*ACT_KINDS) & marked & dated & token(d + 5).isin(*GAZETTE_PARTS) & place

        def fields(k: Column) -> Column:
            d = date_at(k)
            by_paragraph = preceded_by(tokens, k - 1, "Abs", ".") & digits(k - 1)
            e = k - F.when(by_paragraph, 3).otherwise(0)
            whole = F.when(preceded_by(tokens, e - 1, "Art", ".") & token(e - 1).rlike(r"^\d+[a-z]?$"), token(e - 1))
            apart = F.when(preceded_by(tokens, e - 2, "Art", ".") & digits(e - 2) & token(e - 1).rlike("^[a-z]$"), F.concat(token(e - 2), token(e - 1)))
            article = F.coalesce(whole, apart)
            values = {
                "article": article, "paragraph": F.when(article.isNotNull() & by_paragraph, token(k - 1)), "kind": F.when(token(k) == "Bek", "Bek.").otherwise(token(k)),
                "day": token(d), "month": token(d + 2), "year": token(d + 4), "part": token(d + 5),
                "number": F.when(token(d + 6) == "Nr", token(d + 8)), "page": F.when(token(d + 6) != "Nr", token(d + 6)),
            }
            return F.when(k.isNotNull(), F.struct(*[v.alias(n) for n, v in values.items()]))

        return let(first_place(tokens, cited), fields)

    return F.when(F.contains(note, F.lit("v.")), let(tokens_of(note), read))


def change_id(cited: Column, jurisdiction: str = "bund") -> Column:
    identifier = F.coalesce(cited["number"].cast("int").cast("string"), F.concat(F.lit("s"), cited["page"].cast("int").cast("string")))
    return F.concat(cited["year"], F.lit(f"-{jurisdiction}-bgbl-"), F.lower(cited["part"]), F.lit("-"), identifier)


def citation_label(cited: Column) -> Column:
    by_number = F.concat(F.lit("BGBl. "), cited["year"], F.lit(" "), cited["part"], F.lit(" Nr. "), cited["number"].cast("int").cast("string"))
    by_page = F.concat(F.lit("BGBl. "), cited["part"], F.lit(" "), cited["year"], F.lit(", "), cited["page"].cast("int").cast("string"))
    return F.coalesce(by_number, by_page)


def eli_url(cited: Column) -> Column:
    series = F.when(cited["part"] == "I", "1").otherwise("2")
    return F.concat(F.lit("https://www.recht.bund.de/eli/bund/BGBl-"), series, F.lit("/"), cited["year"], F.lit("/"), cited["number"].cast("int").cast("string"), F.lit("/"))


def article_label(cited: Column) -> Column:
    article = F.concat(F.lit("Art. "), cited["article"])
    return F.concat(article, F.coalesce(F.concat(F.lit(" Abs. "), cited["paragraph"]), F.lit("")))


def placeholders(text: Column) -> Column:
    """Canonical ``{{type:reference}}`` in order, repeats kept."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(1)), F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(2)))
    return F.transform(found, lambda p: F.concat(F.lit("{{"), p["0"], F.lit(":"), p["1"], F.lit("}}")))


def replace_placeholders(text: Column, keys: Column, values: Column) -> Column:
    """Canonical placeholders replaced in turn; one without a value stays."""
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    return F.aggregate(pairs, text, lambda acc, p: F.replace(acc, p["k"], F.coalesce(p["v"], p["k"])))


# A run of digits, single separators between them, and the word or sign behind. The repetition is
# possessive: it then runs as a loop, however long the run is.
_NUMBER_RUN = r"(?U)(?<!\w)\d+(?:[.,\-\x{00A0}\x{202F} ] ?\d+)*+(?:\s*[€%]|\s*\p{L}+)?(?!\w)"


def _literals(run: Column) -> Column:
    """The values written out in one run, from the sizes of its digit groups."""

    def of_parts(p: Column) -> Column:
        sizes, marks, unit = p["sizes"], p["marks"], p["unit"]
        n, size = F.size(sizes), lambda k: F.get(sizes, F.lit(k))
        decimals = F.coalesce(F.try_element_at(marks, F.lit(-1)) == ",", F.lit(False))
        groups = n - decimals.cast("int")
        thousands = (groups >= 2) & (size(0) <= 3) & F.forall(F.slice(sizes, 2, F.greatest(groups - 1, F.lit(0))), lambda k: k == 3)
        thousands = thousands & F.forall(F.slice(marks, 1, F.greatest(groups - 1, F.lit(0))), lambda m: m.isin(".", " ", "\u00a0", "\u202f"))
        day = (n == 3) & (size(0) <= 2) & (size(1) <= 2) & (size(2) == 4) & F.forall(marks, lambda m: F.rtrim(m) == ".")
        iso = (n == 3) & (size(0) == 4) & (size(1) == 2) & (size(2) == 2) & F.forall(marks, lambda m: m == "-")
        amount = unit.isin(*UNITS)
        last = F.regexp_extract(p["digits"], r"(\d+(?:[.,]\d+)?)$", 1)
        return F.array_compact(
            F.array(F.when(thousands | day | iso, p["digits"]), F.when(amount, F.concat(F.when(thousands, p["digits"]).otherwise(last), p["gap"], unit)))
        )

    digits = F.regexp_extract(run, r"^(.*\d)", 1)
    tail = F.substr(run, F.length(digits) + 1)
    parts = F.struct(
        digits.alias("digits"), trimmed(tail).alias("unit"), F.regexp_extract(tail, r"^(\s*)", 1).alias("gap"),
        F.transform(F.regexp_extract_all(digits, F.lit(r"\d+"), F.lit(0)), F.length).alias("sizes"), F.regexp_extract_all(digits, F.lit(r"\D+"), F.lit(0)).alias("marks"),
    )
    return let(parts, of_parts)


def bare_values(text: Column) -> Column:
    """Grouped numbers, amounts with a unit, and full dates outside placeholders, in order."""
    plain = F.regexp_replace(text, PLACEHOLDER, "")
    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(plain, F.lit(_NUMBER_RUN), F.lit(0)), _literals)))


#: Groups of three digits behind one to three digits, between word boundaries.
GROUPED = r"(?U)\b\d{1,3}(?:[. ]\d{3})+\b"


def grouped_numbers_joined(text: Column) -> Column:
    """Lower case, collapsed, and grouped numbers without their separators: 48.300 -> 48300."""

    def joined(flat: Column) -> Column:
        numbers = F.regexp_extract_all(flat, F.lit(GROUPED), F.lit(0))
        between = F.split(flat, GROUPED, -1)
        return F.array_join(F.transform(between, lambda t, i: F.concat(t, F.coalesce(F.translate(F.get(numbers, i), ". ", ""), F.lit("")))), "")

    return let(collapse(F.lower(text)), joined)


def html_outside(text: Column, allowed: list[str] = ALLOWED_HTML) -> Column:
    """Distinct tag spellings that are not on the allow list, in order of appearance."""
    tags = F.array_distinct(F.regexp_extract_all(text, F.lit(TAG), F.lit(1)))
    return F.filter(tags, lambda t: ~F.lower(t).isin(allowed))


def encoding_issues(content: Column) -> Column:
    """Codes of a binary content; invalid bytes hide the other two."""
    text = F.try_validate_utf8(content.cast("string"))
    control = F.when(text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"), "control_characters")
    mark = F.when(F.contains(text, F.lit("\ufeff")), "byte_order_mark")
    return F.when(content.isNotNull() & text.isNull(), F.array(F.lit("invalid_encoding"))).otherwise(F.array_compact(F.array(control, mark)))


def subject_parts(subject: Column) -> Column:
    """type (16 characters) and id (96 characters) of ``type:id``."""
    kind = F.when(F.contains(subject, F.lit(":")), F.substring_index(subject, ":", 1))
    rest = F.when(F.contains(subject, F.lit(":")), F.substr(subject, F.length(kind) + 2)).otherwise(subject)
    return F.struct(F.left(kind, F.lit(16)).alias("type"), F.left(rest, F.lit(96)).alias("id"))


def model_reference(value: Column) -> Column:
    """provider and model around the first colon; null unless both are there."""
    provider, model = F.substring_index(value, ":", 1), F.substr(value, F.locate(":", value) + 1)
    good = (F.locate(":", value) > 1) & (model != "")
    return F.when(good, F.struct(provider.alias("provider"), model.alias("model")))


def with_trailers(message: Column, trailers: Column) -> Column:
    """The message with its trailer block behind a blank line: known keys first, in their
    order, then the others as given; repeated lines once. Without trailers only its end
    is trimmed."""
    known = F.array(*map(F.lit, FIRST_TRAILERS))

    def written(lines: Column) -> Column:
        key = lambda x: F.substring_index(x, ": ", 1)
        first = F.flatten(F.transform(known, lambda k: F.filter(lines, lambda x: key(x) == k)))
        return F.concat(first, F.filter(lines, lambda x: ~key(x).isin(*FIRST_TRAILERS)))

    block = F.array_join(let(F.array_distinct(trailers), written), "\n")
    return F.concat(F.rtrim(message, F.lit(TRIM)), F.when(F.size(trailers) > 0, F.concat(F.lit("\n\n"), block)).otherwise(""), F.lit("\n"))


def trailers_of(message: Column) -> Column:
    """Map of ``Key: value`` lines; of repeated keys the last wins."""
    lines = F.filter(F.split(message, "\n"), lambda x: x.rlike(r"^[A-Za-z][A-Za-z0-9-]*: \S"))
    keys = F.transform(lines, lambda x: F.substring_index(x, ": ", 1))
    last = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: ~F.exists(F.slice(keys, p["i"] + 2, F.size(keys)), lambda k: k == F.substring_index(p["x"], ": ", 1)))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(F.substring_index(p["x"], ": ", 1), F.regexp_replace(p["x"], r"^[^:]*:\s*", ""))))
