"""Text expressions: slugs, escaping, title normalisation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A slug keeps at most this many words and characters.
SLUG_WORDS = 10
SLUG_LENGTH = 100


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` computed once, however often ``fn`` names it."""
    return F.get(F.transform(F.array(value), lambda v: fn(v)), F.lit(0))


def slug(title: Column) -> Column:
    """Lower-case words joined by ``-``: the longest run of the first ten that fits into 100 characters."""
    words = F.slice(F.regexp_extract_all(F.lower(title), F.lit(r"\w+"), 0), 1, SLUG_WORDS)
    start = F.struct(F.lit("").alias("text"), F.lit(True).alias("open"))

    def step(acc: Column, word: Column) -> Column:
        longer = F.when(acc["text"] == "", word).otherwise(F.concat(acc["text"], F.lit("-"), word))
        fits = acc["open"] & ((acc["text"] == "") | (F.length(longer) <= SLUG_LENGTH))
        return F.struct(F.when(fits, longer).otherwise(acc["text"]).alias("text"), fits.alias("open"))

    return F.left(F.aggregate(words, start, step)["text"], F.lit(SLUG_LENGTH))


def xml_escaped(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


# Typographic characters that count as their plain form in title comparison.
PLAIN_FORMS = {"\u2019": "'", "\u2018": "'", "\u201d": '"', "\u201c": '"', "\u2026": "...", "\u200a": " "}


def normalized_title(title: Column) -> Column:
    """Trimmed title with no-break blanks and line breaks as blanks, runs of blanks as one; null when empty."""
    stripped = F.regexp_replace(title, r"^[\x00\t\n\x0b\f\r ]+|[\x00\t\n\x0b\f\r ]+$", "")
    spaced = F.regexp_replace(F.replace(stripped, F.lit("\u00a0"), F.lit(" ")), r"\r\n|\r|\n", " ")
    return F.nullif(F.regexp_replace(spaced, " +", " "), F.lit(""))


def equalized_title(title: Column) -> Column:
    for fancy, plain in PLAIN_FORMS.items():
        title = F.replace(title, F.lit(fancy), F.lit(plain))
    return F.lower(title)


def _ellipsis_stem(title: Column) -> Column:
    return F.regexp_extract(title, r"^(.+)(?:\.\.\.|\u2026)$", 1)


def titles_roughly_equal(left: Column, right: Column) -> Column:
    """Equal after equalising, or one is cut by an ellipsis and starts the other."""
    a, b = _ellipsis_stem(left), _ellipsis_stem(right)
    cut = (
        F.when((a != "") & (b != ""), a.startswith(b) | b.startswith(a))
        .when(a != "", right.startswith(a)).when(b != "", left.startswith(b)).otherwise(F.lit(False))
    )
    known = left.isNotNull() & right.isNotNull()
    return F.when(known, (equalized_title(left) == equalized_title(right)) | cut).otherwise(F.lit(False))
