"""Dates in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names as written in dates, and the longest text taken for a date.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MAX_DATE_TEXT = 60

_MONTH = r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b\.?"
_DAY = r"(?<!\d)(\d{1,2})(?:st|nd|rd|th)?(?!\d)"
_YEAR = r"(?:'(\d{2})(?!\d)|(?<!\d)(\d{4})(?!\d))"
# Pattern and the groups of day, month, short year, long year (0 = none).
_NAMED = [
    (rf"(?i){_DAY}[\s,.]+{_MONTH}[\s,.]+{_YEAR}", 1, 2, 3, 4),
    (rf"(?i){_MONTH}\s+{_DAY},?\s+{_YEAR}", 2, 1, 3, 4),
    (rf"(?i)(?<!\d)(\d{{4}})\s+{_MONTH}\s+{_DAY}", 3, 2, 0, 1),
]
_YEARLESS = [(rf"(?i){_MONTH}\s+{_DAY}", 2, 1), (rf"(?i){_DAY}\s+{_MONTH}", 1, 2)]


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def _named_date(text: Column, pattern: str, day: int, month: int, short: int, long: int) -> Column:
    year = F.regexp_extract(text, pattern, long)
    if short:
        two = F.regexp_extract(text, pattern, short)
        year = F.when(two == "", year).when(two < "69", F.concat(F.lit("20"), two)).otherwise(F.concat(F.lit("19"), two))
    return F.when(text.rlike(pattern), _date(year, month_number(F.regexp_extract(text, pattern, month)), F.regexp_extract(text, pattern, day)))


def month_number(name: Column) -> Column:
    names = F.array(*[F.lit(m) for m in MONTHS])
    return F.array_position(names, F.lower(F.left(name, F.lit(3)))).cast("string")


def text_date(text: Column, guess_year: Column | None = None) -> Column:
    """Date that a short text states in full; ``guess_year`` fills in a year where only day and month are given.

    A date in digits with dashes goes first. Texts with digits around a slash are ambiguous and give none.
    """
    trimmed = F.regexp_replace(text, r"^[\x00\s]+|[\x00\s]+$", "")
    iso = r"(?:[^\d]|^)(\d{4})-(\d{2})-(\d{2})(?:[^\d]|$)"
    reversed_iso = r"(?<![\d-])(\d{1,2})-(\d{1,2})-(\d{4})(?![\d-])"

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(trimmed, pattern, group)

    found = [F.when(trimmed.rlike(iso), _date(part(iso, 1), part(iso, 2), part(iso, 3)))]
    found += [_named_date(trimmed, *rule) for rule in _NAMED]
    found.append(F.when(trimmed.rlike(reversed_iso), _date(part(reversed_iso, 3), part(reversed_iso, 2), part(reversed_iso, 1))))
    if guess_year is not None:
        found += [F.when(trimmed.rlike(p), _date(guess_year.cast("string"), month_number(part(p, m)), part(p, d)))
                  for p, d, m in _YEARLESS]
    usable = (F.length(trimmed) <= MAX_DATE_TEXT) & ~trimmed.rlike(r"\d/\d") & trimmed.rlike(r"\d")
    return F.when(usable, F.coalesce(*found))
