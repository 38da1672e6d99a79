"""Parsing of the raw texts found on pages; dirty input gives NULL, never an error."""

from __future__ import annotations

import unicodedata
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from boutlab.schema import WEIGHT_CLASSES

DATE_PATTERNS = {
    "card": "MMMM d, yyyy",
    "birth": "MMM d, yyyy",
    "quote": "MM.dd.yyyy",
}

# Letters that Unicode does not decompose.
PLAIN_LETTERS = {
    "Ø": "O", "ø": "o", "Đ": "D", "đ": "d", "Ħ": "H", "ħ": "h", "ı": "i",
    "Ł": "L", "ł": "l", "Ŧ": "T", "ŧ": "t",
}
LETTER_PAIRS = {"ß": "ss", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Þ": "Th", "þ": "th"}


def _accent_map() -> dict[str, str]:
    letters = dict(PLAIN_LETTERS)
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(code))[0]
        if base.isascii() and base.isalpha():
            letters[chr(code)] = base
    return letters


ACCENTS = _accent_map()


def _text(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _int(c: Column) -> Column:
    return F.trim(c).try_cast("int")


def landed(c: Column | str) -> Column:
    """The 109 of ``109 of 156`` and of ``109 of 156 - 69%``."""
    return _int(F.get(F.split(_text(c), " of "), F.lit(0)))


def attempted(c: Column | str) -> Column:
    """The 156 of ``109 of 156`` and of ``109 of 156 - 69%``."""
    return _int(F.get(F.split(F.get(F.split(_text(c), " of "), F.lit(1)), " - "), F.lit(0)))


def clock_seconds(c: Column | str) -> Column:
    """Seconds of ``m:ss``."""
    parts = F.split(_text(c), ":")
    return _int(F.get(parts, F.lit(0))) * 60 + _int(F.get(parts, F.lit(1)))


def height_inches(c: Column | str) -> Column:
    """Inches of ``6' 4"``, also with the inch mark as an HTML entity."""
    c, pattern = _text(c), r"(\d+)'\s*(\d+)"
    return _int(F.regexp_extract(c, pattern, 1)) * 12 + _int(F.regexp_extract(c, pattern, 2))


def leading_number(c: Column | str) -> Column:
    """The number of ``205 lbs.`` or ``76"``."""
    return _int(F.regexp_extract(_text(c), r"(\d+)", 1))


def only_with_mark(c: Column | str, *marks: str) -> Column:
    """NULL unless the text carries one of its unit marks."""
    c = _text(c)
    found = F.lit(False)
    for mark in marks:
        found = found | c.contains(mark)
    return F.when(found, c)


INCH_MARKS = ('"', "&quot;")
POUND_MARKS = ("lbs",)


def text_or_null(c: Column | str) -> Column:
    """Empty and markup-only text is no value."""
    c = F.trim(_text(c))
    return F.when((c != "") & ~c.startswith("</"), c)


def to_day(c: Column | str, kind: str) -> Column:
    return F.try_to_timestamp(F.trim(_text(c)), F.lit(DATE_PATTERNS[kind])).cast("date")


def pounds(c: Column | str) -> Column:
    """Pounds of a weight class; NULL for an unknown class."""
    classes = F.create_map(*[F.lit(v) for v in chain.from_iterable(WEIGHT_CLASSES.items())])
    return F.try_element_at(classes, _text(c))


def gender(c: Column | str) -> Column:
    return F.when(_text(c).contains("Women"), "female").otherwise("male")


def class_name(c: Column | str) -> Column:
    """``Women's Flyweight`` -> ``flyweight``, ``Light Heavyweight`` -> ``light heavyweight``."""
    c = _text(c)
    return F.lower(F.when(c.contains("Women"), F.get(F.split(c, " "), F.lit(1))).otherwise(c))


def american_odds(c: Column | str) -> Column:
    """Signed odds of ``+150`` or ``-175 (moved)``."""
    return _int(F.get(F.split(_text(c), " "), F.lit(0)))


def plain_letters(c: Column | str) -> Column:
    """Letters without accents, hyphens as blanks."""
    c = _text(c)
    for letter, pair in LETTER_PAIRS.items():
        c = F.replace(c, F.lit(letter), F.lit(pair))
    return F.translate(c, "".join(ACCENTS) + "-", "".join(ACCENTS.values()) + " ")


def last_name(c: Column | str) -> Column:
    return F.element_at(F.split(_text(c), " "), -1)


def label_of(winner: Column | str, r_name: Column | str, b_name: Column | str) -> Column:
    """Red, Blue or DRAW; NULL when the winner is neither corner."""
    winner = _text(winner)
    return (
        F.when(winner == "", "DRAW").when(winner == _text(r_name), "Red").when(winner == _text(b_name), "Blue")
    )


def label_number(label: Column | str) -> Column:
    label = _text(label)
    return F.when(label == "Red", 0).when(label == "Blue", 1).when(label == "DRAW", 2)
