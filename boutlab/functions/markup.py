"""Elements, attributes and texts of stored HTML pages as column expressions.

An element ends at the first closing tag of its kind, so ask for the innermost one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def element_pattern(tag: str, css_class: str | None = None, partial: bool = False) -> str:
    if css_class is None:
        opening = rf"<{tag}(?:\s[^>]*)?>"
    else:
        value = re.escape(css_class)
        value = rf'[^"]*{value}[^"]*' if partial else value
        opening = rf'<{tag}\s(?:[^>]*\s)?class="{value}"[^>]*>'
    return rf"(?s){opening}(.*?)</{tag}>"


def class_pattern(tag: str, css_class: str) -> str:
    """An element of a kind that has a class among its classes, in either kind of quotes and case."""
    value = rf"(?<![\w-]){re.escape(css_class)}(?![\w-])"
    opening = rf"<{tag}\s(?:[^>]*?\s)?class\s*=\s*(?:\x22[^\x22>]*{value}[^\x22>]*\x22|'[^'>]*{value}[^'>]*')[^>]*>"
    return rf"(?is){opening}(.*?)</{tag}\s*>"


def classed(html: Column, tag: str, css_class: str) -> Column:
    """All elements that have a class among others, with their tags, in page order."""
    return F.regexp_extract_all(html, F.lit(class_pattern(tag, css_class)), F.lit(0))


def first_classed(html: Column, tag: str, css_class: str) -> Column:
    return F.regexp_substr(html, F.lit(class_pattern(tag, css_class)))


def visible(html: Column) -> Column:
    """A page without comments, scripts and styles, whose texts look like markup at times."""
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", "")


def decoded(text: Column) -> Column:
    """Text with the common entities as characters; the ampersand last, so that none is decoded twice."""
    for entity, character in (
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"),
    ):
        text = F.replace(text, F.lit(entity), F.lit(character))
    return F.trim(text)


def elements(html: Column, tag: str, css_class: str | None = None, partial: bool = False) -> Column:
    """All matching elements with their tags, in page order."""
    return F.regexp_extract_all(html, F.lit(element_pattern(tag, css_class, partial)), F.lit(0))


def first_element(html: Column, tag: str, css_class: str | None = None, partial: bool = False) -> Column:
    return F.regexp_substr(html, F.lit(element_pattern(tag, css_class, partial)))


def inner_text(element: Column) -> Column:
    return F.trim(F.regexp_replace(element, r"<[^>]*>", ""))


def attribute(element: Column, name: str) -> Column:
    return F.regexp_extract(element, rf'\s{name}="([^"]*)"', 1)


def attributes(html: Column, tag: str, name: str) -> Column:
    """One attribute of every element of a kind, in page order."""
    pattern = rf'<{tag}\s(?:[^>]*\s)?{name}="([^"]*)"'
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(1))


def text_after(html: Column, label: str, tag: str = "i") -> Column:
    """The text that follows ``label</tag>``, bare or in a span; NULL when the label is absent."""
    pattern = rf"{re.escape(label)}\s*</{tag}>\s*(?:<span[^>]*>)?([^<]*)"
    found = F.regexp_substr(html, F.lit(pattern))
    return F.trim(F.regexp_extract(found, pattern, 1))
