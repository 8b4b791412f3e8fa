"""Text functions from columns to columns. White space is Unicode's; digits in patterns are ASCII's unless said."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import FURNITURE

# Lines of a table of contents, with the number behind or before: fixed values.
TOC_FORWARD = r"^(.{2,60}?)\s{1,}([0-9]{1,4})\s*$"
TOC_REVERSED = r"^([0-9]{1,4})\s+(.{2,60}?)\s*$"


def either(patterns: Sequence[str]) -> str:
    """One regex for several; it matches nothing if there are none."""
    return "|".join(f"(?:{p})" for p in patterns) or r"(?!)"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


#: What ends a line of a text.
LINE_BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def lines(c: Column) -> Column:
    """Stripped lines of a text that are not blank."""
    return F.filter(F.transform(F.split(c, LINE_BREAKS), strip), lambda x: x != "")


def collapse_spaced_number(c: Column) -> Column:
    """Blanks inside a number go: between a digit and a digit, point or percent sign, and between a point and a digit."""
    c = F.regexp_replace(c, r"(?U)(?<=[0-9])\s+(?=[0-9.%])", "")
    return F.regexp_replace(c, r"(?U)(?<=\.)\s+(?=[0-9])", "")


def expand_compact_date(c: Column) -> Column:
    """20251231 becomes 2025年12月31日, without leading zeros."""
    return F.regexp_replace(c, r"(?<![0-9])(20[0-9]{2})(?:0([1-9])|(1[0-2]))(?:0([1-9])|([12][0-9]|3[01]))(?![0-9])", "$1年$2$3月$4$5日")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def is_value_like(c: Column) -> Column:
    """A dash, or a number with commas, brackets, point or percent sign."""
    return F.replace(strip(c), F.lit(","), F.lit("")).rlike(r"^(?:[-—]|\(?-?[0-9]+(?:\.[0-9]+)?%?\)?)\z")


def is_furniture(c: Column, noise: Column | None = None) -> Column:
    """Blank, a generic header or footer, or one of the report's own noise lines."""
    s = strip(c)
    known = (s == "") | s.rlike(rf"^(?:{either(FURNITURE)})\z")
    return known if noise is None else known | F.coalesce(F.array_contains(noise, s), F.lit(False))


def is_short_garble(c: Column) -> Column:
    s = strip(c)
    return (s != "") & ~s.startswith("|") & (F.length(s) <= 14) & ~s.rlike(r"[，。；：？！,.%()（）]") & ~s.rlike("[A-Za-z]{3,}")


def clean_item_name(c: Column) -> Column:
    c = F.regexp_replace(strip(c), r"^\*+|\*+\z", "")
    c = F.regexp_replace(c, r"(?U)^(?:其中|加|减)\s*[:：]\s*", "")
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def item_search_terms(c: Column) -> Column:
    """The item's name, and the name without short bracketed parts if that differs."""
    base = clean_item_name(c)
    short = strip(F.regexp_replace(base, r"[（(][^()（）]{0,40}[)）]", ""))
    ends = lambda x: F.regexp_replace(x, r"^[：: ]+|[：: ]+\z", "")
    return F.filter(F.array_distinct(F.array(ends(base), ends(F.when(short == "", base).otherwise(short)))), lambda x: x != "")


def parse_note_reference(c: Column) -> Column:
    """struct(note_key, note_no, note_subref) of a reference such as 31(5), or null. What follows / is dropped."""
    own = strip(F.element_at(F.split(strip(c), "/"), 1))
    pattern = r"(?U)^([0-9]{1,2})(?:\s*[（(]([0-9]{1,2})[）)])?"
    no, sub = F.regexp_extract(own, pattern, 1), F.nullif(F.regexp_extract(own, pattern, 2), F.lit(""))
    key = F.concat(no.cast("int").cast("string"), F.coalesce(F.concat(F.lit("("), sub, F.lit(")")), F.lit("")))
    return F.when(no != "", F.struct(key.alias("note_key"), no.cast("int").alias("note_no"), sub.alias("note_subref")))


def note_heading(c: Column) -> Column:
    """struct(note_no, title) of the first heading such as '12、title' in the first 8 lines, or null.

    Blank lines, table rows, bold lines and headings without a title are passed over; a closing (续) is not part of the title.
    """
    pattern = r"(?U)^([0-9]{1,2})(?:[.、]|\s+)([^\n]{1,80})$"
    rows = F.filter(F.transform(F.slice(F.split(c, LINE_BREAKS), 1, 8), strip), lambda x: (x != "") & ~x.startswith("|") & ~x.startswith("**") & x.rlike(pattern))
    title = lambda x: strip(F.regexp_replace(F.regexp_extract(x, pattern, 2), r"(?U)\s*[（(]续[）)]\s*\z", ""))
    named = F.filter(F.transform(rows, lambda x: F.struct(F.regexp_extract(x, pattern, 1).cast("int").alias("note_no"), title(x).alias("title"))), lambda h: h.title != "")
    return F.get(named, F.lit(0))


def matches_near_top(c: Column, patterns: Sequence[str], reach: int = 220) -> Column:
    return F.substring(c, 1, reach).rlike(f"(?i){either(patterns)}")


def heading_line(c: Column) -> Column:
    """The first line of a page, or null if the page is a table of contents, main or small."""
    heads = F.transform(F.slice(F.split(c, "\n", 7), 1, 6), strip)
    toc_like = lambda x: F.filter(x, lambda y: y.rlike(f"(?U){TOC_FORWARD}") | y.rlike(f"(?U){TOC_REVERSED}"))
    first = F.transform(F.array(heads), lambda x: F.when(F.size(toc_like(x)) < 2, F.element_at(x, 1)))[0]
    return F.when(~F.substring(c, 1, 30).rlike(r"(?U)目\s*录"), first)


def matches_as_heading(c: Column, patterns: Sequence[str]) -> Column:
    """A pattern in the first line of a page that is no table of contents, main or small."""
    return F.coalesce(heading_line(c).rlike(f"(?i){either(patterns)}"), F.lit(False))


def excerpt(c: Column, keywords: Column, before: int = 120, after: int = 500) -> Column:
    """The text around the first of the keywords, in their order, that it holds; else its head."""
    at = F.get(F.filter(F.transform(keywords, lambda k: F.instr(c, k)), lambda i: i > 0), F.lit(0))
    start = F.greatest(F.lit(1), at - before)
    return strip(F.when(at.isNotNull(), F.substring(c, start, at + after - start)).otherwise(F.substring(c, 1, after)))
