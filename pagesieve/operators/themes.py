"""Score pages against keyword themes, keep the best with their context."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import bound, clean_note_text, may_appear
from ..functions.text import excerpt
from .pages import ordered

MIN_SCORE, MAX_HITS, CONTEXT, TABLE_BONUS = 10, 30, 1, 15


def keyword_weight(k: Column) -> Column:
    return F.greatest(F.lit(10), F.least(3 * F.length(k), F.lit(30)))


def any_of(words: Sequence[str]) -> str:
    """A pattern for the longest of the words at a place, as a tree of their letters, so that a place is read once for all words."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        ends, more = "" in at, {c: below for c, below in at.items() if c}
        if not more:
            return ""
        branches = [f"{re.sub(r'(\W)', r'\\\1', c)}{pattern(below)}" for c, below in more.items()]
        return f"(?:{'|'.join(branches)}){'?' if ends else ''}" if len(branches) > 1 or ends else branches[0]

    return pattern(tree)


def found_words(text: Column, words: Sequence[str]) -> Column:
    """The distinct words that a text holds, overlapping ones too. Every place where a word starts gives the longest one there; those inside it are known."""
    words = sorted({w for w in words if w})
    inside = {w: [v for v in words if v != w and v in w] for w in words}
    longest = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({any_of(words)}))"), F.lit(1)))
    if not any(inside.values()):
        return longest
    more = F.create_map(*[x for w, v in inside.items() if v for x in (F.lit(w), F.array(*map(F.lit, v)))])
    return F.array_distinct(F.concat(longest, F.flatten(F.array_compact(F.transform(longest, lambda w: F.try_element_at(more, w))))))


def hits_of_themes(pages: DataFrame, themes: Mapping[str, Sequence[str]], min_score: int = MIN_SCORE, clean=clean_note_text) -> DataFrame:
    """(report_id, page_idx, theme, score, matched_keywords, excerpt): pages with at least one of a theme's keywords and the least score.

    A page is cleaned once and read once for the keywords of all themes together; pages that cannot hold any are left out before.
    Each keyword that occurs counts once, by its length; a literal <table> in the raw text adds a bonus. clean is
    applied to the text before keywords are looked for. Keywords stand in their theme's order. Nothing is shuffled.
    """
    named = {n: [k for k in dict.fromkeys(words) if k] for n, words in themes.items()}
    words = list(dict.fromkeys(k for own in named.values() for k in own))
    text = F.col("text")
    if not words:
        return pages.where(F.lit(False)).select("report_id", "page_idx", F.lit("").alias("theme"), F.lit(0).alias("score"), F.array().cast("array<string>").alias("matched_keywords"), F.lit("").alias("excerpt"))
    possible = pages
    if clean is clean_note_text:
        possible = pages.where(reduce(Column.__or__, [may_appear(text, k) for k in words]))
    bonus = F.when(text.contains("<table>"), TABLE_BONUS).otherwise(0)
    known = F.array(*[F.struct(F.lit(n).alias("theme"), F.array(*map(F.lit, own)).cast("array<string>").alias("keywords")) for n, own in named.items()])

    def hits(page: Column) -> Column:
        own = lambda t: F.array_intersect(t["keywords"], page["words"])
        matched = F.filter(F.transform(known, lambda t: F.struct(t["theme"].alias("theme"), own(t).alias("matched"))), lambda h: F.size(h["matched"]) > 0)
        scored = F.transform(matched, lambda h: F.struct(h["theme"].alias("theme"), F.aggregate(h["matched"], bonus, lambda s, k: s + keyword_weight(k)).alias("score"), h["matched"].alias("matched_keywords")))
        kept = F.filter(scored, lambda h: h["score"] >= min_score)
        return F.transform(kept, lambda h: F.struct(h["theme"].alias("theme"), h["score"].alias("score"), h["matched_keywords"].alias("matched_keywords"), excerpt(page["clean"], h["matched_keywords"]).alias("excerpt")))

    page = bound(clean(text), lambda c: F.struct(c.alias("clean"), found_words(c, words).alias("words")))
    # a generator takes the array as it is made; a filter on a column of it would be pushed below and clean again
    return possible.select("report_id", "page_idx", F.inline(bound(page, hits)))


def theme_hits(pages: DataFrame, keywords: Sequence[str], min_score: int = MIN_SCORE, clean=clean_note_text) -> DataFrame:
    """(report_id, page_idx, score, matched_keywords, excerpt) of one theme; see hits_of_themes()."""
    return hits_of_themes(pages, {"": keywords}, min_score, clean).drop("theme")


def consecutive_windows(hits: DataFrame) -> DataFrame:
    """(report_id, start_page_idx, end_page_idx, page_indices) of runs of neighbouring pages."""
    own = hits.select("report_id", "page_idx").distinct()
    run = F.col("page_idx") - F.row_number().over(Window.partitionBy("report_id").orderBy("page_idx"))
    grouped = own.withColumn("run", run).groupBy("report_id", "run").agg(F.min("page_idx").alias("start_page_idx"), F.max("page_idx").alias("end_page_idx"), F.array_sort(F.collect_list("page_idx")).alias("page_indices"))
    return grouped.drop("run")


def top_hits(hits: DataFrame, most: int = MAX_HITS, by: Sequence[str] = ("report_id",)) -> DataFrame:
    """The report's best hits: by score, then page. by: with theme, those of each theme."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "page_idx")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def context_pages(hits: DataFrame, context: int = CONTEXT) -> DataFrame:
    """(report_id, page_idx, hit): the hits and as many pages on either side, once each."""
    near = hits.select("report_id", "page_idx", F.explode(F.sequence(F.lit(-context), F.lit(context))).alias("by"))
    return near.groupBy("report_id", (F.col("page_idx") + F.col("by")).alias("page_idx")).agg(F.max(F.col("by") == 0).alias("hit"))


def assemble_slim(pages: DataFrame) -> DataFrame:
    """(report_id, markdown, pages): non-empty pages under their markers, in order. pages has text and hit."""
    marker = F.concat(F.lit("<!-- page: "), F.col("page_idx").cast("string"), F.when(F.col("hit"), F.lit(" [hit]")).otherwise(F.lit("")), F.lit(" -->\n"))
    parts = pages.where("text <> ''").select("report_id", "page_idx", F.concat(marker, "text").alias("part"))
    return parts.groupBy("report_id").agg(F.array_join(ordered("part", "page_idx"), "\n\n---\n\n").alias("markdown"), F.count("*").alias("pages"))
