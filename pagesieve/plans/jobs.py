"""End-to-end jobs over many reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SECTIONS, Section, Theme, theme
from ..operators import marks as M
from ..operators import notes as N
from ..operators import pages as P
from ..operators import sections as S
from ..operators import tables as B
from ..operators import themes as T
from ..operators import toc as C


def build_pages(items: DataFrame) -> DataFrame:
    """Items to tagged pages."""
    return P.items_to_pages(items).withColumn("matched_tags", P.page_tags())


def toc_scan(pages: DataFrame) -> DataFrame:
    """Ranged entries of all reports; reports without entries are absent (see missing_toc)."""
    return C.toc_ranges(pages).drop("last_page_idx")


def missing_toc(pages: DataFrame) -> DataFrame:
    """(report_id, stage, message) of the reports that have no entries, so that one report does not end a job."""
    reports = M.with_contents(M.report_marks(M.page_marks(pages, {}))).where("size(toc) = 0")
    return reports.select("report_id", F.lit("toc_scan").alias("stage"), F.lit("no table of contents").alias("message"))


def extract_theme(pages: DataFrame, keywords: Sequence[str], min_score: int = T.MIN_SCORE, most: int = T.MAX_HITS, windows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(best hits, windows of all hits). windows: (report_id, start_page_idx, end_page_idx), the only pages that count, as note_windows() gives them."""
    if windows is not None:
        pages = P.page_range(pages, windows)
    hits = T.theme_hits(pages, keywords, min_score)
    return T.top_hits(hits, most), T.consecutive_windows(hits)


def theme_results(pages: DataFrame, name: str, themes: dict[str, Theme], scope: str = "all", default: str = "balance-sheet", min_score: int = T.MIN_SCORE, most: int = T.MAX_HITS) -> DataFrame:
    """One row for each report: theme, scope, note_window, hit_windows and hits, as write_json() stores them.

    scope: all pages, or notes: those of the notes by the theme's own start and stop patterns, else by the default theme's; reports
    without notes then have no row (see missing_windows).
    """
    own = theme(name, themes)
    window = own if own.note_start else themes.get(default, own)
    spans = S.note_windows(pages, window.note_start, window.note_stop) if scope == "notes" else None
    best, runs = extract_theme(pages, own.keywords, min_score, most, spans)
    hit, run = F.struct("place", "page_idx", "score", "matched_keywords", "excerpt"), F.struct("start_page_idx", "end_page_idx", "page_indices")
    out = spans if spans is not None else pages.select("report_id").distinct().withColumns({c: F.lit(None).cast("int") for c in ("start_page_idx", "end_page_idx")})
    out = out.join(best.groupBy("report_id").agg(F.array_sort(F.collect_list(hit)).alias("hits")), "report_id", "left").join(runs.groupBy("report_id").agg(F.array_sort(F.collect_list(run)).alias("hit_windows")), "report_id", "left")
    return out.select("report_id", F.lit(name).alias("theme"), F.lit(scope).alias("scope"), F.struct("start_page_idx", "end_page_idx").alias("note_window"), "hit_windows", "hits")


def missing_windows(pages: DataFrame, windows: DataFrame) -> DataFrame:
    """(report_id, stage, message) of the reports whose notes are not found."""
    return pages.select("report_id").distinct().join(windows, "report_id", "left_anti").select("report_id", F.lit("note_window").alias("stage"), F.lit("no notes found").alias("message"))


def cleaned(chosen: DataFrame, pages: DataFrame) -> DataFrame:
    """Chosen pages with their text cleaned; pages are where the reports' own noise lines are looked for."""
    return B.clean_pages(chosen.join(P.report_noise(pages), "report_id", "left")).drop("noise")


def slim_theme(pages: DataFrame, hits: DataFrame, context: int = T.CONTEXT) -> DataFrame:
    """(report_id, markdown, pages) of the hits and the pages around them; the text is cleaned after pages are chosen."""
    chosen = pages.select("report_id", "page_idx", "text").join(T.context_pages(hits, context), ["report_id", "page_idx"])
    return T.assemble_slim(cleaned(chosen, pages))


_SPAN = ("start_page_idx", "end_page_idx", "fallback_used", "matched_titles")


def section_pages(pages: DataFrame, numbers: DataFrame) -> DataFrame:
    """numbers (report_id, page_idx, noise and more, as section_page_numbers() gives them) with the cleaned text in place of noise."""
    return B.clean_pages(pages.select("report_id", "page_idx", "text").join(numbers, ["report_id", "page_idx"])).drop("noise")


def documents(chosen: DataFrame, *more: str) -> DataFrame:
    """(report_id, section, markdown, pages, chars, est_tokens, more) of cleaned pages (report_id, section, page_idx, text); empty pages are left out.

    more: further columns, which are equal for all pages of a section."""
    part = F.concat(F.lit("<!-- page: "), F.col("page_idx").cast("string"), F.lit(" -->\n"), "text")
    out = chosen.where("text <> ''").select("report_id", "section", *more, "page_idx", part.alias("part")).groupBy("report_id", "section", *more).agg(F.array_join(P.ordered("part", "page_idx"), "\n\n---\n\n").alias("markdown"), F.count("*").alias("pages"))
    chars = F.length("markdown").cast("long")
    return out.withColumn("chars", chars).withColumn("est_tokens", F.floor(chars / 1.5).cast("long"))


def section_slim(pages: DataFrame, sections: dict[str, Section] = SECTIONS, most: int | None = None) -> DataFrame:
    """(report_id, section, markdown, pages, chars, est_tokens, start_page_idx, end_page_idx, fallback_used, matched_titles).

    Pages are read twice, for their marks and for their texts, and moved three times in all: marks, texts, documents."""
    return documents(section_pages(pages, S.section_page_numbers(pages, sections, most)), *_SPAN)


def section_documents(pages: DataFrame) -> DataFrame:
    """(report_id, section, markdown, pages) of all sections."""
    return section_slim(pages).select("report_id", "section", "markdown", "pages")


_STATEMENTS = {"balance-sheet": "balance_sheet", "income-statement": "income_statement"}


def statements_of(slim: DataFrame) -> DataFrame:
    """(report_id, statement, markdown) out of section documents."""
    named = F.element_at(F.create_map(*[F.lit(x) for t in _STATEMENTS.items() for x in t]), F.col("section"))
    return slim.where(F.col("section").isin(*_STATEMENTS)).select("report_id", named.alias("statement"), "markdown")


def notes_slim(pages: DataFrame, statements: DataFrame, most: int | None = None) -> DataFrame:
    """(report_id, section, markdown, pages, chars, est_tokens): the pages of the notes section that the statements refer to.

    statements: report_id, statement, markdown; the balance sheet is read before the income statement.
    """
    name = "financial-notes"
    numbers = S.section_page_numbers(pages, {name: SECTIONS[name]}, most).select("report_id", "page_idx", "noise", "section")
    own = pages.select("report_id", "page_idx", "text").join(numbers, ["report_id", "page_idx"])
    first = F.col("statement") == "balance_sheet"
    # a balance sheet is also known by its name in the first 200 characters
    is_bs = first | F.substring("markdown", 1, 200).contains("资产负债表")
    refs = N.note_ref_set(statements.select("report_id", F.when(first, 0).otherwise(1).alias("seq"), "markdown", is_bs.alias("is_bs")))
    kept = own.join(N.referenced_pages(own, refs), ["report_id", "page_idx"], "left_semi")
    return documents(B.clean_pages(kept).drop("noise"))


def statement_notes(statements: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, stats): each statement with its notes (report_id, statement, markdown), and counts for each report.

    statements: report_id, statement, markdown; notes: report_id, markdown.
    """
    refs = N.statement_note_refs(statements)
    blocks = N.note_blocks(N.markdown_pages(notes), N.initial_notes(refs))
    matched = N.match_notes(N.group_refs(refs), blocks)
    return N.statement_documents(statements, matched), N.statement_notes_stats(matched, blocks)
