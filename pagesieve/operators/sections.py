"""Where sections lie: spans of the table of contents where the body confirms them, else a scan of the body."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import NOTES_PATTERNS, SECTIONS, Section
from ..functions.text import either, matches_near_top
from .marks import page_marks, report_marks, rows_of, with_contents, with_noise, with_spans
from .pages import TOC_LIMIT
from .tables import html_toc_entries


def section_spans(pages: DataFrame, sections: dict[str, Section] = SECTIONS, most: int | None = None, require_toc: bool = True) -> DataFrame:
    """(report_id, section, start_page_idx, end_page_idx, fallback_used, matched_titles) of all sections that are found; see with_spans()."""
    reports = with_spans(with_contents(report_marks(page_marks(pages, sections))), sections, most, require_toc)
    return rows_of(reports, "spans", "section", "report_id")


def section_page_numbers(pages: DataFrame, sections: dict[str, Section] = SECTIONS, most: int | None = None, require_toc: bool = True) -> DataFrame:
    """(report_id, page_idx, noise, section, and the columns of section_spans()): a row for each page of a span that exists, so that
    texts join by report and page. noise: the report's own noise lines, or null."""
    reports = with_noise(with_spans(with_contents(report_marks(page_marks(pages, sections))), sections, most, require_toc))
    spans = rows_of(reports, "spans", "section", "report_id", "noise", "page_list")
    inside = F.filter("page_list", lambda p: p.between(F.col("start_page_idx"), F.col("end_page_idx")))
    return spans.withColumn("page_idx", F.explode(inside)).drop("page_list")


def missing_sections(pages: DataFrame, spans: DataFrame, sections: dict[str, Section] = SECTIONS) -> DataFrame:
    """(report_id, stage, message) of the sections that a report has no span for, so that one report does not end a job."""
    wanted = pages.select("report_id").distinct().withColumn("section", F.explode(F.array(*map(F.lit, sections))))
    return wanted.join(spans, ["report_id", "section"], "left_anti").select("report_id", F.lit("section").alias("stage"), F.concat(F.lit("not found: "), "section").alias("message"))


def note_windows(pages: DataFrame, start: Sequence[str] = (), stop: Sequence[str] = ()) -> DataFrame:
    """(report_id, start_page_idx, end_page_idx): the pages of a report's notes; reports without have no row.

    They start on the first page with the first start pattern (in their order) near its top, early pages with a 目录 aside; else
    five pages before the printed number of 财务报表附注 in a contents table. They end before the first later page with
    a stop pattern; else with the last page, but at most five pages after the printed number of the appendix 财务报表补充资料.
    """
    start = start or NOTES_PATTERNS
    body = ~((F.col("page_idx") <= TOC_LIMIT) & F.col("text").contains("目录"))
    firsts = [F.min(F.when(body & matches_near_top(F.col("text"), [p]), F.col("page_idx"))) for p in start]
    marks = pages.groupBy("report_id").agg(F.coalesce(*firsts).alias("first"), F.max("page_idx").alias("last"))
    order = F.struct("toc_page_idx", "table_no", "row_no")
    named = lambda test, to: F.min_by("reported_page_no", F.when(test, order)).alias(to)
    notes = F.col("title").contains("财务报表附注")
    appendix = F.col("title").contains("附录") & F.col("title").contains("财务报表补充资料")
    listed = html_toc_entries(pages).groupBy("report_id").agg(named(notes, "notes_no"), named(appendix, "appendix_no"))
    found = marks.join(listed, "report_id", "left").withColumn("start", F.coalesce("first", F.when(F.col("notes_no").isNotNull(), F.greatest(F.lit(0), F.col("notes_no") - 5)))).where("start is not null")
    if stop:
        test = F.col("text").rlike(f"(?i){either(stop)}") & body
        stops = pages.where(test).select("report_id", F.col("page_idx").alias("at"))
        found = found.join(stops, "report_id", "left").groupBy("report_id", "start", "last", "appendix_no").agg(F.min(F.when(F.col("at") > F.col("start"), F.col("at"))).alias("stop"))
    else:
        found = found.withColumn("stop", F.lit(None).cast("int"))
    end = F.coalesce(F.col("stop") - 1, F.col("last"))
    end = F.when(end == F.col("last"), F.least(end, F.col("appendix_no") + 5)).otherwise(end)
    own = pages.select("report_id", "page_idx").join(found.select("report_id", "start", end.alias("end")), "report_id").where("page_idx BETWEEN start AND end")
    return own.groupBy("report_id").agg(F.min("page_idx").alias("start_page_idx"), F.max("page_idx").alias("end_page_idx"))


