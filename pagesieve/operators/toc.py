"""Tables of contents: entries, page ranges, sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SECTIONS, Section
from ..functions.text import TOC_FORWARD, TOC_REVERSED, either, lines, matches_as_heading, matches_near_top, strip, strip_tags
from .marks import page_marks, report_marks, rows_of, with_contents
from .pages import TOC_LIMIT
from .tables import html_toc_entries


def toc_pages(pages: DataFrame) -> DataFrame:
    return pages.where((F.col("page_idx") <= TOC_LIMIT) & (F.col("text").contains("目录") | F.lower("text").contains("contents")))


def toc_entries(pages: DataFrame) -> DataFrame:
    """(report_id, toc_page_idx, ord, title, reported_page_no) from table rows, and from lines 'title no' and 'no title', of contents pages.

    A page's lines of one format count if there are at least three; the same title and number count once,
    where they come first: tables, lines with the number behind, lines with the number before. ord is their order by number, ties as scanned.
    """
    early = toc_pages(pages)
    listed = html_toc_entries(early).select("report_id", "toc_page_idx", F.lit(-1).alias("kind"), F.struct("table_no", "row_no").alias("place"), "title", "reported_page_no")
    found = early.select("report_id", F.col("page_idx").alias("toc_page_idx"), F.posexplode(lines(strip_tags(F.col("text")))).alias("line_no", "line"))
    forward, backward = f"(?U){TOC_FORWARD}", f"(?U){TOC_REVERSED}"
    kind = F.when(F.col("line").rlike(forward), 0).when(F.col("line").rlike(backward), 1)
    found = found.withColumn("kind", kind).where("kind is not null")
    enough = Window.partitionBy("report_id", "toc_page_idx", "kind")
    title = strip(F.when(F.col("kind") == 0, F.regexp_extract("line", forward, 1)).otherwise(F.regexp_extract("line", backward, 2)))
    number = F.when(F.col("kind") == 0, F.regexp_extract("line", forward, 2)).otherwise(F.regexp_extract("line", backward, 1)).try_cast("int")
    rows = found.withColumn("n", F.count("*").over(enough)).where("n >= 3")
    rows = rows.select("report_id", "toc_page_idx", "kind", F.struct(F.lit(0).alias("table_no"), F.col("line_no").alias("row_no")).alias("place"), title.alias("title"), number.alias("reported_page_no"))
    rows = rows.unionByName(listed).where(F.col("reported_page_no").between(1, 600) & F.length("title").between(2, 60))
    first = Window.partitionBy("report_id", "title", "reported_page_no").orderBy("toc_page_idx", "kind", "place")
    once = rows.withColumn("turn", F.row_number().over(first)).where("turn = 1")
    order = Window.partitionBy("report_id").orderBy("reported_page_no", "toc_page_idx", "kind", "place")
    return once.select("report_id", "toc_page_idx", (F.row_number().over(order) - 1).alias("ord"), "title", "reported_page_no")


def toc_ranges(pages: DataFrame) -> DataFrame:
    """(report_id, pos, title, reported_page_no, start_page_idx, end_page_idx, toc_page_offset, last_page_idx) of every entry, in one scan and one exchange.

    See with_contents(). Reports without entries have no row.
    """
    reports = with_contents(report_marks(page_marks(pages, {})))
    return rows_of(reports, "toc", "pos", "report_id", "toc_page_offset", "last_page_idx")


def section_entries(toc: DataFrame, sections: dict[str, Section] = SECTIONS) -> DataFrame:
    """The entries whose title matches a section's patterns, with the section's name. Entry order, not pattern order, decides."""
    named = F.array_compact(F.array(*[F.when(F.col("title").rlike(f"(?i){either(s.toc)}"), F.lit(name)) for name, s in sections.items()]))
    return toc.withColumn("section", F.explode(named))


def toc_spans(toc: DataFrame, sections: dict[str, Section] = SECTIONS) -> DataFrame:
    """(report_id, section, start_page_idx, end_page_idx) from the table of contents.

    The first matching entry; merging sections reach from the first to the last one. A span that ends before
    it starts is repaired by the entries after the last match: for merging sections the first with a stop pattern, else the
    first that starts later; else it reaches the last page.
    """
    hits = section_entries(toc, sections)
    merge = F.col("section").isin([n for n, s in sections.items() if s.merge])
    spans = hits.groupBy("report_id", "section").agg(F.min_by("start_page_idx", "pos").alias("start"), F.min_by("end_page_idx", "pos").alias("first_end"), F.max_by("end_page_idx", "pos").alias("last_end"), F.max("pos").alias("last_pos"), F.max("last_page_idx").alias("last_page_idx"))
    spans = spans.withColumn("end", F.when(merge, F.col("last_end")).otherwise(F.col("first_end")))
    stops = F.lit(False)
    for name, s in sections.items():
        if s.merge and s.stop:
            stops = stops | ((F.col("section") == name) & F.col("title").rlike(f"(?i){either(s.stop)}"))
    after = toc.select("report_id", "pos", "title", F.col("start_page_idx").alias("next_start"))
    later = spans.join(after, "report_id", "left")
    behind = F.col("pos") > F.col("last_pos")
    stop = F.min_by("next_start", F.when(behind & stops, F.col("pos")))
    larger = F.min_by("next_start", F.when(behind & (F.col("next_start") > F.col("start")), F.col("pos")))
    repaired = later.groupBy("report_id", "section", "start", "end", "last_page_idx").agg(stop.alias("stop"), larger.alias("larger"))
    end = F.when(F.col("end") >= F.col("start"), F.col("end")).otherwise(F.coalesce(F.col("stop") - 1, F.col("larger") - 1, F.col("last_page_idx")))
    return repaired.select("report_id", "section", F.col("start").alias("start_page_idx"), end.alias("end_page_idx"))


def verify_spans(spans: DataFrame, pages: DataFrame, sections: dict[str, Section] = SECTIONS, reach: int = 3) -> DataFrame:
    """Adds verified: a body pattern stands on one of the span's first pages (near the top for sections with a
    sub-table, else as heading); sections without body patterns are accepted.

    Only pages that match some section's pattern are joined, on report_id with the page range.
    """
    tests = [F.when(matches_near_top(F.col("text"), s.body) if s.subtoc else matches_as_heading(F.col("text"), s.body), F.lit(n)) for n, s in sections.items() if s.body]
    marks = pages.select("report_id", F.col("page_idx").alias("at"), F.explode(F.array_compact(F.array(*tests))).alias("section"))
    until = F.least(F.col("start_page_idx") + reach, F.col("end_page_idx") + 1) - 1
    joined = spans.join(marks, ["report_id", "section"], "left")
    seen = F.coalesce(F.bool_or(F.col("at").between(F.col("start_page_idx"), until)), F.lit(False))
    open_ended = F.col("section").isin([n for n, s in sections.items() if not s.body])
    return joined.groupBy("report_id", "section", "start_page_idx", "end_page_idx").agg(seen.alias("seen")).withColumn("verified", F.col("seen") | open_ended).drop("seen")
