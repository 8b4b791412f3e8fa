"""What a report's pages tell about its contents and sections: one narrow row of marks a page, gathered into one row a report.

Marks come from a single scan and meet in a single exchange on report_id. Contents, spans and noise lines are then functions of
the arrays in a report's row; nothing is joined, and no text is moved. A report's marks are small, whatever its pages hold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import OFFSET_ANCHORS, SECTIONS, Section
from ..functions.cleaning import bound
from ..functions.text import TOC_FORWARD, TOC_REVERSED, either, heading_line, lines, strip, strip_tags
from .notes import SUBTOC_NAMES, SUBTOC_TAIL
from .pages import TOC_LIMIT, names_of, noise_of
from .tables import contents_rows, grids, tables_of

AUDIT, AUDIT_REACH = "审计报告|Auditor", 150
NEAR_TOP, ANCHOR_REACH, NOISE_PAGES = 220, 300, 10
#: Pages from a span's first on that may confirm it.
REACH = 3
_NAMES = "array<string>"


def listed_lines(text: Column) -> Column:
    """array<struct<title, no>> of a contents page's lines 'title no', then 'no title'; lines of one format count if there are at least three."""
    forward, backward = f"(?U){TOC_FORWARD}", f"(?U){TOC_REVERSED}"

    def entry(pattern: str, title: int, no: int) -> Callable[[Column], Column]:
        return lambda x: F.struct(strip(F.regexp_extract(x, pattern, title)).alias("title"), F.regexp_extract(x, pattern, no).try_cast("int").alias("no"))

    def enough(rows: Column) -> Column:
        return F.when(F.size(rows) >= 3, rows).otherwise(F.array().cast("array<struct<title: string, no: int>>"))

    def both(x: Column) -> Column:
        ahead = F.filter(x, lambda y: y.rlike(forward))
        behind = F.filter(x, lambda y: ~y.rlike(forward) & y.rlike(backward))
        return F.concat(enough(F.transform(ahead, entry(forward, 1, 2))), enough(F.transform(behind, entry(backward, 2, 1))))

    return bound(lines(strip_tags(text)), both)


def _found(sections: dict[str, Section], patterns: str) -> Column:
    """The sections with a pattern near the page's top, for those with a sub-table, else in its heading."""
    tests = [F.when(F.col("near" if s.subtoc else "heading").rlike(f"(?i){either(own)}"), F.lit(n)) for n, s in sections.items() if (own := getattr(s, patterns))]
    return F.array_compact(F.array(*tests)).cast(_NAMES) if tests else F.array().cast(_NAMES)


def page_marks(pages: DataFrame, sections: dict[str, Section] = SECTIONS) -> DataFrame:
    """(report_id, page_idx, listed, anchors, body, stop, audit, sub, names), all but the keys small arrays; one row for each page.

    listed: contents entries; anchors: places in OFFSET_ANCHORS; body and stop: sections with such a pattern; audit: an audit report;
    sub: the entries of a statement table; names: company lines. Only tables of contents pages pass through the table helper.
    """
    text = F.coalesce("text", F.lit(""))
    early = (F.col("page_idx") <= TOC_LIMIT) & (text.contains("目录") | F.lower(text).contains("contents"))
    heads = pages.select("report_id", "page_idx", text.alias("text"), early.alias("early"), F.substring(text, 1, NEAR_TOP).alias("near"), heading_line(text).alias("heading"))
    text, top = F.col("text"), F.substring("text", 1, ANCHOR_REACH)
    anchors = F.array_compact(F.array(*[F.when((F.col("page_idx") > TOC_LIMIT) & top.contains(a) if p == a else (F.col("page_idx") > TOC_LIMIT) & top.rlike(p), F.lit(i)) for i, (a, p) in enumerate(OFFSET_ANCHORS)]))
    sub = [F.when(text.contains(n), F.when(text.rlike(n + SUBTOC_TAIL), F.struct(F.lit(n).alias("name"), (F.regexp_extract(text, n + SUBTOC_TAIL, 1) == "P").alias("relative"), F.regexp_extract(text, n + SUBTOC_TAIL, 2).try_cast("int").alias("no")))) for n in SUBTOC_NAMES]
    none = F.array()
    marks = heads.select(
        "report_id", "page_idx", anchors.alias("anchors"), _found(sections, "body").alias("body"), _found(sections, "stop").alias("stop"),
        F.substring("text", 1, AUDIT_REACH).rlike(AUDIT).alias("audit"), F.array_compact(F.array(*sub)).alias("sub"),
        names_of(text).alias("names"),
        F.when(F.col("early"), listed_lines(text)).otherwise(none.cast("array<struct<title: string, no: int>>")).alias("in_lines"),
        F.when(F.col("early") & text.rlike("(?i)<table"), tables_of(text)).otherwise(none.cast(_NAMES)).alias("tables"),
    )
    listed = F.filter(F.concat(contents_rows(grids(F.col("tables"))), "in_lines"), lambda e: e["no"].between(1, 600) & F.length(e["title"]).between(2, 60))
    return marks.withColumn("listed", listed).drop("in_lines", "tables")


def report_marks(marks: DataFrame) -> DataFrame:
    """One row for each report: last_page_idx, page numbers in order, and the marks of the pages that have some, in page order."""
    kept = lambda test, *columns: F.array_sort(F.collect_list(F.when(test, F.struct("page_idx", *columns))))
    some = lambda c: F.size(c) > 0
    anchors = [F.min(F.when(F.array_contains("anchors", i), F.col("page_idx"))).alias(f"at{i}") for i in range(len(OFFSET_ANCHORS))]
    return marks.groupBy("report_id").agg(
        F.max("page_idx").alias("last_page_idx"), F.array_sort(F.collect_list("page_idx")).alias("page_list"), *anchors,
        kept(some("listed"), "listed").alias("lists"), kept(some("body"), "body", "audit").alias("bodies"), kept(some("stop"), "stop").alias("stops"),
        F.min(F.when(F.size("sub") >= 2, F.struct("page_idx", "sub"))).alias("sub"), kept(some("names"), "names").alias("named"),
    )


def first_where(rows: Column, test: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(rows, test), F.lit(0))


def with_contents(reports: DataFrame) -> DataFrame:
    """Adds toc_page_offset and toc, an array of (pos, title, reported_page_no, start_page_idx, end_page_idx).

    The same title and number count once, where they come first; entries are ordered by number, ties as they come. The offset is page index
    minus printed number at the first anchor that both sides have, else 0; of titles that repeat, the last number counts at the place of
    the first. An entry ends before the next one starts, the last one with the last page.
    """
    once = F.array_distinct(F.flatten(F.transform("lists", lambda p: p["listed"])))
    entries = F.array_sort(F.transform(once, lambda e, i: F.struct(e["no"].alias("no"), i.alias("turn"), e["title"].alias("title"))))
    listed = reports.withColumn("entries", entries)

    def printed(anchor: str) -> Column:
        own = lambda title: F.element_at(F.filter("entries", lambda e: e["title"] == title), -1)["no"]
        return bound(first_where(F.col("entries"), lambda e: e["title"].contains(anchor))["title"], lambda t: F.when(t.isNotNull(), own(t)))

    offset = F.coalesce(*[F.when(F.col(f"at{i}").isNotNull(), F.col(f"at{i}") - printed(a)) for i, (a, _) in enumerate(OFFSET_ANCHORS)], F.lit(0))
    placed = listed.withColumn("toc_page_offset", offset)
    end = lambda i: F.coalesce(F.get("entries", i + 1)["no"] + F.col("toc_page_offset") - 1, F.col("last_page_idx"))
    entry = lambda e, i: F.struct(i.alias("pos"), e["title"].alias("title"), e["no"].alias("reported_page_no"), (e["no"] + F.col("toc_page_offset")).alias("start_page_idx"), end(i).alias("end_page_idx"))
    return placed.withColumn("toc", F.transform("entries", entry)).drop("entries")


def rows_of(reports: DataFrame, array: str, key: str, *columns: str) -> DataFrame:
    """A row for each struct of an array column, with more columns of the report; key: a field that is never null.

    The outer form: for the other one Spark infers a filter on the array, moves it down, and makes the array twice.
    """
    return reports.select(*columns, F.inline_outer(array)).where(F.col(key).isNotNull())


def with_noise(reports: DataFrame) -> DataFrame:
    """Adds noise: the company lines of the report's first pages in all their forms, or null."""
    firsts = F.slice("page_list", 1, NOISE_PAGES)
    return reports.withColumn("noise", noise_of(F.filter("named", lambda p: F.array_contains(firsts, p["page_idx"]))))


def contents_span(name: str, s: Section) -> Column:
    """struct(start, end, titles) of a section by the contents, or null without a matching entry.

    The first matching entry; merging sections reach from the first to the last one. A span that ends before it starts is
    repaired by the entries after the last match: for merging sections the first with a stop pattern, else the first that starts later;
    else it reaches the last page.
    """

    def span(hits: Column) -> Column:
        first, last = F.get(hits, F.lit(0)), F.element_at(hits, -1)
        start, end = first["start_page_idx"], (last if s.merge else first)["end_page_idx"]
        later = lambda test: first_where(F.col("toc"), lambda e: (e["pos"] > last["pos"]) & test(e))["start_page_idx"] - 1
        stop = [later(lambda e: e["title"].rlike(f"(?i){either(s.stop)}"))] if s.merge and s.stop else []
        repaired = F.coalesce(*stop, later(lambda e: e["start_page_idx"] > start), F.col("last_page_idx"))
        return F.when(F.size(hits) > 0, F.struct(start.alias("start"), F.when(end >= start, end).otherwise(repaired).alias("end"), F.transform(hits, lambda e: e["title"]).alias("titles")))

    return bound(F.filter("toc", lambda e: e["title"].rlike(f"(?i){either(s.toc)}")), span)


def body_span(name: str, s: Section) -> Column:
    """struct(start, end) of a section by a scan of the body, or null if it is not found.

    It starts where the statement table says, else on the first page with a body pattern that is no audit report; it ends before the
    first later page with a stop pattern, else with the last page.
    """
    seen = first_where(F.col("bodies"), lambda p: F.array_contains(p["body"], name) & ~p["audit"])["page_idx"]
    first = F.when(F.exists("sub.sub", lambda x: x["relative"]), F.col("sub.page_idx")).otherwise(F.lit(0))
    number = lambda n: first_where(F.col("sub.sub"), lambda x: x["name"] == n)["no"]
    listed = [first + number(n) for n in s.subtoc]
    stop = lambda start: first_where(F.col("stops"), lambda p: F.array_contains(p["stop"], name) & (p["page_idx"] > start))["page_idx"] - 1
    return bound(F.coalesce(*listed, seen), lambda start: F.when(start.isNotNull(), F.struct(start.alias("start"), F.coalesce(stop(start), F.col("last_page_idx")).alias("end"))))


def with_spans(reports: DataFrame, sections: dict[str, Section] = SECTIONS, most: int | None = None, require_toc: bool = True) -> DataFrame:
    """Adds spans: an array of (section, start_page_idx, end_page_idx, fallback_used, matched_titles) of the sections that are found.

    The span of the contents where a body pattern on its first pages confirms it (or there is none to confirm), else a scan of the body.
    Reports without contents entries have no spans, unless require_toc is off. most: page numbers of a span at most.
    """
    listed = reports.withColumns({f"listed{i}": contents_span(n, s) for i, (n, s) in enumerate(sections.items())})
    scanned = listed.withColumns({f"scanned{i}": body_span(n, s) for i, (n, s) in enumerate(sections.items()) if s.body})

    def span(i: int, n: str, s: Section) -> Column:
        own, titles = F.col(f"listed{i}"), F.coalesce(F.col(f"listed{i}.titles"), F.array().cast(_NAMES))
        good = own.isNotNull()
        if s.body:
            until = F.least(own["start"] + REACH, own["end"] + 1) - 1
            good &= F.exists("bodies", lambda p: F.array_contains(p["body"], n) & p["page_idx"].between(own["start"], until))
        cut = lambda x: F.least(x["end"], x["start"] + most - 1) if most else x["end"]
        made = lambda x, scan: F.struct(F.lit(n).alias("section"), x["start"].cast("int").alias("start_page_idx"), cut(x).cast("int").alias("end_page_idx"), F.lit(scan).alias("fallback_used"), titles.alias("matched_titles"))
        out = F.when(good, made(own, False))
        if s.body:
            wanted = F.col(f"scanned{i}").isNotNull() & ((F.size("toc") > 0) | F.lit(not require_toc))
            out = out.when(wanted, made(F.col(f"scanned{i}"), True))
        return out

    spans = F.array_compact(F.array(*[span(i, n, s) for i, (n, s) in enumerate(sections.items())]))
    return scanned.withColumn("spans", spans).drop(*[f"{x}{i}" for i in range(len(sections)) for x in ("listed", "scanned")])
