"""Parser items to page tables, and operators on pages. Tables are keyed by report_id and page_idx."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import NOTES_PATTERNS, STATEMENT_PATTERNS
from ..functions.cleaning import clean_special_symbols, polish_readability
from ..functions.text import either, is_furniture, lines, strip

TOC_LIMIT = 20


def item_text(clean: bool = False) -> Column:
    """The first of text, table_body and code_body that is not empty, stripped; else the list items. clean: symbols and readability too."""
    filled = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("text", "table_body", "code_body")])
    text = F.coalesce(strip(filled), F.array_join("list_items", "\n"), F.lit(""))
    return polish_readability(clean_special_symbols(text)) if clean else text


def item_markdown(text: Column) -> Column:
    kind = F.lower(F.coalesce(F.nullif("type", F.lit("")), F.col("category"), F.lit("")))
    heading = kind.contains("title") | kind.contains("heading")
    return F.when(heading & (text != ""), F.concat(F.lit("## "), text)).otherwise(text)


def ordered(value: str, *order: str) -> Column:
    """The values of a group as an array in the given order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda x: x[value])


def items_to_pages(items: DataFrame, clean: bool = False) -> DataFrame:
    """(report_id, page_idx, text, markdown): one row for each page that has items, empty ones too.

    One exchange on report_id serves this and what follows on the same key.
    """
    page = items.withColumn("page_idx", F.coalesce("page_idx", F.lit(0))).withColumn("own", item_text(clean)).withColumn("md", item_markdown(F.col("own")))
    texts = page.repartition("report_id").groupBy("report_id", "page_idx").agg(ordered("own", "seq").alias("texts"), ordered("md", "seq").alias("mds"))
    joined = lambda c, by: strip(F.array_join(F.filter(c, lambda x: x != ""), by))
    return texts.select("report_id", "page_idx", joined("texts", "\n").alias("text"), joined("mds", "\n\n").alias("markdown"))


def page_tags(statements: Sequence[str] = STATEMENT_PATTERNS, notes: Sequence[str] = NOTES_PATTERNS) -> Column:
    """prefix:pattern for each pattern in the text, statements first."""
    tags = [(f"statement:{p}", p) for p in statements] + [(f"notes:{p}", p) for p in notes]
    return F.array_compact(F.array(*[F.when(F.col("text").rlike(f"(?i){p}"), F.lit(tag)) for tag, p in tags]))


def find_pages(pages: DataFrame, patterns: Sequence[str], start: int | None = None, end: int | None = None, skip_toc: bool = False) -> DataFrame:
    """Pages that match any pattern, within inclusive bounds; skip_toc passes over early pages with a 目录."""
    hit = F.col("text").rlike(either(patterns))
    if start is not None:
        hit &= F.col("page_idx") >= start
    if end is not None:
        hit &= F.col("page_idx") <= end
    if skip_toc:
        hit &= ~((F.col("page_idx") <= TOC_LIMIT) & F.col("text").contains("目录"))
    return pages.where(hit)


def page_range(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """The pages within their report's span (report_id, start_page_idx, end_page_idx), bounds included; absent numbers are passed over."""
    inside = F.col("page_idx").between(F.col("start_page_idx"), F.col("end_page_idx"))
    return pages.join(spans.select("report_id", "start_page_idx", "end_page_idx"), "report_id").where(inside).drop("start_page_idx", "end_page_idx")


def find_first_page(pages: DataFrame, patterns: Sequence[str]) -> DataFrame:
    return find_pages(pages, patterns, skip_toc=True).groupBy("report_id").agg(F.min("page_idx").alias("page_idx"))


def document_markdown(pages: DataFrame) -> DataFrame:
    """One text for each report: its pages in order, each under a marker."""
    body = F.concat(F.lit("<!-- page: "), F.col("page_idx").cast("string"), F.lit(" -->\n"), F.col("markdown"), F.lit("\n"))
    marked = pages.select("report_id", "page_idx", body.alias("part"))
    return marked.groupBy("report_id").agg(F.array_join(ordered("part", "page_idx"), "\n\n").alias("markdown"))


def page_candidates(pages: DataFrame) -> DataFrame:
    """For each report the ordered pages with statement and with notes tags; empty where there are none."""
    of = lambda prefix: F.array_sort(F.collect_list(F.when(F.exists("matched_tags", lambda t: t.startswith(prefix)), F.col("page_idx"))))
    return pages.groupBy("report_id").agg(of("statement:").alias("statement_pages"), of("notes:").alias("notes_pages"))


def company_lines(text: Column) -> Column:
    """The lines of a text that are a company's name."""
    return F.filter(lines(text), lambda x: F.length(x).between(4, 40) & x.rlike(r"^.+(?:股份有限公司|有限公司)\z"))


def noise_forms(line: Column) -> Column:
    """A name as it stands and with either kind of brackets."""
    return F.array(line, F.translate(line, "（）", "()"), F.translate(line, "()", "（）"))


def names_of(text: Column) -> Column:
    """company_lines() of the texts that hold any; the others are not split."""
    return F.when(text.contains("有限公司"), company_lines(text)).otherwise(F.array().cast("array<string>"))


def noise_of(named: Column) -> Column:
    """All forms of the names in an array of (page_idx, names), or null without any."""
    names = F.flatten(F.transform(named, lambda p: p["names"]))
    return F.nullif(F.array_sort(F.array_distinct(F.flatten(F.transform(names, noise_forms)))), F.array().cast("array<string>"))


def report_noise(pages: DataFrame, first: int = 10) -> DataFrame:
    """(report_id, noise): company-name lines of a report's first pages, with both kinds of brackets. Only these lines are moved, once."""
    named = pages.select("report_id", "page_idx", names_of(F.coalesce("text", F.lit(""))).alias("names"))
    heads = named.groupBy("report_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("page_idx", "names"))), 1, first).alias("heads"))
    return heads.select("report_id", noise_of(F.col("heads")).alias("noise")).where("noise is not null")


def without_noise_lines(pages: DataFrame, noise: DataFrame) -> DataFrame:
    """pages without the lines that are furniture or among their report's noise (report_id, noise)."""
    kept = F.filter(F.split("text", "\n"), lambda x: ~is_furniture(x, F.col("noise")))
    return pages.join(noise, "report_id", "left").withColumn("text", F.array_join(kept, "\n")).drop("noise")


def pending_reports(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Reports that have no stored page yet."""
    return wanted.join(stored.select("report_id").distinct(), "report_id", "left_anti")


def run_summary(slim: DataFrame) -> DataFrame:
    """report_id, chars and estimated tokens (chars / 1.5) of each document."""
    return slim.select("report_id", "pages", F.length("markdown").alias("chars"), F.floor(F.length("markdown") / 1.5).cast("long").alias("est_tokens"))
