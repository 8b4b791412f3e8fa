"""HTML tables of pages: grids, Markdown and cleaned pages.

Spark finds the tables and renders their grids by array functions; one vectorised helper parses a table at a time, and only tables reach it.
"""

from __future__ import annotations

import html
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions.cleaning import bound, clean_page_symbols, made_once, plain_special_symbols, polish_readability
from ..functions.text import is_value_like, strip, strip_tags
from .notes import strip_noise

TABLE = r"(?is)<table.*?</table>"
CORNER, TOTAL = "项目", "合计"
CELL = StructType().add("text", "string").add("rowspan", "integer").add("colspan", "integer").add("is_header", "boolean").add("is_anchor", "boolean")


class Cell(NamedTuple):
    text: str = ""
    rowspan: int = 1
    colspan: int = 1
    is_header: bool = False
    is_anchor: bool = True


class _Cells(HTMLParser):
    """The rows of a table as they are written, without spans."""

    def __init__(self):
        super().__init__()
        self.rows: list[list[Cell]] = []
        self.row: list[Cell] | None = None
        self.open: tuple[list[str], int, int, bool] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.row, self.open = [], None
        elif tag in ("td", "th") and self.row is not None:
            size = {k: int(v) for k, v in attrs if v and v.strip().isdigit()}
            self.open = [], max(1, size.get("rowspan", 1)), max(1, size.get("colspan", 1)), tag == "th"
        elif tag == "br" and self.open:
            self.open[0].append("\n")

    def handle_data(self, data):
        if self.open:
            self.open[0].append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.open:
            parts, *rest = self.open
            self.row.append(Cell(plain_special_symbols(html.unescape("".join(parts)).strip()), *rest))
            self.open = None
        elif tag == "tr" and self.row is not None:
            if self.row:
                self.rows.append(self.row)
            self.row = None


def table_grid(source: str) -> list[list[Cell]]:
    """The table as a rectangle: covered places are blank and no anchors, short rows end in blank anchors. No rows: empty."""
    parser = _Cells()
    parser.feed(source)
    below: dict[int, tuple[int, Cell]] = {}  # column: rows still covered, and by what
    grid = []
    for written in parser.rows:
        row: list[Cell] = []

        def covered(row=row):
            while len(row) in below:
                left, cell = below.pop(len(row))
                if left > 1:
                    below[len(row)] = left - 1, cell
                row.append(cell._replace(text="", is_anchor=False))

        for cell in written:
            covered()
            for i in range(cell.colspan):
                if cell.rowspan > 1:
                    below[len(row)] = cell.rowspan - 1, cell
                row.append(cell if i == 0 else cell._replace(text="", is_anchor=False))
        covered()
        grid.append(row)
    width = max(map(len, grid), default=0)
    return [row + [Cell()] * (width - len(row)) for row in grid] if width else []


@F.pandas_udf(ArrayType(ArrayType(ArrayType(CELL))))
def grids(tables: pd.Series) -> pd.Series:
    return pd.Series([[[[c._asdict() for c in row] for row in table_grid(x)] for x in own] for own in tables], dtype=object)


def _shown(text: Column) -> Column:
    """A cell's text within a table row: line breaks as slashes, bars escaped."""
    return strip(F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), r"(?U)\s*\n\s*", " / "), r"(?U)\s{2,}", " "))


def is_section_row(cells: Column) -> Column:
    """A label and nothing else."""
    return (cells[0] != "") & F.forall(F.slice(cells, F.lit(2), F.size(cells)), lambda x: x == "")


def _row_line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def header_depth(grid: Column) -> Column:
    """How many rows of a grid are its header: one; with merged cells the rows before the first row of values, or two if there is none."""
    width, height = F.size(grid[0]), F.size(grid)
    enough = F.greatest(F.lit(2), F.least(width - 1, F.greatest(F.lit(1), F.floor(width / 2).cast("int"))))
    with_values = F.transform(grid, lambda row: F.size(F.filter(F.slice(row, F.lit(2), F.size(row)), lambda c: is_value_like(c["text"]))) >= enough)
    first = F.coalesce(F.nullif(F.array_position(with_values, True), F.lit(0)) - 1, F.least(F.lit(2), height - 1))
    merged = F.exists(F.flatten(grid), lambda c: c["is_anchor"] & ((c["rowspan"] > 1) | (c["colspan"] > 1)))
    return F.when(merged & (height > 1) & (first > 1) & (first < height), first.cast("int")).otherwise(1)


def header_cells(grid: Column, depth: Column) -> Column:
    """The header of each column: what stands over it from top to bottom, once where it repeats. A merged cell stands over all its columns."""
    placed = F.transform(grid, lambda row: F.transform(row, lambda c, i: F.struct(i.alias("i"), strip(c["text"]).alias("text"), F.when(c["is_anchor"], i + c["colspan"]).otherwise(0).alias("until"))))

    def over(row: Column, at: Column) -> Column:
        # the nearest filled cell to the left that reaches this column; the column's own is the nearest of all
        reaching = F.filter(row, lambda c: (c["text"] != "") & (c["i"] <= at) & ((c["i"] == at) | (c["until"] > at)))
        return F.when(F.size(reaching) > 0, _shown(F.element_at(reaching, -1)["text"])).otherwise(F.lit(""))

    def column(at: Column) -> Column:
        parts = F.filter(F.transform(F.slice(placed, F.lit(1), depth), lambda row: over(row, at)), lambda x: x != "")
        return F.array_join(bound(parts, lambda p: F.filter(F.transform(p, lambda x, i: F.when((i == 0) | (F.get(p, i - 1) != x), x)), lambda x: x.isNotNull())), " / ")

    return F.transform(F.sequence(F.lit(0), F.size(grid[0]) - 1), column)


def cleaned_rows(body: Column) -> Column:
    """Rows of texts, the label first: blank ones go; those without a label are totals, or go if they have no values or values that some row before has.

    A table's rows are at hand as one array, so the first row with the same values is looked up there and nothing is shuffled.
    """

    def rows(marked: Column) -> Column:
        values = F.transform(marked, lambda m: m["values"])
        first = lambda m: (m["filled"]) & (F.array_position(values, m["values"]) - 1 == m["i"])
        kept = F.filter(marked, lambda m: (m["label"] != "") | first(m))
        return F.transform(kept, lambda m: F.concat(F.array(F.when(m["label"] != "", m["label"]).otherwise(TOTAL)), m["values"]))

    rest = lambda row: F.slice(row, F.lit(2), F.size(row))
    return bound(F.transform(body, lambda row, i: F.struct(row[0].alias("label"), rest(row).alias("values"), F.exists(rest(row), lambda x: x != "").alias("filled"), i.alias("i"))), rows)


def _sectioned(head: Column, body: Column) -> Column:
    """Header lines and rows as Markdown; with at least two section rows one titled table for each section that has rows."""
    def text(rows: Column) -> Column:
        whole = F.concat_ws("\n", head, F.transform(rows, lambda r: _row_line(r["row"])))
        titles = F.filter(rows, lambda r: r["title"])

        def part(n: Column) -> Column:
            own = F.filter(rows, lambda r: ~r["title"] & (r["section"] == n))
            named = F.when(n > 0, F.concat(F.lit("**"), F.get(titles, n - 1)["row"][0], F.lit("**")))
            return F.when(F.size(own) > 0, F.concat_ws("\n", named, head, F.transform(own, lambda r: _row_line(r["row"]))))

        parts = F.array_join(F.transform(F.sequence(F.lit(0), F.size(titles)), part), "\n\n")
        return F.when((F.size(titles) < 2) | (parts == ""), whole).otherwise(parts)

    flagged = F.transform(body, lambda row: F.struct(row.alias("row"), is_section_row(row).alias("title")))
    counted = bound(flagged, lambda f: F.transform(f, lambda r, i: F.struct(r["row"].alias("row"), r["title"].alias("title"), F.size(F.filter(F.slice(f, F.lit(1), i + 1), lambda x: x["title"])).alias("section"))))
    return bound(counted, text)


def grid_markdown(grid: Column) -> Column:
    """The Markdown of a grid, or an empty text for one without rows."""

    def rendered(t: Column) -> Column:
        body = F.transform(F.slice(t["grid"], t["depth"] + 1, F.size(t["grid"])), lambda row: F.transform(row, lambda c: _shown(c["text"])))
        labels = lambda b: F.size(F.filter(b, lambda row: row[0] != "")) >= F.greatest(F.lit(2), F.floor(F.size(b) / 3).cast("int"))

        def whole(x: Column) -> Column:
            corner = F.when((x["header"][0] == "") & labels(x["body"]), F.lit(CORNER)).otherwise(x["header"][0])
            header = F.concat(F.array(corner), F.slice(x["header"], F.lit(2), F.size(x["header"])))
            rule = F.concat(F.lit("|"), F.array_join(F.transform(header, lambda _: F.lit("---")), "|"), F.lit("|"))
            return _sectioned(F.concat(_row_line(header), F.lit("\n"), rule), cleaned_rows(x["body"]))

        return bound(F.struct(header_cells(t["grid"], t["depth"]).alias("header"), body.alias("body")), whole)

    made = bound(F.struct(grid.alias("grid"), header_depth(grid).alias("depth")), rendered)
    return F.when(F.size(grid) > 0, made).otherwise(F.lit(""))


def tables_of(text: Column) -> Column:
    """The sources of a text's tables; nothing for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(TABLE), F.lit(0)), F.array().cast("array<string>"))


def table_rows(pages: DataFrame) -> DataFrame:
    """(report_id, page_idx, table_no, row_no, cells): the grids' rows as stripped texts. Tables without rows are left out and not counted."""
    held = pages.where(F.col("text").rlike(r"(?i)<table")).select("report_id", "page_idx", F.filter(grids(tables_of(F.col("text"))), lambda g: F.size(g) > 0).alias("grids"))
    tables = held.select("report_id", "page_idx", F.posexplode("grids").alias("table_no", "grid"))
    return tables.select("report_id", "page_idx", "table_no", F.posexplode("grid").alias("row_no", "row")).select("report_id", "page_idx", "table_no", "row_no", F.transform("row", lambda c: c["text"]).alias("cells"))


def table_cells(pages: DataFrame) -> DataFrame:
    """(report_id, page_idx, table_no, row_no, col_no, text, rowspan, colspan, is_header, is_anchor)."""
    held = pages.where(F.col("text").rlike(r"(?i)<table")).select("report_id", "page_idx", F.posexplode(grids(tables_of(F.col("text")))).alias("table_no", "grid"))
    rows = held.select("report_id", "page_idx", "table_no", F.posexplode("grid").alias("row_no", "row"))
    return rows.select("report_id", "page_idx", "table_no", "row_no", F.posexplode("row").alias("col_no", "c")).select("report_id", "page_idx", "table_no", "row_no", "col_no", "c.*")


def contents_rows(found: Column) -> Column:
    """array<struct<title, no>> of the rows of a text's grids that have a title and end in a page number."""
    rows = F.filter(F.transform(F.flatten(found), lambda row: F.transform(row, lambda c: c["text"])), lambda c: F.size(c) >= 2)
    entries = F.filter(rows, lambda c: (c[0] != "") & F.element_at(c, -1).rlike(r"^[0-9]{1,4}\z"))
    return F.transform(entries, lambda c: F.struct(c[0].alias("title"), F.element_at(c, -1).try_cast("int").alias("no")))


def html_toc_entries(pages: DataFrame, limit: int = 20) -> DataFrame:
    """(report_id, toc_page_idx, table_no, row_no, title, reported_page_no): table rows of early pages that end in a page number."""
    rows = table_rows(pages.where(F.col("page_idx") <= limit)).where(F.size("cells") >= 2)
    last = F.element_at("cells", -1)
    found = rows.where((F.col("cells")[0] != "") & last.rlike(r"^[0-9]{1,4}\z"))
    return found.select("report_id", F.col("page_idx").alias("toc_page_idx"), "table_no", "row_no", F.col("cells")[0].alias("title"), last.try_cast("int").alias("reported_page_no"))


def clean_pages(pages: DataFrame) -> DataFrame:
    """pages (report_id, page_idx, text, noise and more) with the text as short documents show it: tables in Markdown, tags dropped,
    symbols and residue cleaned, headers and footers stripped. noise: the report's own noise lines, or null."""
    parts = F.split(F.col("text"), TABLE, -1)
    held = pages.withColumn("_md", F.transform(grids(tables_of(F.col("text"))), grid_markdown))
    joined = F.array_join(F.zip_with(parts, F.col("_md"), lambda a, b: F.concat(a, F.coalesce(F.concat(F.lit("\n\n"), b, F.lit("\n\n")), F.lit("")))), "")
    marked = held.withColumn("text", F.when(F.size("_md") > 0, joined).otherwise(F.coalesce("text", F.lit("")))).drop("_md")
    clean = polish_readability(clean_page_symbols(strip_tags(F.col("text"))))
    noise = F.col("noise")
    stripped = bound(bound(clean, lambda x: strip_noise(x, noise)), lambda x: strip_noise(x, noise, footer=True))
    return made_once(marked, "text", F.regexp_replace(stripped, r"\n{3,}", "\n\n"))
