"""Report files: parser items, page files and documents, and their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "array<struct<page_idx: int, type: string, category: string, text: string, table_body: string, code_body: string, list_items: array<string>>>"
PAGES = "source_pdf string, num_pages int, pages array<struct<page_idx: int, text: string, markdown: string, matched_tags: array<string>>>"
SUFFIXES = (r"\.pages\.json", r"\.candidates\.json", r"\.md", r"\.json")
STATEMENT_SUFFIXES = (r"\.slim\.balance_sheet\.md", r"\.slim\.income_statement\.md", r"\.slim\.financial_notes\.md")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)\z", 1)


def report_id_from_path(path: Column, statements: bool = False) -> Column:
    """The file name without the first of its known suffixes; otherwise without its last suffix."""
    name = base_name(path)
    out = F.when(F.lit(False), name)
    for s in ((*STATEMENT_SUFFIXES, *SUFFIXES) if statements else SUFFIXES):
        out = out.when(name.rlike(f"{s}\\z"), F.regexp_replace(name, f"{s}\\z", ""))
    return out.otherwise(F.regexp_replace(name, r"(?<=.)\.[^.]*\z", ""))


def classify_report(name: Column) -> Column:
    """annual, interim or solvency by the file name; null if it doesn't tell."""
    interim = name.rlike("中期报告|半年度报告|中报")  # a half-year name holds the annual one
    return F.when(interim, "interim").when(name.rlike("年度报告|年报"), "annual").when(name.contains("偿付能力"), "solvency")


def read_content_items(spark: SparkSession, path: str) -> DataFrame:
    """One row for each parser item, in file order (seq). A file is one JSON array."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", ITEM).alias("items"))
    rows = files.select(report_id_from_path(F.col("path")).alias("report_id"), F.posexplode("items").alias("seq", "item"))
    return rows.select("report_id", "seq", "item.*").withColumn("page_idx", F.coalesce("page_idx", F.lit(0)))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.schema(PAGES).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("path"), "pages")
    return files.select(report_id_from_path(F.col("path")).alias("report_id"), F.inline("pages"))


def read_slim_docs(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True)
    return files.select(report_id_from_path(F.col("_metadata.file_path"), statements=True).alias("report_id"), F.col("value").alias("markdown"))


def write_pages(pages: DataFrame, path: str) -> None:
    pages.write.mode("overwrite").parquet(path)


#: Buckets of a stored page table; each holds some reports whole.
BUCKETS = 64


def stored_pages(spark: SparkSession, name: str) -> DataFrame | None:
    """A page table as store_pages() keeps it, or None. Groups and joins on report_id need no exchange."""
    return spark.table(name) if spark.catalog.tableExists(name) else None


def store_pages(pages: DataFrame, name: str, buckets: int = BUCKETS, **options: str) -> int:
    """Adds the reports that a page table does not hold yet, and returns how many; stored reports are not written again.

    The table is bucketed by report_id. A report lies in one file of its bucket, which appears whole or not at all, so a run that broke
    off is taken up by the next. Where nothing is pending, nothing is written. options: of the writer, such as path.
    """
    spark = pages.sparkSession
    known = stored_pages(spark, name)
    if known is not None:
        pages = pages.join(known.select("report_id").distinct(), "report_id", "left_anti")
    added = pages.select("report_id").distinct().count()
    if added:
        dealt = pages.select("report_id", *[c for c in pages.columns if c != "report_id"]).repartition(buckets, "report_id")
        dealt.write.mode("append").bucketBy(buckets, "report_id").sortBy("report_id", "page_idx").options(**options).saveAsTable(name)
    return added


def toc_documents(toc: DataFrame) -> DataFrame:
    """One row for each report: offset, number of entries, entries in order."""
    entry = F.struct("pos", "title", "reported_page_no", "start_page_idx", "end_page_idx")
    return toc.groupBy("report_id").agg(F.first("toc_page_offset").alias("toc_page_offset"), F.count("*").alias("num_entries"), F.array_sort(F.collect_list(entry)).alias("entries"))


def write_json(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").json(path)


def write_slim_docs(docs: DataFrame, path: str, kind: str = "kind") -> None:
    docs.write.mode("overwrite").partitionBy(kind).parquet(path)


def write_theme_results(results: DataFrame, path: str) -> None:
    """Theme results, one JSON object for each report, in a folder for each theme and scope."""
    results.write.mode("overwrite").partitionBy("theme", "scope").json(path)
