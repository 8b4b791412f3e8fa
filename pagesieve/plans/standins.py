"""Page tables made from the given tables by expressions that Spark and DuckDB both know."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Documents as pages: reports of up to 500 page numbers for each source; numbers of other sources are absent. Dollar signs,
#: between which the cleaning sees formulas, become paragraph signs.
DOCUMENT_PAGES = "source || '-' || cast(floor(doc_id / 500) AS int) AS report_id, cast(doc_id % 500 AS int) AS page_idx, replace(text, '$', '§') AS text"


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").selectExpr("concat(source, '-', cast(floor(doc_id / 500) AS int)) AS report_id", "cast(doc_id % 500 AS int) AS page_idx", "replace(text, '$', '§') AS text")


def conversation_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as parser items, two a page."""
    turns = read(spark, sf_dir, "conversations")
    return turns.selectExpr(
        "cast(conv_id AS string) AS report_id", "cast(turn AS int) AS seq", "cast(floor(turn / 2) AS int) AS page_idx",
        "CASE role WHEN 'user' THEN 'title' ELSE 'text' END AS type", "cast(null AS string) AS category", "text",
        "cast(null AS string) AS table_body", "cast(null AS string) AS code_body", "cast(null AS array<string>) AS list_items",
    )


#: The text of page n (0 to 13) of the report of supplier k, named name.
REPORT_TEXT = """CASE n
 WHEN 0 THEN '示例' || k || '保险股份有限公司' || chr(10) || 'Annual report of ' || name
 WHEN 1 THEN '目录' || chr(10) || CASE WHEN k % 2 = 0
   THEN '管理层讨论与分析 3' || chr(10) || '公司治理 5' || chr(10) || '合并资产负债表 6' || chr(10) || '合并利润表 8' || chr(10) || '财务报表附注 10' || chr(10) || '财务报表补充资料 13'
   ELSE '3 经营业绩回顾与分析' || chr(10) || '5 公司治理' || chr(10) || '6 合并资产负债表' || chr(10) || '8 合并利润表' || chr(10) || '10 财务报表附注' || chr(10) || '13 财务报表补充资料' END
 WHEN 2 THEN CASE WHEN k % 2 = 0 THEN '管理层讨论与分析' ELSE '经营业绩回顾与分析' END || chr(10) || 'Business of ' || name || ' grew.'
 WHEN 3 THEN CASE WHEN k % 11 = 0 THEN '' ELSE 'More on page ' || n END
 WHEN 4 THEN '公司治理' || chr(10) || 'The board met ' || (k % 7) || ' times.'
 WHEN 5 THEN CASE WHEN k % 5 = 0 THEN '资产负债表' ELSE '合并资产负债表' END || chr(10) || '| 项目 | 附注 | 2025 | 2024 |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || '| 货币资金 | 1 | ' || (k * 101) || ' | ' || (k * 99) || ' |' || chr(10) || '| 其中：存款（定期） | 8/2(3) | ' || (k + 5) || ' | - |' || chr(10) || '| 资产总计 |  | ' || (k * 200) || ' | ' || (k * 190) || ' |'
 WHEN 6 THEN '资产续表'
 WHEN 7 THEN '合并利润表' || chr(10) || '| 项目 | 附注 | 2025 | 2024 |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || '| 保险服务收入 | 3 | ' || (k * 7) || ' | ' || (k * 6) || ' |'
 WHEN 8 THEN '利润续表'
 WHEN 9 THEN '财务报表附注' || chr(10) || '1、货币资金' || chr(10) || 'Cash ' || (k * 101)
 WHEN 10 THEN '2. 存款（续）' || chr(10) || '(3) 定期 ' || (k + 5)
 WHEN 11 THEN '3 保险服务收入' || chr(10) || 'Income ' || (k * 7)
 WHEN 12 THEN '财务报表补充资料'
 ELSE 'End of ' || name END"""
REPORT_PAGE = "CASE WHEN n < 2 THEN n ELSE n + 22 + k % 3 END"
PAGES_OF_A_REPORT = 14


def composed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each supplier: cover, contents, sections; page numbers 2 to 20 are absent."""
    base = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("k"), F.col("s_name").alias("name"), F.explode(F.sequence(F.lit(0), F.lit(PAGES_OF_A_REPORT - 1))).alias("n"))
    return base.selectExpr("cast(k AS string) AS report_id", f"cast({REPORT_PAGE} AS int) AS page_idx", f"{REPORT_TEXT} AS text")


COMPOSED_SQL = f"""pages AS (
  SELECT cast(k AS varchar) AS report_id, cast({REPORT_PAGE} AS int) AS page_idx, {REPORT_TEXT} AS text
  FROM (SELECT cast(s_suppkey AS int) AS k, s_name AS name, unnest(range(0, {PAGES_OF_A_REPORT})) AS n FROM supplier)
)"""
DOCUMENTS_SQL = f"pages AS (SELECT {DOCUMENT_PAGES} FROM documents)"
ITEMS_SQL = """items AS (
  SELECT cast(conv_id AS varchar) AS report_id, cast(turn AS int) AS seq, cast(floor(turn / 2) AS int) AS page_idx,
         CASE role WHEN 'user' THEN 'title' ELSE 'text' END AS type, coalesce(text, '') AS text FROM conversations
)"""


def grouped(n: str) -> str:
    """A whole number below 10**12 with commas, as an expression."""
    part = lambda i: f"cast(floor({n} / {1000**i}) AS bigint)"
    three = lambda i: f"lpad(cast({part(i)} % 1000 AS string), 3, '0')"
    out = f"cast({part(0)} AS string)"
    for i in (1, 2, 3):
        tail = " || ',' || ".join(three(j) for j in reversed(range(i)))
        out = f"CASE WHEN {n} >= {1000**i} THEN cast({part(i)} AS string) || ',' || {tail} ELSE {out} END"
    return out


#: Ledger reports: a report for each supplier with a note for each of eleven groups of its line items. Styles by k % 3: notes in a main section
#: (0), without one (1, 2); the statements of k % 9 = 2 have no references; the contents of k % 4 = 1 name no statements. A note's page comes in five forms,
#: by (k + i) % 5: with a heading, without one, with the end of the note before, with subsections, and as an HTML table.
_NOTE_NAME = "CASE i WHEN 4 THEN '货币资金' WHEN 5 THEN '交易资产' WHEN 6 THEN '衍生资产（净额）' WHEN 7 THEN '存出保证金' WHEN 8 THEN '定期存款' WHEN 9 THEN '投资资产' WHEN 10 THEN '保险收入' WHEN 11 THEN '利息收入' WHEN 12 THEN '分红收入' WHEN 13 THEN '其他收益' ELSE '业务费用' END"
_NOTE_REF = "CASE WHEN k % 9 = 2 THEN '' WHEN i = 6 THEN '6/2(3)' WHEN i = 7 THEN '7(2)' WHEN i = 8 THEN '8(5)' WHEN i = 12 THEN '12（2）' WHEN i = 5 AND k % 2 = 0 THEN '4' ELSE cast(i AS string) END"
LEDGER_NOTES = f"""SELECT *, {_NOTE_NAME} AS item, {_NOTE_REF} AS ref, {grouped('cents')} AS cur, {grouped('units')} AS prior FROM (
  SELECT cast(l_suppkey AS int) AS k, cast(l_partkey % 11 + 4 AS int) AS i, cast(sum(round(l_extendedprice * 100)) AS bigint) AS cents, cast(sum(l_quantity) * 100 + 7 AS bigint) AS units FROM {{lineitem}} GROUP BY l_suppkey, l_partkey % 11 + 4
)"""
_TWO = "chr(10) || chr(10)"
_NOTE_PAGE = f"""CASE WHEN i = 4 AND k % 3 = 0 THEN '七、合并项目注释' || {_TWO} ELSE '' END || CASE (k + i) % 5
 WHEN 0 THEN i || '、' || item || {_TWO} || 'Opening ' || cur || ' of the item.' || {_TWO} || 'Closing ' || prior || '.'
 WHEN 1 THEN 'Balance ' || cur || ' and ' || prior || ' without a heading, beside 保险收入.'
 WHEN 2 THEN 'The end of the note before' || {_TWO} || i || '. ' || item || {_TWO} || '（1）甲' || {_TWO} || 'Text ' || cur
 WHEN 3 THEN i || ' ' || item || '（续）' || {_TWO} || '（1）Part one' || {_TWO} || '（2）Part two ' || cur || {_TWO} || '（5）Part five ' || prior || {_TWO} || 'More of five'
 ELSE '<table><tr><td>项目</td><td>2025</td></tr><tr><td>' || item || '</td><td>' || cur || '</td></tr></table>' END"""
_STATEMENT = f"""CASE WHEN i < 10 THEN '合并资产负债表' ELSE '合并利润表' END || chr(10) || '| 项目 | 附注' || CASE WHEN k % 3 = 0 THEN '七' ELSE '' END || ' | 2025 | 2024 |' || chr(10) || '| --- | --- | --- | --- |'"""
_STATEMENT_ROW = "chr(10) || '| ' || CASE WHEN i = 9 THEN '其中：' ELSE '' END || item || ' | ' || ref || ' | ' || cur || ' | ' || CASE WHEN i = 13 THEN '-' ELSE prior END || ' |'"
_CONTENTS = """'目录' || chr(10) || '管理层讨论与分析 3' || chr(10) || '公司治理 5' || CASE WHEN k % 4 = 1 THEN '' ELSE chr(10) || '合并资产负债表 7' || chr(10) || '合并利润表 9' END || chr(10) || '财务报表附注 11' || chr(10) || '财务报表补充资料 24'"""
#: Page n of a report without notes: its texts by n.
_PLAIN_PAGES = {
    0: "'示例' || k || '保险股份有限公司' || chr(10) || 'Ledger of ' || name",
    1: _CONTENTS,
    2: "'管理层讨论与分析' || chr(10) || 'Business of ' || name",
    3: "CASE WHEN k % 5 = 0 THEN '' ELSE 'More of it.' END",
    4: "'公司治理' || chr(10) || 'The board of ' || name",
    5: "CASE WHEN k % 4 = 1 THEN '合并及公司资产负债表 ' || (28 + k % 3) || chr(10) || '合并利润表 ' || (30 + k % 3) ELSE 'A page between.' END",
    7: "'资产续表'",
    9: "'利润续表'",
    10: f"'财务报表附注' || {_TWO} || CASE WHEN k % 3 = 0 THEN '六、会计政策' || {_TWO} ELSE '' END || '2. 会计估计' || {_TWO} || 'Policies of ' || name",
    22: f"CASE WHEN k % 3 = 0 THEN '八、其他披露' || {_TWO} || '14. 业务费用' WHEN k % 2 = 0 THEN '（续）14. 业务费用' || {_TWO} || 'More on costs' ELSE '3. 关联方' || {_TWO} || 'Related to ' || name END",
    23: "'财务报表补充资料'",
    24: "'End of ' || name",
}
LEDGER_PAGES = f"""SELECT cast(k AS string) AS report_id, cast(CASE WHEN n < 2 THEN n ELSE n + 22 + k % 3 END AS int) AS page_idx, text FROM (
  {" UNION ALL ".join(f"SELECT k, {n} AS n, {text} AS text FROM (SELECT cast(s_suppkey AS int) AS k, s_name AS name FROM {{supplier}})" for n, text in _PLAIN_PAGES.items())}
  UNION ALL SELECT k, i + 7, {_NOTE_PAGE} FROM ({LEDGER_NOTES})
  UNION ALL SELECT k, n, min(head) || {{joined}} FROM (SELECT k, i, CASE WHEN i < 10 THEN 6 ELSE 8 END AS n, {_STATEMENT} AS head, {_STATEMENT_ROW} AS line FROM ({LEDGER_NOTES})) GROUP BY k, n
)"""
LEDGER_SQL = "pages AS (" + LEDGER_PAGES.format(lineitem="lineitem", supplier="supplier", joined="string_agg(line, '' ORDER BY i)") + ")"


def ledger_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger reports, from all line items."""
    return spark.sql(LEDGER_PAGES.replace("{joined}", "array_join(transform(array_sort(collect_list(struct(i, line))), x -> x.line), '')"), lineitem=read(spark, sf_dir, "lineitem"), supplier=read(spark, sf_dir, "supplier"))


#: A page for each nation with a table of its customers by segment: a header of two rows with merged cells, line breaks, bars, labels left blank,
#: repeated totals, a blank row; for nations with an even number and four segments section rows that split it.
_SEGMENTS = f"""SELECT k, row_no, m, name, {grouped('n')} AS n, {grouped('cents')} AS cents FROM (
  SELECT cast(c_nationkey AS int) AS k, cast(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS int) AS row_no, cast(count(*) OVER (PARTITION BY c_nationkey) AS int) AS m, c_mktsegment AS name, count(*) AS n, cast(sum(abs(round(c_acctbal * 100))) AS bigint) AS cents FROM {{customer}} GROUP BY c_nationkey, c_mktsegment
)"""
_TR = "'<tr><td>' || {0} || '</td><td>' || {1} || '</td><td>' || {2} || '</td></tr>'"
_SEGMENT_ROW = f"CASE WHEN k % 2 = 0 AND m >= 4 AND row_no = 2 THEN {_TR.format("'甲部'", "''", "''")} WHEN k % 2 = 0 AND m >= 4 AND row_no = 4 THEN {_TR.format("'乙部'", "''", "''")} ELSE '' END || CASE WHEN row_no = 3 THEN '<tr><td>' || name || '<br>a|b</td><td>' || n || '</td><td>' || cents || '</td></tr>' ELSE {_TR.format('name', 'n', 'cents')} END"
_SPANNED_HEAD = "'<table><tr><th rowspan=\"2\">项目</th><th colspan=\"2\">2025年</th></tr><tr><th>户数</th><th>余额</th></tr>'"
_SPANNED_TAIL = f"{_TR.format(chr(39) * 2, 'min(n)', 'min(cents)')} || {_TR.format(chr(39) * 2, 'min(n)', chr(39) + '-' + chr(39))} || {_TR.format(chr(39) * 2, 'min(n)', chr(39) + '-' + chr(39))} || {_TR.format(chr(39) * 2, chr(39) * 2, chr(39) * 2)}"
SPANNED_PAGES = f"SELECT cast(k AS string) AS report_id, cast(30 AS int) AS page_idx, 'Before.' || {_SPANNED_HEAD} || {{joined}} || {_SPANNED_TAIL} || '</table>After.' AS text FROM (SELECT *, {_SEGMENT_ROW} AS line FROM ({_SEGMENTS})) GROUP BY k"
SEGMENTS_SQL = _SEGMENTS.format(customer="customer")


def spanned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SPANNED_PAGES.replace("{joined}", "array_join(transform(array_sort(collect_list(struct(row_no, line))), x -> x.line), '')"), customer=read(spark, sf_dir, "customer"))
