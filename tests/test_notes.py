"""Hand-made cases of the note operators."""

import pytest
from pyspark.sql import functions as F

from pagesieve.operators import notes as N

PAGES = "report_id string, page_idx int, text string"
REFS = "report_id string, main_section string, sub_notes array<int>, first_bs_note int"


def kept(spark, pages, refs):
    return sorted(r["page_idx"] for r in N.referenced_pages(spark.createDataFrame([("r", i, t) for i, t in pages], PAGES), spark.createDataFrame([("r", *refs)], REFS)).collect())


def test_pages_of_a_main_section(spark):
    pages = [(1, "五、政策\n1. x"), (2, "六、项目附注\n"), (3, "2. 存款"), (4, "没有标题"), (5, "3. 其他"), (6, "眉\n页\n七、其他"), (7, "2. 又")]
    assert kept(spark, pages, ("六", [1, 2], 1)) == [2, 3, 4]


def test_pages_without_a_main_section(spark):
    pages = [(1, "七、政策"), (2, "<table><tr>"), (3, "续"), (4, "九、存款"), (5, "十、其他"), (6, "(续) 见 8、")]
    assert kept(spark, pages, (None, [8, 9], 8)) == [2, 3, 4, 6]


def test_all_pages_without_references(spark):
    assert kept(spark, [(1, "a"), (2, "b")], (None, [], None)) == [1, 2]


def test_blocks_take_their_headings(spark):
    text = "<!-- page: 3 -->\n前言\n\n1. 甲\n\n续文\n\n<!-- page: 4 -->\n无标题\n\n<!-- page: 5 -->\n接上\n\n2、乙（续）\n<!-- page: 6 [hit] -->\n"
    pages = N.markdown_pages(spark.createDataFrame([("r", text)], "report_id string, markdown string"))
    first = spark.createDataFrame([("r", 9)], "report_id string, note_no int")
    rows = N.note_blocks(pages, first).orderBy("block_id").collect()
    assert [(r["page_idx"], r["note_no"], r["title"]) for r in rows] == [(3, 9, None), (3, 1, "甲"), (3, 1, "甲"), (4, None, None), (5, 1, None), (5, 2, "乙")]


def test_one_group_for_a_shared_note(spark):
    table = "| 资产 | 附注 | 本年 | 上年 |\n|---|---|---|---|\n| 甲 | 31(5) | 1 | - |\n| 其中：乙 | 31(5) | 2 | 1 |\n| 合计 | | 3 | 1 |\n\n| x | y |\n| 丙 | 4 |"
    refs = N.statement_note_refs(spark.createDataFrame([("r", "bs", table)], "report_id string, statement string, markdown string"))
    (g,) = N.group_refs(refs).collect()
    assert (g["note_key"], g["note_no"], g["note_subref"], g["items"], g["amounts"]) == ("31(5)", 31, "5", ["甲", "乙"], ["1", "2"])


def test_relative_page_numbers(spark):
    rows = N.subtoc_pages(spark.createDataFrame([("r", 90, "合并资产负债表 P5\n合并利润表 P7")], PAGES)).collect()
    assert {(r["name"], r["page_idx"]) for r in rows} == {("合并资产负债表", 95), ("合并利润表", 97)}


@pytest.mark.parametrize(
    "text,footer,wanted",
    [("某公司\n短标题\n正文很长很长，有句号。", False, "正文很长很长，有句号。"), ("短标题\n正文，", False, "短标题\n正文，"), ("正文，\n短\n12", True, "正文，"), ("", False, "")],
)
def test_noise(spark, text, footer, wanted):
    row = spark.createDataFrame([(text,)], "t string").select(N.strip_noise(F.col("t"), F.array(F.lit("某公司")), footer).alias("x")).first()
    assert row["x"] == wanted
