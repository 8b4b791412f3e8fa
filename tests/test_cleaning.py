"""Hand-made cases of cleaning and tables."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagesieve.functions import cleaning as L
from pagesieve.operators import tables as B


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first()["x"]


CASES = [
    (L.collapse_spaced_letters, "n i m and a b cd e f", "nim and ab cd ef"),
    (L.collapse_spaced_letters, "a b c d e f g h", "abcdef gh"),
    (L.normalize_formula, r"2 9 . 3 \%", "29.3%"),
    (L.normalize_formula, r"\mathrm { A A } ^ { + }", "AA +"),
    (L.normalize_formula, r"1 0 \times 5", "10 x 5"),
    (L.clean_ocr_residue, "新华20252025年是", "新华2025年是"),
    (L.clean_ocr_residue, "20251231", "2025年12月31日"),
    (L.clean_ocr_residue, "2025123112,345", "2025年12月31日 12,345"),
    (L.clean_ocr_residue, "195,87114.9%", "195,871 / 14.9%"),
    (L.clean_ocr_residue, "12.345.67", "12,345.67"),
    (L.clean_ocr_residue, "合计 1,234,56788", "合计 1,234,567"),
    (L.clean_ocr_residue, "aﾠﾠb\nc", "a b\nc"),
    (L.clean_ocr_residue, "5%3-5年", "5% / 3-5年"),
    (L.clean_special_symbols, r"$2 9 . 3 \%$ 增长 , 好", "29.3% 增长, 好"),
    (L.clean_special_symbols, r"$\cdot$ 项目", "-  项目".replace("  ", " ")),
    (L.clean_special_symbols, None, ""),
    (L.clean_special_symbols, "a\n\n\n\nb ( c )", "a\n\nb (c)"),
    (L.polish_readability, "+ / - 3\n| a  /  b |\n甲 / 乙", "+/- 3\n| a  /  b |\n甲/乙"),
    (L.polish_readability, "1,234 / 5,678 / 3.5%", "1,234，5,678，3.5%"),
    (L.polish_readability, "5% 6%  ，好", "5%、6%，好"),
    (L.clean_note_text, "甲\n12\n\n\n乙", "甲\n\n乙"),
    (L.clean_note_text, "甲\n二零二五年年报\n中国平安保险（集团）股份有限公司\n乙", "甲\n乙"),
    (L.normalize_lookup, "存款（定期）： A b", "存款(定期)ab"),
]


@pytest.mark.parametrize("f,value,wanted", CASES)
def test_clean(spark, f, value, wanted):
    assert one(spark, value, f) == wanted


ADDRESSES = [
    ("at 26.58.236.81 and", "at 26.58.236.81 and"),
    ("at 92.142.22.65, 12.345.67", "at 92.142.22.65, 12,345.67"),
    ("555-8050 68.66.253.95 7", "555-805068.66.253.957"),
    ("3. 12.345.67", "3.12,345.67"),
    ("12.345.67. 2025", "12,345.67.2025"),
    ("12.255.67 12.256.67.8", "12.255.6712.256.67.8"),
    ("12.256.67.8", "12,256.67.8"),
]


@pytest.mark.parametrize("value,wanted", ADDRESSES)
def test_addresses_are_no_amounts(spark, value, wanted):
    assert one(spark, value, L.clean_special_symbols) == wanted == L.plain_special_symbols(value)


NUMBERED = [
    ("Cash 202101\n31", "Cash 20210131"),
    ("Cash 2001012 \n\n 31 ", "Cash 200101231"),
    ("Cash 2 0 2 1\r\n0131", "Cash 20210131"),
    ("Cash 20210131\n31", "Cash 2021年1月31日 31"),
    ("on 2021\n0131 and\n7", "on 2021年1月31日 and\n7"),
    ("1,234,567\n31", "1,234,567"),
    ("1,234202101\n31", "1,234 / 2021年1月31日"),
    ("a\ufdd0b 3\n31", "a\ufdd0b 331"),
    ("20210131", "2021年1月31日"),
]


@pytest.mark.parametrize("value,wanted", NUMBERED)
def test_page_numbers_end_no_date(spark, value, wanted):
    assert one(spark, value, L.clean_page_symbols) == wanted


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="12345 0,.%年月日\n$\\{}^+ab中 ;:()", max_size=40), min_size=20, max_size=40))
def test_both_forms_of_cleaning_agree(texts):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is None:
        pytest.skip("no session yet")
    out = spark.createDataFrame(list(enumerate(texts)), "i int, v string").select("i", L.clean_special_symbols(F.col("v")).alias("x")).collect()
    assert {r["i"]: r["x"] for r in out} == {i: L.plain_special_symbols(t) for i, t in enumerate(texts)}


HTML = "<table><tr><td></td><td colspan='2'>2025年度</td></tr><tr><td></td><td>年初余额</td><td>年末余额</td></tr><tr><td>甲</td><td>1,000</td><td>2</td></tr><tr><td>乙</td><td>-</td><td>3</td></tr><tr><td></td><td>1,000</td><td>5</td></tr><tr><td></td><td>1,000</td><td>5</td></tr><tr><td></td><td></td><td></td></tr></table>"


def markdown(spark, *sources):
    """The Markdown of each source's first table."""
    rows = spark.createDataFrame(list(enumerate(sources)), "i int, t string").select("i", F.transform(B.grids(B.tables_of(F.col("t"))), B.grid_markdown)[0].alias("m"))
    return [r["m"] for r in rows.orderBy("i").collect()]


HTML_SHOWN = "| 项目 | 2025年度 / 年初余额 | 2025年度 / 年末余额 |\n|---|---|---|\n| 甲 | 1,000 | 2 |\n| 乙 | - | 3 |\n| 合计 | 1,000 | 5 |"


def test_table_with_merged_header(spark):
    assert markdown(spark, HTML) == [HTML_SHOWN]


def table(*rows):
    return "<table>" + "".join("<tr>" + "".join(c if c.startswith("<") else f"<td>{c}</td>" for c in row) + "</tr>" for row in rows) + "</table>"


def test_tables_of_many_shapes(spark):
    """Each shape with its Markdown, worked out by hand."""
    wide = "<td colspan='2'>年</td>"
    cases = {
        table(["a", "b"]): "| a | b |\n|---|---|",
        table(["a"], ["x"], [""], ["x"]): "| a |\n|---|\n| x |\n| x |",
        table(["", "本"], ["甲", "1"], ["乙", "2"]): "| 项目 | 本 |\n|---|---|\n| 甲 | 1 |\n| 乙 | 2 |",
        table(["", "本"], ["甲", "1"], ["", "2"], ["", "2"], ["", ""]): "|  | 本 |\n|---|---|\n| 甲 | 1 |\n| 合计 | 2 |",
        table(["k", wide], ["k", "甲", "乙"], ["x", "1", "2"]): "| k | 年 / 甲 | 年 / 乙 |\n|---|---|---|\n| x | 1 | 2 |",
        table(["<td rowspan='2'>k</td>", wide], ["甲", "乙"], ["x", "no", "value"]): "| k | 年 / 甲 | 年 / 乙 |\n|---|---|---|\n| x | no | value |",
        table([wide, "z"], ["1", "2", "3"]): "| 年 | 年 | z |\n|---|---|---|\n| 1 | 2 | 3 |",
        table(["a", "b"], ["S", ""], ["T", ""]): "| a | b |\n|---|---|\n| S |  |\n| T |  |",
        table(["a", "b"], ["r", "1"], ["S", ""], ["T", ""], ["u|v", "x<br> y"]): "| a | b |\n|---|---|\n| r | 1 |\n\n**T**\n| a | b |\n|---|---|\n| u\\|v | x / y |",
        "<table></table>": "",
    }
    assert dict(zip(cases, markdown(spark, *cases), strict=True)) == cases


def test_spans_and_short_rows():
    grid = B.table_grid("<TABLE><tr><th rowspan=2>a</th><td>b<br>c &amp; d</td></tr><tr><td>x|y</td><td>z</td></tr><tr><td>q</td></tr></TABLE>")
    assert [[c.text for c in row] for row in grid] == [["a", "b\nc & d", ""], ["", "x|y", "z"], ["q", "", ""]]
    assert [[c.is_anchor for c in row] for row in grid] == [[True, True, True], [False, True, True], [True, True, True]]
    assert grid[1][0].is_header and B.table_grid("<table></table>") == []


def test_sections_split_a_table(spark):
    rows = [("资产", ""), ("甲", "1"), ("负债", ""), ("乙|丙", "2")]
    source = "<table><tr><td>项</td><td>额</td></tr>" + "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in rows) + "</table>"
    assert markdown(spark, source)[0] == "**资产**\n| 项 | 额 |\n|---|---|\n| 甲 | 1 |\n\n**负债**\n| 项 | 额 |\n|---|---|\n| 乙\\|丙 | 2 |"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["", "a", "1,0"]), st.integers(1, 3), st.integers(1, 3)), max_size=4), max_size=4))
def test_grids_are_rectangles(rows):
    source = "<table>" + "".join("<tr>" + "".join(f'<td rowspan="{r}" colspan="{c}">{t}</td>' for t, r, c in row) + "</tr>" for row in rows) + "</table>"
    grid = B.table_grid(source)
    assert len({len(r) for r in grid}) <= 1
    assert sorted(c.text for r in grid for c in r if c.is_anchor and c.text) == sorted(t for row in rows for t, _, _ in row if t)


PAGES = "report_id string, page_idx int, text string, noise array<string>"


def test_clean_pages(spark):
    rows = [("r", 1, "某公司\n标题\n正文，很长。\n" + HTML + "<b>尾</b>句。", ["某公司"]), ("r", 2, None, None), ("r", 3, "12", None)]
    out = {r["page_idx"]: r["text"] for r in B.clean_pages(spark.createDataFrame(rows, PAGES)).collect()}
    assert out[1] == "正文，很长。\n\n" + HTML_SHOWN + "\n\n尾句。" and out[2] == "" and out[3] == ""


def test_tables_of_pages(spark):
    pages = spark.createDataFrame([("r", 3, f"目录{HTML}<table></table><table><tr><td>附注</td><td>27</td></tr></table>", None), ("r", 30, "<table><tr><td>附注</td><td>27</td></tr></table>", None)], PAGES)
    assert B.table_rows(pages).where("page_idx = 3").count() == 8 and B.table_cells(pages).where("table_no = 0").count() == 23
    (entry,) = B.html_toc_entries(pages).where("table_no = 1").collect()
    assert (entry["toc_page_idx"], entry["title"], entry["reported_page_no"]) == (3, "附注", 27)
