"""Hand-made cases of the text functions."""

import pytest
from pyspark.sql import functions as F

from pagesieve.functions import text as X
from pagesieve.operators import pages as P
from pagesieve.operators import themes as T
from pagesieve.operators import toc as C
from pagesieve.sources import files


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "f,value,wanted",
    [
        (X.collapse_spaced_number, "2 9 . 3 %", "29.3%"),
        (X.expand_compact_date, "20251231 and 20250101", "2025年12月31日 and 2025年1月1日"),
        (X.strip_tags, "a<b c>d</b>", "ad"),
        (X.is_value_like, "(1,234.5)", True),
        (X.is_value_like, "x1", False),
        (X.is_furniture, " 12 ", True),
        (X.is_furniture, "关于我们", True),
        (X.is_short_garble, "abcd", False),
        (X.is_short_garble, "ab 短", True),
        (X.clean_item_name, "*其中：存款*", "存款"),
        (X.clean_item_name, "加： 存  款", "存 款"),
        (X.strip, "　a　", "a"),
    ],
)
def test_text(spark, f, value, wanted):
    assert one(spark, value, f) == wanted


def test_references(spark):
    assert tuple(one(spark, "31(5)", X.parse_note_reference)) == ("31(5)", 31, "5")
    assert tuple(one(spark, "8/56(1)", X.parse_note_reference)) == ("8", 8, None)
    assert one(spark, "附注", X.parse_note_reference) is None
    assert tuple(one(spark, "\n| a |\n3.5 xxx", X.note_heading)) == (3, "5 xxx")
    assert tuple(one(spark, "12、保费（续）", X.note_heading)) == (12, "保费")
    assert one(spark, "存款（定期）", X.item_search_terms) == ["存款（定期）", "存款"]


def test_headings(spark):
    test = lambda c: X.matches_as_heading(c, ("合并利润表",))
    assert one(spark, "合并利润表\nx", test) and not one(spark, "x\n合并利润表", test)
    assert not one(spark, "目录\n合并利润表", test)
    assert not one(spark, "合并利润表 12\n附注 14\n", test)


def pages(spark, rows):
    return spark.createDataFrame(rows, "report_id string, page_idx int, text string")


def test_contents_formats(spark):
    forward = "目录\n管理层讨论与分析 3\n合并利润表 8\n财务报表附注 10"
    backward = "目录\n3 业绩综述\n8 合并利润表\n10 财务报表附注"
    two = "目录\n管理层讨论与分析 3\n合并利润表 8"
    found = C.toc_entries(pages(spark, [("f", 1, forward), ("b", 1, backward), ("t", 1, two), ("late", 21, forward)])).collect()
    assert sorted({r["report_id"] for r in found}) == ["b", "f"] and len(found) == 6
    ranges = C.toc_ranges(pages(spark, [("f", 1, forward), ("f", 36, "合并利润表"), ("f", 60, "")])).orderBy("pos").collect()
    assert [(r["start_page_idx"], r["end_page_idx"]) for r in ranges] == [(31, 35), (36, 37), (38, 60)]


def test_span_is_repaired(spark):
    toc = spark.createDataFrame([("r", 0, "合并资产负债表", 5, 4, 9), ("r", 1, "其他", 5, 6, 9), ("r", 2, "附录", 7, 9, 9)], "report_id string, pos int, title string, start_page_idx int, end_page_idx int, last_page_idx int")
    assert [tuple(r) for r in C.toc_spans(toc).collect()] == [("r", "balance-sheet", 5, 6)]


def test_pages_do_not_depend_on_row_order(spark):
    rows = [("r", i, i // 2, "title" if i % 2 else "text", None, f"t{i}", None, None, None) for i in range(6)]
    schema = "report_id string, seq int, page_idx int, type string, category string, text string, table_body string, code_body string, list_items array<string>"
    a, b = (P.items_to_pages(spark.createDataFrame(x, schema)).orderBy("page_idx").collect() for x in (rows, rows[::-1]))
    assert a == b and a[0]["markdown"] == "t0\n\n## t1"


def test_slim_theme_marks_hits(spark):
    p = pages(spark, [("r", i, "利率" if i == 2 else f"p{i}") for i in range(5)])
    near = T.context_pages(T.theme_hits(p, ["利率"]))
    text = T.assemble_slim(p.join(near, ["report_id", "page_idx"])).first()["markdown"]
    assert text == "<!-- page: 1 -->\np1\n\n---\n\n<!-- page: 2 [hit] -->\n利率\n\n---\n\n<!-- page: 3 -->\np3"


def test_files(spark, tmp_path):
    (tmp_path / "a年报.pages.json").write_text('{"source_pdf": "a", "num_pages": 1, "pages": [{"page_idx": 0, "text": "x", "markdown": "x", "matched_tags": []}]}')
    (tmp_path / "b.json").write_text('[{"page_idx": 1, "type": "text", "text": "t"}, {"type": "title", "text": "u"}]')
    assert files.read_pages(spark, f"{tmp_path}/a*.json").count() == 1
    items = files.read_content_items(spark, f"{tmp_path}/b.json").orderBy("seq").collect()
    assert [(r["report_id"], r["page_idx"], r["text"]) for r in items] == [("b", 1, "t"), ("b", 0, "u")]
