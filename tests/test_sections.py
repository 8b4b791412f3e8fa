"""Hand-made reports for sections, notes and the documents made of them."""

import re

from pyspark.sql import functions as F

from pagesieve.config import SECTIONS, Theme, section
from pagesieve.operators import notes as N
from pagesieve.operators import pages as P
from pagesieve.operators import sections as S
from pagesieve.plans import jobs
from pagesieve.sources import files


def pages(spark, *reports):
    return spark.createDataFrame([(name, i, t) for name, rows in reports for i, t in rows], "report_id string, page_idx int, text string")


TOC = "目录\n管理层讨论与分析 3\n合并资产负债表 6\n合并利润表 8\n财务报表附注 10"


NO_TITLES = "目录\n公司简介 3\n重要提示 6\n其他 8"


def spans(frame, **options):
    return {(r["report_id"], r["section"]): (r["start_page_idx"], r["end_page_idx"], r["fallback_used"]) for r in S.section_spans(frame, **options).collect()}


def test_confirmed_spans_and_scans(spark):
    good = [(1, TOC), (3, "管理层讨论与分析"), (6, "合并资产负债表"), (8, "合并利润表"), (9, "x"), (10, "财务报表附注"), (12, "末")]
    # numbers of the contents are of no use here: the body is scanned
    dual = [(1, NO_TITLES), (30, "管理层讨论与分析\n好"), (31, "表\n见 内含价值"), (32, "公司治理"), (40, "审计报告 合并资产负债表"), (41, "合并资产负债表"), (43, "合并利润表"), (50, "合并现金流量表"), (60, "财务报表附注"), (70, "末")]
    frame = pages(spark, ("g", good), ("d", dual), ("none", [(1, "没有"), (2, "合并资产负债表")]))
    found = spans(frame)
    assert found["g", "balance-sheet"] == (6, 7, False) and found["g", "financial-notes"] == (10, 12, False)
    assert found["d", "management-discussion"] == (30, 31, True) and found["d", "balance-sheet"] == (41, 42, True)
    assert found["d", "income-statement"] == (43, 49, True) and found["d", "financial-notes"] == (60, 70, True)
    assert not any(r == "none" for r, _ in found) and spans(frame, require_toc=False)["none", "balance-sheet"] == (2, 2, True)
    assert spans(frame, most=2)["g", "financial-notes"] == (10, 11, False)
    missing = S.missing_sections(frame, S.section_spans(frame)).where("report_id = 'none'").count()
    assert missing == len(SECTIONS)


def test_scan_starts_from_the_sub_table(spark):
    rows = [(1, NO_TITLES), (50, "合并及公司资产负债表 126\n合并利润表 P9"), (55, "合并资产负债表"), (60, "合并利润表")]
    rows2 = [(1, NO_TITLES), (50, "合并及公司资产负债表 55\n合并利润表 60"), (52, "x"), (55, "资产"), (60, "合并利润表")]
    found = spans(pages(spark, ("p", rows), ("a", rows2)))
    assert found["a", "balance-sheet"] == (55, 59, True) and found["p", "balance-sheet"][0] == 176  # relative numbers count from their page


def test_free_titles(spark):
    frame = pages(spark, ("r", [(1, "目录\nNotes (a) 3\nOther b 5\nThird + c 7"), (4, "x")]))
    found = spans(frame, sections={"Notes (a)": section("Notes (a)"), "third +": section("third +")})
    assert found == {("r", "Notes (a)"): (3, 4, False), ("r", "third +"): (7, 4, False)} or found["r", "Notes (a)"] == (3, 4, False)


def test_note_windows(spark):
    a = [(3, "目录 财务报表附注"), (30, "财务报表附注"), (31, "x"), (35, "受托业务"), (40, "末")]
    table = "<table><tr><td>财务报表附注</td><td>30</td></tr><tr><td>附录 财务报表补充资料</td><td>33</td></tr></table>"
    b = [(3, "目录" + table), (26, "x"), (38, "y"), (39, "z")]
    frame = pages(spark, ("a", a), ("b", b), ("c", [(1, "x")]))
    found = {r["report_id"]: (r["start_page_idx"], r["end_page_idx"]) for r in S.note_windows(frame, ["财务报表附注"], ["受托业务"]).collect()}
    assert found == {"a": (30, 31), "b": (26, 38)}
    assert {r["report_id"] for r in jobs.missing_windows(frame, S.note_windows(frame)).collect()} == {"c"}


def test_theme_results(spark, tmp_path):
    rows = [(3, "目录 财务报表附注"), (4, "利率风险"), (30, "财务报表附注 利率风险"), (31, "利率风险"), (35, "受托业务 利率风险")]
    themes = {"balance-sheet": Theme(("x",), ("财务报表附注",), ("受托业务",)), "rates": Theme(("利率风险",))}
    frame = pages(spark, ("r", rows), ("none", [(0, "x")]))
    (row,) = jobs.theme_results(frame, "rates", themes, scope="notes").collect()
    assert [h["page_idx"] for h in row["hits"]] == [30, 31] and tuple(row["note_window"]) == (30, 31) and len(row["hit_windows"]) == 1
    files.write_theme_results(jobs.theme_results(frame, "rates", themes), f"{tmp_path}/themes")
    assert spark.read.json(f"{tmp_path}/themes").count() == 2


def test_note_headings_without_title(spark):
    from pagesieve.functions.text import note_heading

    row = spark.createDataFrame([("12、（续）\n13、货币",)], "t string").select(note_heading(F.col("t")).alias("h")).first()
    assert tuple(row["h"]) == (13, "货币")


def test_reports_without_references_keep_all_pages(spark):
    frame = pages(spark, ("a", [(1, "x"), (2, "y")]), ("b", [(5, "2. 甲"), (6, "3. 乙")]))
    refs = spark.createDataFrame([("b", None, [3], 2)], "report_id string, main_section string, sub_notes array<int>, first_bs_note int")
    assert sorted((r["report_id"], r["page_idx"]) for r in N.referenced_pages(frame, refs).collect()) == [("a", 1), ("a", 2), ("b", 6)]


BALANCE = "| 资产 | 附注 | 本年 | 上年 |\n|---|---|---|---|\n| 货币资金 | 1 | 1,234 | 99 |\n| 存款 | 31(5) | 777 | 888 |\n| 投资（债券） | 7 | 4,321 | 5,555 |\n| 其他 | 9 | 6 | 7 |"
INCOME = "| 项目 | 附注 | 本年 |\n|---|---|---|\n| 保费 | 1 | 3 |"
NOTES = "<!-- page: 8 -->\n前言\n\n1、货币资金\n\n现金\n\n<!-- page: 9 -->\n没有标题 4,321 和 5,555\n\n<!-- page: 10 -->\n31. 存款\n\n（4）活期\n\n甲\n\n（5）定期\n\n<!-- page: 11 -->\n31. 存款（续）\n\n乙\n\n（6）别的\n"


def statements(spark):
    return spark.createDataFrame([("r", "balance_sheet", BALANCE), ("r", "income_statement", INCOME)], "report_id string, statement string, markdown string")


def test_statement_notes(spark):
    docs, stats = jobs.statement_notes(statements(spark), spark.createDataFrame([("r", NOTES)], "report_id string, markdown string"))
    assert stats.first().asDict() == {"report_id": "r", "groups": 5, "matched": 4, "unmatched": 1, "note_blocks": 10, "unassigned": 1}
    out = {r["statement"]: r["markdown"] for r in docs.collect()}
    balance = out["balance_sheet"]
    assert balance.startswith("# 合并资产负债表及对应财务报表附注\n\n## 原始主表\n\n" + BALANCE + "\n\n## 对应附注\n\n### 附注 1 货币资金\n\n对应主表科目：货币资金\n\n<!-- page: 8 -->\n\n前言\n\n1、货币资金\n\n现金\n\n### 附注 31(5) 定期")
    assert "### 附注 31(5) 定期\n\n对应主表科目：存款\n\n<!-- page: 10 -->\n\n31. 存款\n\n（5）定期\n\n<!-- page: 11 -->\n\n31. 存款（续）\n\n乙\n\n### 附注 7" in balance
    assert "### 附注 7 投资（债券）\n\n对应主表科目：投资（债券）\n\n<!-- page: 9 -->\n\n没有标题 4,321 和 5,555" in balance
    assert balance.endswith(f"### 附注 9 其他\n\n对应主表科目：其他\n\n{N.REVIEW}\n")
    assert out["income_statement"].count("###") == 1


def test_scores(spark):
    groups = N.group_refs(N.statement_note_refs(statements(spark)))
    blocks = spark.createDataFrame([("r", 0, 1, None, None, "投 资 的说明"), ("r", 1, 1, None, None, "只有 777"), ("r", 2, 1, 3, None, "投资")], "report_id string, block_id int, page_idx int, note_no int, title string, text string")
    assert [(r["note_key"], r["block_id"], r["score"]) for r in N.scored_blocks(groups, blocks).collect()] == [("7", 0, 14)]


def test_section_and_notes_documents(spark):
    rows = [(0, "某某保险股份有限公司"), (1, TOC), (6, "合并资产负债表\n某某保险股份有限公司\n" + BALANCE), (8, "合并利润表\n" + INCOME), (10, "财务报表附注\n1、货币资金"), (11, "2、别的"), (12, "7. 投资")]
    frame = pages(spark, ("r", rows))
    slim = jobs.section_slim(frame)
    docs = {r["section"]: r for r in slim.collect()}
    assert docs["balance-sheet"]["markdown"] == "<!-- page: 6 -->\n" + BALANCE and docs["balance-sheet"]["pages"] == 1
    notes = jobs.notes_slim(frame, jobs.statements_of(slim)).first()
    assert [x for x in (10, 11, 12) if f"page: {x} " in notes["markdown"]] == [10, 12]


def test_files_of_documents(spark, tmp_path):
    docs = spark.createDataFrame([("a", "balance", "x\ny")], "report_id string, kind string, markdown string")
    files.write_slim_docs(docs, f"{tmp_path}/slim")
    assert spark.read.parquet(f"{tmp_path}/slim").first()["kind"] == "balance"
    (tmp_path / "a.slim.balance_sheet.md").write_text("x\ny")
    assert tuple(files.read_slim_docs(spark, f"{tmp_path}/*.md").first()) == ("a", "x\ny")
    frame = pages(spark, ("r", [(1, TOC), (9, "x")]))
    toc = files.toc_documents(jobs.toc_scan(frame))
    files.write_json(toc, f"{tmp_path}/toc")
    assert spark.read.json(f"{tmp_path}/toc").first()["num_entries"] == 4
    files.write_pages(frame, f"{tmp_path}/pages")
    assert spark.read.parquet(f"{tmp_path}/pages").count() == 2
    noise = P.report_noise(pages(spark, ("r", [(0, "某保险股份有限公司")])))
    assert P.without_noise_lines(pages(spark, ("r", [(5, "某保险股份有限公司\n正文\n12")])), noise).first()["text"] == "正文"


def test_stored_reports_are_not_written_again(spark, tmp_path):
    """A second run writes only what is pending, and nothing if nothing is; groups and joins on report_id need no exchange."""
    frame = pages(spark, *[(f"r{i}", [(0, "某某保险股份有限公司"), (1, TOC), (6, f"合并资产负债表 {i}")]) for i in range(12)])
    name, where = "stored_reports", f"{tmp_path}/stored"
    written = lambda: sorted(p.name for p in (tmp_path / "stored").iterdir())
    assert files.stored_pages(spark, name) is None
    assert files.store_pages(frame.where("report_id < 'r5'"), name, 4, path=where) == 7
    first = written()
    assert files.store_pages(frame.where("report_id < 'r5'"), name, 4, path=where) == 0 and written() == first
    assert files.store_pages(frame, name, 4, path=where) == 5 and set(first) < set(written())
    stored = files.stored_pages(spark, name)
    assert sorted(map(tuple, stored.select(*frame.columns).collect())) == sorted(map(tuple, frame.collect()))
    docs = stored.groupBy("report_id").agg(F.count("*").alias("n")).join(stored.select("report_id", "text"), "report_id")
    assert "Exchange" not in docs.hint("shuffle_hash")._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    assert P.pending_reports(frame.select("report_id").distinct(), stored).count() == 0
    spark.sql(f"DROP TABLE {name}")


def test_page_range(spark):
    frame = pages(spark, ("a", [(1, "x"), (3, "y"), (9, "z")]), ("b", [(2, "x")]))
    spans = spark.createDataFrame([("a", 2, 9)], "report_id string, start_page_idx int, end_page_idx int")
    assert sorted((r["report_id"], r["page_idx"]) for r in P.page_range(frame, spans).collect()) == [("a", 3), ("a", 9)]


def test_mixed_contents_page(spark):
    """Lines of both kinds and table rows on one page: each format counts by itself, repeated entries once."""
    table = "<table><tr><td>公司简介</td><td>4</td></tr><tr><td>合并利润表</td><td>8</td></tr></table>"
    text = f"目录\n管理层讨论与分析 3\n合并资产负债表 6\n合并利润表 8\n10 财务报表附注\n12 补充资料\n14 附录\n{table}"
    frame = pages(spark, ("m", [(1, text), (40, "合并利润表"), (60, "末")]))
    toc = [(r["title"], r["reported_page_no"], r["start_page_idx"], r["end_page_idx"]) for r in jobs.toc_scan(frame).orderBy("pos").collect()]
    assert toc == [("管理层讨论与分析", 3, 35, 35), ("公司简介", 4, 36, 37), ("合并资产负债表", 6, 38, 39), ("合并利润表", 8, 40, 41), ("财务报表附注", 10, 42, 43), ("补充资料", 12, 44, 45), ("附录", 14, 46, 60)]


def test_spans_are_repaired(spark):
    """Two entries on one page give a span that ends before it starts; later entries mend it."""
    merged = [(1, "目录\n经营业绩 3\n经营分析 5\n公司治理 5\n其他 9"), (3, "经营业绩回顾与分析"), (5, "公司治理"), (20, "末")]
    single = [(1, "目录\n合并资产负债表 6\n合并利润表 6\n其他 9"), (6, "合并资产负债表"), (20, "末")]
    found = spans(pages(spark, ("m", merged), ("s", single)))
    assert found["m", "management-discussion"] == (3, 4, False) and found["s", "balance-sheet"] == (6, 8, False)


def test_section_plan_reads_pages_twice(spark, tmp_path):
    """Two scans, at most three exchanges, one join, and each cleaning rule once."""
    pages(spark, ("r", [(1, TOC), (6, "合并资产负债表")])).write.parquet(f"{tmp_path}/pages")
    plan = jobs.section_documents(spark.read.parquet(f"{tmp_path}/pages"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("Exchange hashpartitioning") <= 3 and len(re.findall(r"[+:]- .*Join", plan)) == 1
    assert plan.count(r"(20\d{2})\1年") == 1


def test_theme_plan_cleans_once(spark, tmp_path):
    from pagesieve.operators import themes as T

    pages(spark, ("r", [(1, TOC)])).write.parquet(f"{tmp_path}/pages")
    hits = T.hits_of_themes(spark.read.parquet(f"{tmp_path}/pages"), {f"t{i}": (f"词{i}", "共同") for i in range(10)})
    plan = T.top_hits(hits, by=("report_id", "theme"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count(r"(20\d{2})\1年") == 1 and plan.count("FileScan") == 1


def test_words_within_words(spark):
    from pagesieve.operators import themes as T

    words = ("保险", "保险服务", "保险服务收入", "服务", "收入", "a.b", "b")
    rows = spark.createDataFrame([("保险服务收入",), ("保险收入",), ("服务a.b",), ("axb",), ("",)], "t string")
    found = [sorted(r["w"]) for r in rows.select(T.found_words(F.col("t"), words).alias("w")).collect()]
    assert found == [sorted(w for w in words if w in t["t"]) for t in rows.collect()]
