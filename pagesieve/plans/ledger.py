"""Queries over the ledger reports: whole jobs from pages to statements with their notes. Their SQL follows the pages one by one (recursion) and
tests every pair, where the jobs use windows and arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Theme
from ..functions import cleaning as L
from ..operators import notes as N
from . import jobs
from .queries import LOCATED_SQL, RANGES_SQL, SPANS_SQL, VERIFIED_SQL, query, stripped_sql
from .standins import LEDGER_SQL, grouped, ledger_pages, read
from .store import stored

_BREAK = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
#: Tables of the ledger pages as cleaning shows them; their other texts are clean.
_CLEAN = "regexp_replace(replace(replace(replace(replace(text, '<table><tr><td>', '| '), '</td></tr><tr><td>', ' |' || chr(10) || '|---|---|' || chr(10) || '| '), '</td></tr></table>', ' |'), '</td><td>', ' | '), '[^\\S\\n]{2,}', ' ', 'g')"
_SLIM = f"""inside AS (
  SELECT p.report_id, section, page_idx, text AS raw, {_CLEAN} AS text FROM pages p JOIN located v ON v.report_id = p.report_id AND page_idx BETWEEN start_page_idx AND end_page_idx WHERE text <> ''
), slim AS (
  SELECT report_id, section, string_agg('<!-- page: ' || page_idx || ' -->' || chr(10) || text, {_BREAK} ORDER BY page_idx) AS markdown, count(*) AS pages FROM inside GROUP BY ALL
)"""
_BASE = f"WITH RECURSIVE {LEDGER_SQL}, {RANGES_SQL}, {SPANS_SQL}, {VERIFIED_SQL}, {LOCATED_SQL}, {_SLIM}"
_NUMERALS = "['" + "', '".join(N.NUMERALS) + "']"
_ONES = "|".join(sorted(N.NUMERALS, key=len, reverse=True))
_REFSET = f"""docs AS (
  SELECT report_id, CASE section WHEN 'balance-sheet' THEN 0 ELSE 1 END AS seq, CASE section WHEN 'balance-sheet' THEN 'balance_sheet' ELSE 'income_statement' END AS statement, markdown FROM slim WHERE section IN ('balance-sheet', 'income-statement')
), numbered AS (
  SELECT *, list_filter(list_transform(regexp_extract_all(markdown, '\\|\\s*([0-9]{{1,2}})(?:[/\\s（(]|\\s*\\|)', 1), lambda x: cast(x AS int)), lambda x: x BETWEEN 1 AND 99) AS numbers, nullif(regexp_extract(markdown, '附注([一二三四五六七八九十]+)', 1), '') AS main,
         seq = 0 OR contains(substring(markdown, 1, 200), '资产负债表') AS is_bs FROM docs
), raised AS (
  SELECT report_id, arg_min(main, seq) FILTER (main IS NOT NULL) AS main, list_sort(list_distinct(flatten(list(numbers)))) AS every, arg_min(numbers[1], seq) FILTER (is_bs AND len(numbers) > 0) AS first_bs FROM numbered GROUP BY 1
), refset AS (SELECT report_id, main, first_bs, CASE WHEN main IS NULL AND first_bs > 3 THEN list_filter(every, lambda x: x >= first_bs) ELSE every END AS subs FROM raised)"""
#: Page after page: whether the main section has begun and has ended, and the note so far.
_TRACKED = f"""own AS (
  SELECT report_id, page_idx, raw, text, row_number() OVER (PARTITION BY report_id ORDER BY page_idx) AS rn FROM inside WHERE section = 'financial-notes'
), signs AS (
  SELECT o.*, main, subs, first_bs, main IS NULL OR contains(substring(raw, 1, 60), main || '、') AS opens, coalesce(contains(array_to_string(string_split(raw, chr(10))[1:3], chr(10)), {_NUMERALS}[list_position({_NUMERALS}, main) + 1] || '、'), false) AS closes,
         coalesce(CASE WHEN main IS NULL THEN nullif(list_position({_NUMERALS}, regexp_extract(substring(raw, 1, 60), '(?:^|\\n)({_ONES})[、.]', 1)), 0) END, try_cast(regexp_extract(substring(raw, 1, 200), '[（(]续[）)].*?([0-9]{{1,2}})[、.\\s]', 1) AS int),
           try_cast(regexp_extract(substring(raw, 1, 500), '(?:^|\\n)\\s*([0-9]{{1,2}})[、.\\s]', 1) AS int)) AS said, starts_with(ltrim(raw), '<table>') AS is_table
  FROM own o JOIN refset USING (report_id) WHERE len(subs) > 0
), tracked AS (
  SELECT report_id, cast(0 AS bigint) AS rn, false AS inside, false AS done, cast(NULL AS int) AS now, false AS kept FROM signs WHERE rn = 1
  UNION ALL SELECT report_id, rn, inside, done, now, inside AND NOT done AND now IS NOT NULL AND list_contains(subs, now) FROM (
    SELECT *, CASE WHEN inside AND NOT done AND main IS NULL AND first_bs IS NOT NULL AND (turned IS NULL OR turned < first_bs) AND is_table THEN first_bs ELSE turned END AS now FROM (
      SELECT s.report_id, s.rn, s.subs, s.main, s.first_bs, s.is_table, t.inside OR s.opens AS inside, t.done OR ((t.inside OR s.opens) AND s.closes) AS done,
             cast(coalesce(CASE WHEN t.inside OR s.opens THEN s.said END, CASE WHEN NOT t.inside AND s.opens AND s.main IS NOT NULL THEN list_min(s.subs) ELSE t.now END) AS int) AS turned
      FROM tracked t JOIN signs s ON s.report_id = t.report_id AND s.rn = t.rn + 1))
), note_pages AS (
  SELECT report_id, page_idx, text FROM own WHERE (report_id, rn) IN (SELECT (report_id, rn) FROM tracked WHERE kept) OR report_id NOT IN (SELECT report_id FROM signs)
)"""
_NOTES = f"{_BASE}, {_REFSET}, {_TRACKED}"


def _pages(spark, sf_dir):
    """The ledger reports as a stored page table."""
    return stored(ledger_pages(spark, sf_dir))


def _statements(pages):
    return stored(jobs.statements_of(jobs.section_slim(pages)))


@query(f"{_BASE} SELECT report_id, section, start_page_idx, end_page_idx, fallback_used, pages, markdown FROM slim JOIN located USING (report_id, section)")
def ledger_sections(spark, sf_dir):
    """Sections whose statements the contents or a statement table names, with HTML tables."""
    return jobs.section_slim(_pages(spark, sf_dir)).drop("chars", "est_tokens", "matched_titles")


@query(f"{_BASE}, {_REFSET} SELECT report_id, main AS main_section, array_to_string(subs, ',') AS sub_notes, first_bs AS first_bs_note FROM refset")
def ledger_ref_set(spark, sf_dir):
    docs = _statements(_pages(spark, sf_dir))
    bs = F.col("statement") == "balance_sheet"
    refs = N.note_ref_set(docs.select("report_id", F.when(bs, 0).otherwise(1).alias("seq"), "markdown", (bs | F.substring("markdown", 1, 200).contains("资产负债表")).alias("is_bs")))
    return refs.withColumn("sub_notes", F.array_join(F.col("sub_notes").cast("array<string>"), ","))


@query(f"{_NOTES} SELECT report_id, 'financial-notes' AS section, string_agg('<!-- page: ' || page_idx || ' -->' || chr(10) || text, {_BREAK} ORDER BY page_idx) AS markdown, count(*) AS pages FROM note_pages GROUP BY report_id")
def notes_slim(spark, sf_dir):
    """The notes that the statements refer to: with and without a main section, low first notes, pages that start with a table, no references."""
    pages = _pages(spark, sf_dir)
    return jobs.notes_slim(pages, _statements(pages)).drop("chars", "est_tokens")


_HEAD = "^([0-9]{1,2})(?:[.、]|\\s+)([^\\n]{1,80})$"
_SUB = "^[（(]([0-9]{1,2})[）)]\\s*(.+)?$"
_TITLE = f"trim(regexp_replace(regexp_extract(x, '{_HEAD}', 2), '\\s*[（(]续[）)]\\s*$', ''))"
_PLAIN = "lower(regexp_replace(translate({0}, '（）', '()'), '[：:·•,，。；;、\\s-]+', '', 'g'))"
_REF = "^([0-9]{1,2})(?:\\s*[（(]([0-9]{1,2})[）)])?"
#: A page of a document ends with the rule before the next one, which is a block too.
_MATCHED = f"""lines AS (
  SELECT report_id, statement, generate_subscripts(l, 1) AS line_no, list_transform(string_split(unnest(l), '|'), lambda x: {stripped_sql("x")}) AS c
  FROM (SELECT report_id, statement, list_filter(string_split(markdown, chr(10)), lambda x: starts_with(x, '| ') AND len(string_split(x, '|')) = 6) AS l FROM docs)
), refs AS (
  SELECT report_id, statement, line_no, regexp_replace(c[2], '^(?:其中|加|减)[:：]', '') AS item, cast(regexp_extract(c[3], '{_REF}', 1) AS int) AS note_no, nullif(regexp_extract(string_split(c[3], '/')[1], '{_REF}', 2), '') AS sub, nullif(c[4], '') AS cur, nullif(c[5], '') AS prior
  FROM lines WHERE NOT contains(c[3], '附注') AND regexp_matches(string_split(c[3], '/')[1], '{_REF}')
), groups AS (
  SELECT report_id, statement, note_no || coalesce('(' || sub || ')', '') AS note_key, note_no, sub, min(line_no) AS place, list(item ORDER BY line_no) AS items, list_filter(flatten(list([cur, prior] ORDER BY line_no)), lambda x: x IS NOT NULL AND x <> '-') AS amounts,
         flatten(list([item, regexp_replace(item, '[（(][^()（）]{{0,40}}[)）]', '', 'g')] ORDER BY line_no)) AS terms FROM refs GROUP BY ALL
), pieces AS (
  SELECT report_id, page_idx, generate_subscripts(b, 1) AS pos, {stripped_sql("unnest(b)")} AS text FROM (SELECT *, string_split_regex(text || CASE WHEN page_idx < max(page_idx) OVER (PARTITION BY report_id) THEN {_BREAK} ELSE '' END, '\\n{{2,}}') AS b FROM note_pages)
), headed AS (
  SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY page_idx, pos) - 1 AS block_id, page_idx = min(page_idx) OVER (PARTITION BY report_id) AS first,
         list_filter(list_transform(string_split(text, chr(10))[1:8], lambda x: {stripped_sql("x")}), lambda x: NOT starts_with(x, '|') AND NOT starts_with(x, '**') AND regexp_matches(x, '{_HEAD}') AND {_TITLE} <> '')[1] AS x
  FROM pieces WHERE text <> ''
), told AS (
  SELECT *, try_cast(regexp_extract(x, '{_HEAD}', 1) AS int) AS own, CASE WHEN x IS NOT NULL THEN {_TITLE} END AS own_title, bool_or(x IS NOT NULL) OVER (PARTITION BY report_id, page_idx) AS page_headed FROM headed
), assigned AS (
  SELECT report_id, block_id, page_idx, text, own IS NOT NULL AS is_head,
         coalesce(CASE WHEN page_headed THEN (SELECT arg_max(b.own, b.block_id) FROM told b WHERE b.report_id = a.report_id AND b.block_id <= a.block_id AND b.own IS NOT NULL) END,
           CASE WHEN first AND NOT EXISTS (SELECT 1 FROM told b WHERE b.report_id = a.report_id AND b.block_id <= a.block_id AND b.own IS NOT NULL) THEN (SELECT min(note_no) FROM refs r WHERE r.report_id = a.report_id) END) AS note_no,
         (SELECT arg_max(b.own_title, b.block_id) FROM told b WHERE b.report_id = a.report_id AND b.page_idx = a.page_idx AND b.block_id <= a.block_id AND b.own IS NOT NULL) AS title,
         list_filter(list_transform(string_split(text, chr(10))[1:8], lambda x: {stripped_sql("x")}), lambda x: regexp_matches(x, '{_SUB}'))[1] AS mark
  FROM told a
), marked AS (
  SELECT *, nullif(regexp_extract(mark, '{_SUB}', 1), '') AS sub_own, nullif(trim(regexp_extract(mark, '{_SUB}', 2)), '') AS sub_named FROM assigned
), ruled AS (
  SELECT *, (SELECT arg_max(b.sub_own, b.block_id) FROM marked b WHERE b.report_id = m.report_id AND b.note_no = m.note_no AND b.block_id <= m.block_id AND b.sub_own IS NOT NULL) AS sub_now,
         block_id = min(block_id) OVER (PARTITION BY report_id, note_no) AS note_first FROM marked m
), pairs AS (
  SELECT g.report_id, statement, note_key, block_id FROM groups g JOIN ruled b ON b.report_id = g.report_id AND b.note_no = g.note_no
  WHERE g.sub IS NULL OR sub_now = g.sub OR (note_first AND is_head) OR NOT EXISTS (SELECT 1 FROM ruled o WHERE o.report_id = g.report_id AND o.note_no = g.note_no AND o.sub_now = g.sub)
  UNION SELECT g.report_id, statement, note_key, block_id FROM groups g JOIN ruled b ON b.report_id = g.report_id AND b.note_no IS NULL
  WHERE coalesce(list_max([12 + least(length({_PLAIN.format("t")}), 12) FOR t IN g.terms IF contains({_PLAIN.format("b.text")}, {_PLAIN.format("t")})]), 0) + 4 * len(list_filter(list_distinct(g.amounts), lambda a: contains(b.text, a))) >= 8
), shown AS (
  SELECT *, lag(page_idx) OVER (PARTITION BY report_id, statement, note_key ORDER BY block_id) AS page_before FROM pairs JOIN ruled USING (report_id, block_id)
), bodies AS (
  SELECT report_id, statement, note_key, string_agg(CASE WHEN page_before IS DISTINCT FROM page_idx THEN '<!-- page: ' || page_idx || ' -->' || chr(10) || chr(10) ELSE '' END || text, chr(10) || chr(10) ORDER BY block_id) AS body FROM shown GROUP BY ALL
), titled AS (
  SELECT g.*, body, coalesce((SELECT arg_max(sub_named, block_id) FROM ruled b WHERE b.report_id = g.report_id AND b.note_no = g.note_no AND b.sub_own = g.sub AND block_id = (SELECT max(block_id) FROM ruled c WHERE c.report_id = g.report_id AND c.note_no = g.note_no AND c.sub_own = g.sub)),
    (SELECT arg_min(title, block_id) FROM ruled b WHERE b.report_id = g.report_id AND b.note_no = g.note_no AND title IS NOT NULL), items[1]) AS name
  FROM groups g LEFT JOIN bodies USING (report_id, statement, note_key)
)"""


def _matched(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    statements = _statements(pages)
    return jobs.statement_notes(statements, stored(jobs.notes_slim(pages, statements)))


@query(f"""{_NOTES}, {_MATCHED}, parts AS (
  SELECT report_id, statement, string_agg(chr(10) || chr(10) || '### 附注 ' || note_key || ' ' || name || chr(10) || chr(10) || '对应主表科目：' || array_to_string(items, '；') || chr(10) || chr(10) || coalesce(body, '{N.REVIEW}'), '' ORDER BY place) AS part FROM titled GROUP BY ALL
) SELECT report_id, statement, '# ' || CASE statement WHEN 'balance_sheet' THEN '合并资产负债表' ELSE '合并利润表' END || '及对应财务报表附注' || chr(10) || chr(10) || '## 原始主表' || chr(10) || chr(10) || markdown || chr(10) || chr(10) || '## 对应附注' || coalesce(part, '') || chr(10) AS markdown FROM docs LEFT JOIN parts USING (report_id, statement)""")
def statement_notes(spark, sf_dir):
    """Statements with their notes, from pages through all jobs: several blocks a page, references to subsections, blocks that fit by amounts or by name, two groups even."""
    return _matched(spark, sf_dir)[0]


@query(f"""{_NOTES}, {_MATCHED} SELECT report_id, groups, matched, groups - matched AS unmatched, note_blocks, unassigned
FROM (SELECT report_id, count(*) AS groups, count(body) AS matched FROM titled GROUP BY 1) FULL JOIN (SELECT report_id, count(note_no) AS note_blocks, count(*) FILTER (note_no IS NULL) AS unassigned FROM ruled GROUP BY 1) USING (report_id)""")
def ledger_note_stats(spark, sf_dir):
    return _matched(spark, sf_dir)[1]


#: Two amounts of each line item as a parser leaves them, by form: glued, glued to a share, in a formula, a compact date behind an amount, letters apart.
_AMOUNTS = f"SELECT l_orderkey, l_linenumber, {grouped('a')} AS a, {grouped('b')} AS b, b % 90 + 10 AS share, b % 28 + 1 AS day, 2000 + b % 99 AS year, f FROM (SELECT l_orderkey, l_linenumber, cast(floor(l_extendedprice) AS bigint) * 1000 + 1511 AS a, cast(l_partkey AS bigint) * 7919 + 1000 AS b, (l_orderkey + l_linenumber) % 5 AS f FROM {{lineitem}})"
_GLUED = "CASE f WHEN 0 THEN 'Sum ' || a || b || ' in all' WHEN 1 THEN a || share || '.5%' WHEN 2 THEN 'of $' || substring(cast(share AS string), 1, 1) || ' ' || substring(cast(share AS string), 2, 1) || ' . 5 \\\\%$ now' WHEN 3 THEN a || cast(year AS string) || '12' || lpad(cast(day AS string), 2, '0') || ' x' ELSE '$T o t a l$ ' || a END"
_FREED = "CASE f WHEN 0 THEN 'Sum ' || a || '，' || b || ' in all' WHEN 1 THEN a || '，' || share || '.5%' WHEN 2 THEN 'of ' || share || '.5% now' WHEN 3 THEN a || '，' || year || '年12月' || day || '日 x' ELSE 'Total ' || a END"


@query(f"WITH amounts AS ({_AMOUNTS.format(lineitem='lineitem')}) SELECT l_orderkey, l_linenumber, {_FREED} AS text FROM amounts")
def ocr_residue(spark, sf_dir):
    """Amounts that were glued, apart or in formulas, cleaned and polished, one text for each line item."""
    rows = spark.sql(_AMOUNTS, lineitem=read(spark, sf_dir, "lineitem")).selectExpr("l_orderkey", "l_linenumber", f"{_GLUED} AS text")
    return rows.select("l_orderkey", "l_linenumber", L.polish_readability(L.clean_special_symbols(F.col("text"))).alias("text"))


_THEMES = {"income": Theme(("保险收入", "利息收入", "heading")), "balance-sheet": Theme(("货币资金",), ("财务报表附注",), ("财务报表补充资料",))}


@query(f"""WITH {LEDGER_SQL}, bounds AS (
  SELECT p.report_id, s, coalesce(min(CASE WHEN page_idx > s AND contains(text, '财务报表补充资料') AND NOT (page_idx <= 20 AND contains(text, '目录')) THEN page_idx END) - 1, max(page_idx)) AS e
  FROM pages p JOIN (SELECT report_id, min(page_idx) AS s FROM pages WHERE NOT (page_idx <= 20 AND contains(text, '目录')) AND contains(substring(text, 1, 220), '财务报表附注') GROUP BY 1) USING (report_id) GROUP BY ALL
), scored AS (
  SELECT p.report_id, page_idx, CASE WHEN contains(text, '保险收入') THEN 12 ELSE 0 END + CASE WHEN contains(text, '利息收入') THEN 12 ELSE 0 END + CASE WHEN contains(text, 'heading') THEN 21 ELSE 0 END AS words, CASE WHEN contains(text, '<table>') THEN 15 ELSE 0 END AS bonus
  FROM pages p JOIN bounds b ON b.report_id = p.report_id AND page_idx BETWEEN s AND e
), hits AS (SELECT report_id, page_idx, words + bonus AS score, page_idx - row_number() OVER (PARTITION BY report_id ORDER BY page_idx) AS run FROM scored WHERE words > 0),
best AS (SELECT report_id, string_agg(page_idx || ':' || score, ',' ORDER BY score DESC, page_idx) AS hits FROM hits GROUP BY 1),
runs AS (SELECT report_id, string_agg(a || '-' || z, ',' ORDER BY a) AS windows FROM (SELECT report_id, min(page_idx) AS a, max(page_idx) AS z FROM hits GROUP BY report_id, run) GROUP BY 1)
SELECT report_id, 'income' AS theme, s AS start_page_idx, e AS end_page_idx, hits, windows FROM bounds LEFT JOIN best USING (report_id) LEFT JOIN runs USING (report_id)""")
def theme_in_notes(spark, sf_dir):
    """A theme's hits and their windows within the notes, whose bounds the default theme gives."""
    found = jobs.theme_results(_pages(spark, sf_dir), "income", _THEMES, scope="notes")
    text = lambda c, f: F.array_join(F.transform(c, f), ",")
    hits = text("hits", lambda h: F.concat_ws(":", h["page_idx"].cast("string"), h["score"].cast("string")))
    windows = text("hit_windows", lambda w: F.concat_ws("-", w["start_page_idx"].cast("string"), w["end_page_idx"].cast("string")))
    return found.select("report_id", "theme", "note_window.start_page_idx", "note_window.end_page_idx", hits.alias("hits"), windows.alias("windows"))
