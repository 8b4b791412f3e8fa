"""Queries over the given tables, one or more for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import NOTES_PATTERNS, OFFSET_ANCHORS, SECTIONS, STATEMENT_PATTERNS
from ..functions import text as X
from ..functions import cleaning as L
from ..operators import notes as N
from ..operators import pages as P
from ..operators import sections as S
from ..operators import tables as B
from ..operators import themes as T
from ..operators import toc as C
from ..sources import files
from . import jobs
from .standins import COMPOSED_SQL, DOCUMENTS_SQL, ITEMS_SQL, SEGMENTS_SQL, composed_pages, conversation_items, document_pages, read, spanned_pages

KEYWORDS = ("License", "Apache", "token", "worthless")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query with its SQL."""

    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _sql(text: str, *rules: tuple[str, str]) -> str:
    for pattern, new in rules:
        text = f"regexp_replace({text}, '{pattern}', {new}, 'g')"
    return text


_TWO_BREAKS = "chr(10) || chr(10)"
#: Cleaning without look-around, for texts without formulas and glued amounts; overlaps take a second pass.
_SYMBOLS = (
    ("([0-9])\\s+([0-9.%])", "'\\1\\2'"), ("([0-9])\\s+([0-9.%])", "'\\1\\2'"), ("(\\.)\\s+([0-9])", "'\\1\\2'"), ("(^|[^0-9])(20[0-9]{2})(?:0([1-9])|(1[0-2]))(?:0([1-9])|([12][0-9]|3[01]))([^0-9]|$)", "'\\1\\2年\\3\\4月\\5\\6日\\7'"),
    ("[^\\S\\n]{2,}", "' '"), ("\\s+([%.,;:])", "'\\1'"), ("\\(\\s+", "'('"), ("\\s+\\)", "')'"), ("\\n{3,}", _TWO_BREAKS), ("^\\s+|\\s+$", "''"),
)
_NOTE_TEXT = _sql("text", *_SYMBOLS, ("(?m)^[0-9]{1,3}\\s*$", "''"), ("\\n{3,}", _TWO_BREAKS), ("^\\s+|\\s+$", "''"))
_KEYWORD_SCORE = " + ".join(f"CASE WHEN contains(clean, '{k}') THEN {max(10, min(3 * len(k), 30))} ELSE 0 END" for k in KEYWORDS)
_MATCHED = "concat_ws(',', " + ", ".join(f"CASE WHEN contains(clean, '{k}') THEN '{k}' END" for k in KEYWORDS) + ")"
_FIRST_AT = "coalesce(" + ", ".join(f"nullif(instr(clean, '{k}'), 0)" for k in KEYWORDS) + ")"
_HITS = f"""hits AS (
  SELECT report_id, page_idx, score, matched_keywords, regexp_replace(substring(clean, greatest(1, i - 120), i + 500 - greatest(1, i - 120)), '^\\s+|\\s+$', '', 'g') AS excerpt
  FROM (SELECT *, {_KEYWORD_SCORE} + CASE WHEN contains(text, '<table>') THEN 15 ELSE 0 END AS score, {_MATCHED} AS matched_keywords, {_FIRST_AT} AS i FROM (SELECT *, {_NOTE_TEXT} AS clean FROM pages))
  WHERE score >= 10 AND matched_keywords <> ''
)"""
_ISLANDS = "SELECT report_id, page_idx, page_idx - row_number() OVER (PARTITION BY report_id ORDER BY page_idx) AS run FROM (SELECT DISTINCT report_id, page_idx FROM hits)"
_TOP = "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY score DESC, page_idx) AS place FROM hits) WHERE place <= 30)"


@query(f"WITH {DOCUMENTS_SQL}, {_HITS} SELECT report_id, page_idx, cast(score AS int) AS score, matched_keywords, excerpt FROM hits")
def theme_hits(spark, sf_dir):
    hits = T.theme_hits(document_pages(spark, sf_dir), KEYWORDS)
    return hits.withColumn("matched_keywords", F.array_join("matched_keywords", ","))


@query(f"WITH {DOCUMENTS_SQL}, {_HITS} SELECT report_id, min(page_idx) AS start_page_idx, max(page_idx) AS end_page_idx, string_agg(page_idx, ',' ORDER BY page_idx) AS page_indices FROM ({_ISLANDS}) GROUP BY report_id, run")
def theme_windows(spark, sf_dir):
    windows = T.consecutive_windows(T.theme_hits(document_pages(spark, sf_dir), KEYWORDS))
    return windows.withColumn("page_indices", F.array_join(F.col("page_indices").cast("array<string>"), ","))


@query(f"WITH {DOCUMENTS_SQL}, {_HITS}, {_TOP} SELECT report_id, page_idx, cast(score AS int) AS score, cast(place AS int) AS place FROM top")
def top_hits(spark, sf_dir):
    return T.top_hits(T.theme_hits(document_pages(spark, sf_dir), KEYWORDS)).select("report_id", "page_idx", "score", "place")


_CONTEXT = """near AS (
  SELECT report_id, page_idx + d AS page_idx, bool_or(d = 0) AS hit FROM (SELECT report_id, page_idx, unnest([-1, 0, 1]) AS d FROM top) GROUP BY ALL
), slim AS (
  SELECT report_id, string_agg('<!-- page: ' || page_idx || CASE WHEN hit THEN ' [hit]' ELSE '' END || ' -->' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page_idx) AS markdown, count(*) AS pages
  FROM pages JOIN near USING (report_id, page_idx) WHERE text <> '' GROUP BY report_id
)"""


@query(f"WITH {DOCUMENTS_SQL}, {_HITS}, {_TOP}, {_CONTEXT} SELECT report_id, markdown, pages FROM slim")
def theme_context(spark, sf_dir):
    """The hits and their context before cleaning."""
    pages = document_pages(spark, sf_dir)
    best, _ = jobs.extract_theme(pages, KEYWORDS)
    return T.assemble_slim(pages.join(T.context_pages(best), ["report_id", "page_idx"]))


#: Ten themes; some keywords lie within others, some are shared.
THEMES = {
    "licence": ("License", "Licensed", "Apache License", "Apache"), "rights": ("rights", "All rights reserved", "reserved"), "tone": ("worthless", "stupid", "pathetic"), "secrets": ("token", "password", "secret"), "code": ("api_key", "AKIA", "token"),
    "terms": ("Terms", "Public License", "General Public License"), "mail": ("example", "mail"), "copy": ("Copyright", "copy", "right"), "none": ("no such word at all", "absent"), "cards": ("card", "phone"),
}
_THEME_WORDS = ", ".join(f"('{n}', {i}, '{k}')" for n, own in THEMES.items() for i, k in enumerate(own))


@query(f"""WITH {DOCUMENTS_SQL}, words AS (SELECT * FROM (VALUES {_THEME_WORDS}) v(theme, i, word)), cleaned AS (SELECT *, {_NOTE_TEXT} AS clean FROM pages),
found AS (SELECT report_id, page_idx, theme, text, clean, sum(greatest(10, least(3 * length(word), 30))) AS score, string_agg(word, ',' ORDER BY i) AS matched_keywords, arg_min(instr(clean, word), i) AS first FROM cleaned JOIN words ON contains(clean, word) GROUP BY ALL)
SELECT report_id, page_idx, theme, cast(score + CASE WHEN contains(text, '<table>') THEN 15 ELSE 0 END AS int) AS score, matched_keywords, regexp_replace(substring(clean, greatest(1, first - 120), first + 500 - greatest(1, first - 120)), '^\\s+|\\s+$', '', 'g') AS excerpt FROM found""")
def hits_of_themes(spark, sf_dir):
    """Ten themes in one pass over the pages."""
    hits = T.hits_of_themes(document_pages(spark, sf_dir), THEMES)
    return hits.withColumn("matched_keywords", F.array_join("matched_keywords", ","))


@query(f"WITH {DOCUMENTS_SQL}, {_HITS}, {_TOP}, {_CONTEXT} SELECT report_id, pages, length(markdown) AS chars, cast(floor(length(markdown) / 1.5) AS bigint) AS est_tokens FROM slim")
def run_summary(spark, sf_dir):
    return P.run_summary(theme_context(spark, sf_dir)).withColumn("chars", F.col("chars").cast("long"))


#: What the cleaning does to composed pages: runs of blanks become one.
_SQUEEZED = _sql("text", ("[^\\S\\n]{2,}", "' '"))


@query(f"WITH {COMPOSED_SQL}, chosen AS (SELECT report_id, page_idx, bool_or(hit) AS hit FROM (SELECT report_id, page_idx + d AS page_idx, d = 0 AS hit FROM (SELECT report_id, page_idx, unnest([-1, 0, 1]) AS d FROM pages WHERE contains(text, '保险服务收入') OR contains(text, '存款'))) GROUP BY ALL) SELECT report_id, string_agg('<!-- page: ' || page_idx || CASE WHEN hit THEN ' [hit]' ELSE '' END || ' -->' || chr(10) || {_SQUEEZED}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page_idx) AS markdown, count(*) AS pages FROM pages JOIN chosen USING (report_id, page_idx) WHERE text <> '' GROUP BY report_id")
def slim_theme(spark, sf_dir):
    """Cleaned pages of a theme; the composed pages are clean already, so that SQL can tell."""
    pages = composed_pages(spark, sf_dir)
    best, _ = jobs.extract_theme(pages, ("保险服务收入", "存款"))
    return jobs.slim_theme(pages, best)


@query(f"WITH {DOCUMENTS_SQL} SELECT report_id, page_idx, {_NOTE_TEXT} AS text FROM pages WHERE contains(text, 'License') OR contains(text, 'token')")
def note_texts(spark, sf_dir):
    """Cleaned texts of the pages with a word."""
    pages = document_pages(spark, sf_dir).where(F.col("text").contains("License") | F.col("text").contains("token"))
    return pages.select("report_id", "page_idx", L.clean_note_text(F.col("text")).alias("text"))


_STRIPPED = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
_BUILT = f"""own AS (
  SELECT report_id, page_idx, seq, {_STRIPPED} AS t, CASE WHEN type = 'title' AND {_STRIPPED} <> '' THEN '## ' || {_STRIPPED} ELSE {_STRIPPED} END AS md FROM items
), built AS (
  SELECT report_id, page_idx, coalesce(string_agg(t, chr(10) ORDER BY seq, t) FILTER (t <> ''), '') AS text, coalesce(string_agg(md, chr(10) || chr(10) ORDER BY seq, md) FILTER (md <> ''), '') AS markdown FROM own GROUP BY ALL
)"""
_TAGS = "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{kind}:{p}' END" for kind, ps in (("statement", STATEMENT_PATTERNS), ("notes", NOTES_PATTERNS)) for p in ps) + ")"


@query(f"WITH {ITEMS_SQL}, {_BUILT} SELECT report_id, page_idx, text, markdown, {_TAGS} AS matched_tags FROM built")
def build_pages(spark, sf_dir):
    return jobs.build_pages(conversation_items(spark, sf_dir)).withColumn("matched_tags", F.array_join("matched_tags", ","))


@query(f"WITH {ITEMS_SQL}, {_BUILT} SELECT report_id, string_agg('<!-- page: ' || page_idx || ' -->' || chr(10) || markdown || chr(10), chr(10) || chr(10) ORDER BY page_idx) AS markdown FROM built GROUP BY report_id")
def document_markdown(spark, sf_dir):
    return P.document_markdown(P.items_to_pages(conversation_items(spark, sf_dir)))


@query(f"WITH {COMPOSED_SQL} SELECT report_id, page_idx, {_TAGS} AS tags FROM pages")
def page_tags(spark, sf_dir):
    return composed_pages(spark, sf_dir).select("report_id", "page_idx", F.array_join(P.page_tags(), ",").alias("tags"))


@query(f"""WITH {COMPOSED_SQL}, tagged AS (SELECT report_id, page_idx, {_TAGS} AS tags FROM pages)
SELECT report_id, coalesce(string_agg(page_idx, ',' ORDER BY page_idx) FILTER (contains(tags, 'statement:')), '') AS statement_pages,
       coalesce(string_agg(page_idx, ',' ORDER BY page_idx) FILTER (contains(tags, 'notes:')), '') AS notes_pages FROM tagged GROUP BY report_id""")
def page_candidates(spark, sf_dir):
    found = P.page_candidates(composed_pages(spark, sf_dir).withColumn("matched_tags", P.page_tags()))
    return found.select("report_id", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("statement_pages", "notes_pages")])


@query(f"WITH {DOCUMENTS_SQL} SELECT report_id, page_idx FROM pages WHERE page_idx BETWEEN 10 AND 400 AND regexp_matches(text, '(?:Lic[a-z]+ under)|(?:rights reserved)')")
def find_pages(spark, sf_dir):
    return P.find_pages(document_pages(spark, sf_dir), ("Lic[a-z]+ under", "rights reserved"), start=10, end=400).select("report_id", "page_idx")


@query(f"WITH {COMPOSED_SQL} SELECT report_id, min(page_idx) AS page_idx FROM pages WHERE regexp_matches(text, '(?:合并资产负债表)|(?:财务报表附注)') AND NOT (page_idx <= 20 AND contains(text, '目录')) GROUP BY report_id")
def find_first_page(spark, sf_dir):
    return P.find_first_page(composed_pages(spark, sf_dir), ("合并资产负债表", "财务报表附注"))


@query(f"WITH {DOCUMENTS_SQL} SELECT report_id, page_idx FROM pages WHERE regexp_matches(substring(text, 1, 220), '(?i)(?:license)|(?:stupid)')")
def matches_near_top(spark, sf_dir):
    return document_pages(spark, sf_dir).where(X.matches_near_top(F.col("text"), ("license", "stupid"))).select("report_id", "page_idx")


_TRIMMED = "regexp_replace(x, '^\\s+|\\s+$', '', 'g')"
_FORWARD, _REVERSED = "^(.{2,60}?)\\s{1,}([0-9]{1,4})\\s*$", "^([0-9]{1,4})\\s+(.{2,60}?)\\s*$"


@query(f"""WITH {COMPOSED_SQL}, parts AS (SELECT *, list_transform(string_split(text, chr(10)), lambda x: {_TRIMMED}) AS l FROM pages)
SELECT report_id, page_idx FROM parts WHERE NOT regexp_matches(substring(text, 1, 30), '目\\s*录')
 AND len(list_filter(l[1:6], lambda x: regexp_matches(x, '{_FORWARD}') OR regexp_matches(x, '{_REVERSED}'))) < 2 AND regexp_matches(l[1], '(?i)(?:合并.*利润表)|(?:财务报表附注)')""")
def matches_as_heading(spark, sf_dir):
    return composed_pages(spark, sf_dir).where(X.matches_as_heading(F.col("text"), ("合并.*利润表", "财务报表附注"))).select("report_id", "page_idx")


@query(f"WITH {COMPOSED_SQL} SELECT report_id, page_idx FROM pages WHERE page_idx <= 20 AND (contains(text, '目录') OR contains(lower(text), 'contents'))")
def toc_pages(spark, sf_dir):
    return C.toc_pages(composed_pages(spark, sf_dir)).select("report_id", "page_idx")


_ENTRIES = f"""toc_lines AS (
  SELECT report_id, page_idx, generate_subscripts(l, 1) AS line_no, unnest(l) AS line
  FROM (SELECT report_id, page_idx, list_filter(list_transform(string_split(regexp_replace(text, '<[^>]+>', '', 'g'), chr(10)), lambda x: {_TRIMMED}), lambda x: x <> '') AS l
        FROM pages WHERE page_idx <= 20 AND (contains(text, '目录') OR contains(lower(text), 'contents')))
), kinds AS (SELECT *, CASE WHEN regexp_matches(line, '{_FORWARD}') THEN 0 WHEN regexp_matches(line, '{_REVERSED}') THEN 1 END AS kind FROM toc_lines),
counted AS (SELECT *, count(*) OVER (PARTITION BY report_id, page_idx, kind) AS n FROM kinds WHERE kind IS NOT NULL),
named AS (
  SELECT *, CASE kind WHEN 0 THEN regexp_extract(line, '{_FORWARD}', 1) ELSE regexp_extract(line, '{_REVERSED}', 2) END AS title,
         cast(CASE kind WHEN 0 THEN regexp_extract(line, '{_FORWARD}', 2) ELSE regexp_extract(line, '{_REVERSED}', 1) END AS int) AS no FROM counted WHERE n >= 3
), entries AS (
  SELECT report_id, page_idx AS toc_page_idx, cast(row_number() OVER (PARTITION BY report_id ORDER BY no, page_idx, kind, line_no) - 1 AS int) AS ord, title, no AS reported_page_no
  FROM (SELECT *, row_number() OVER (PARTITION BY report_id, title, no ORDER BY page_idx, kind, line_no) AS turn FROM named WHERE no BETWEEN 1 AND 600 AND length(title) BETWEEN 2 AND 60) WHERE turn = 1
)"""
_ANCHORS = ", ".join(f"({i}, '{a}', '{p}')" for i, (a, p) in enumerate(OFFSET_ANCHORS))
_RANGES = f"""{_ENTRIES}, anchors AS (SELECT * FROM (VALUES {_ANCHORS}) v(i, name, pattern)),
offsets AS (
  SELECT report_id, arg_min(page_idx - no, i) AS toc_page_offset FROM (
    SELECT e.report_id, i, arg_min(reported_page_no, ord) AS no FROM entries e JOIN anchors ON contains(title, name) GROUP BY ALL
  ) JOIN (SELECT p.report_id, i, min(page_idx) AS page_idx FROM pages p JOIN anchors ON regexp_matches(substring(text, 1, 300), pattern) WHERE page_idx > 20 GROUP BY ALL) USING (report_id, i) GROUP BY report_id
), toc AS (
  SELECT report_id, ord AS pos, title, reported_page_no, reported_page_no + o AS start_page_idx,
         coalesce(lead(reported_page_no) OVER (PARTITION BY report_id ORDER BY ord) + o - 1, last_page_idx) AS end_page_idx, o AS toc_page_offset, last_page_idx
  FROM (SELECT e.*, coalesce(toc_page_offset, 0) AS o, last_page_idx FROM entries e LEFT JOIN offsets USING (report_id) JOIN (SELECT report_id, max(page_idx) AS last_page_idx FROM pages GROUP BY 1) USING (report_id))
)"""


@query(f"WITH {COMPOSED_SQL}, {_ENTRIES} SELECT report_id, toc_page_idx, ord, title, reported_page_no FROM entries")
def toc_entries(spark, sf_dir):
    return C.toc_entries(composed_pages(spark, sf_dir))


@query(f"WITH {COMPOSED_SQL}, {_RANGES} SELECT report_id, pos, title, reported_page_no, start_page_idx, end_page_idx, toc_page_offset FROM toc")
def toc_scan(spark, sf_dir):
    return jobs.toc_scan(composed_pages(spark, sf_dir))


_SECTIONS_SQL = " UNION ALL ".join(f"SELECT *, '{n}' AS section, {s.merge} AS merge FROM toc WHERE regexp_matches(title, '(?i){X.either(s.toc)}')" for n, s in SECTIONS.items())


@query(f"WITH {COMPOSED_SQL}, {_RANGES} SELECT report_id, section, pos, title FROM ({_SECTIONS_SQL})")
def section_entries(spark, sf_dir):
    toc = C.toc_ranges(composed_pages(spark, sf_dir))
    return C.section_entries(toc).select("report_id", "section", "pos", "title")


_SPANS = f"""spans AS (
  SELECT report_id, section, arg_min(start_page_idx, pos) AS start_page_idx, CASE WHEN bool_or(merge) THEN arg_max(end_page_idx, pos) ELSE arg_min(end_page_idx, pos) END AS end_page_idx FROM ({_SECTIONS_SQL}) GROUP BY ALL
)"""


@query(f"WITH {COMPOSED_SQL}, {_RANGES}, {_SPANS} SELECT * FROM spans")
def toc_spans(spark, sf_dir):
    return C.toc_spans(C.toc_ranges(composed_pages(spark, sf_dir)))


def _body_test(name: str) -> str:
    s = SECTIONS[name]
    pattern = f"(?i){X.either(s.body)}"
    return f"regexp_matches({'substring(text, 1, 220)' if s.subtoc else 'string_split(text, chr(10))[1]'}, '{pattern}')"


_VERIFIED = "verified AS (SELECT s.report_id, section, start_page_idx, end_page_idx, bool_or(coalesce(CASE section " + " ".join(f"WHEN '{n}' THEN {_body_test(n)}" for n in SECTIONS) + " END, false)) AS verified FROM spans s LEFT JOIN pages p ON p.report_id = s.report_id AND page_idx BETWEEN start_page_idx AND least(start_page_idx + 3, end_page_idx + 1) - 1 GROUP BY ALL)"


@query(f"WITH {COMPOSED_SQL}, {_RANGES}, {_SPANS}, {_VERIFIED} SELECT * FROM verified")
def verified_spans(spark, sf_dir):
    pages = composed_pages(spark, sf_dir)
    return C.verify_spans(C.toc_spans(C.toc_ranges(pages)), pages)


def _scan(name: str) -> str:
    s = SECTIONS[name]
    near = "substring(text, 1, 220)"
    line = f"CASE WHEN regexp_matches(substring(text, 1, 30), '目\\s*录') THEN '' ELSE {_sql('string_split(text, chr(10))[1]', ('^\\s+|\\s+$', chr(39) * 2))} END"
    where = near if s.subtoc else line
    listed = ", ".join(f"min(CASE WHEN name = '{n}' THEN no END)" for n in s.subtoc)
    start = f"coalesce((SELECT coalesce({listed}) FROM found f JOIN lists l ON l.report_id = f.report_id AND l.spot = f.spot WHERE f.report_id = r.report_id), b.seen)" if s.subtoc else "b.seen"
    return f"""SELECT r.report_id, '{name}' AS section, {start} AS start_page_idx, '(?i){X.either(s.stop)}' AS stop, {bool(s.subtoc)} AS near
      FROM (SELECT DISTINCT report_id FROM toc) r LEFT JOIN (SELECT report_id, min(page_idx) AS seen FROM pages WHERE regexp_matches({where}, '(?i){X.either(s.body)}') AND NOT regexp_matches(substring(text, 1, 150), '审计报告|Auditor') GROUP BY 1) b USING (report_id)
      WHERE NOT EXISTS (SELECT 1 FROM verified v WHERE v.report_id = r.report_id AND section = '{name}' AND verified)"""


_SUBTOC = " UNION ALL ".join(f"SELECT report_id, page_idx AS spot, '{n}' AS name, cast(regexp_extract(text, '{n}[^0-9P\\n]{{0,15}}(P?)([0-9]{{1,4}})', 2) AS int) AS no FROM pages WHERE regexp_matches(text, '{n}[^0-9P\\n]{{0,15}}(P?)([0-9]{{1,4}})')" for n in N.SUBTOC_NAMES)
_LISTS = f"found AS ({_SUBTOC}), lists AS (SELECT report_id, min(spot) AS spot FROM (SELECT report_id, spot FROM found GROUP BY ALL HAVING count(*) >= 2) GROUP BY 1)"
_LOCATED = f"""{_LISTS}, scans AS ({" UNION ALL ".join(map(_scan, SECTIONS))}), located AS (
  SELECT report_id, section, start_page_idx, end_page_idx, false AS fallback_used FROM verified WHERE verified
  UNION ALL SELECT report_id, section, start_page_idx, coalesce((SELECT min(page_idx) - 1 FROM pages p WHERE p.report_id = s.report_id AND page_idx > start_page_idx
    AND regexp_matches(CASE WHEN near THEN substring(text, 1, 220) WHEN regexp_matches(substring(text, 1, 30), '目\\s*录') THEN '' ELSE string_split(text, chr(10))[1] END, stop)),
    (SELECT max(page_idx) FROM pages p WHERE p.report_id = s.report_id)), true FROM scans s WHERE start_page_idx IS NOT NULL
)"""


@query(f"WITH {COMPOSED_SQL}, {_RANGES}, {_SPANS}, {_VERIFIED}, {_LOCATED} SELECT * FROM located")
def section_spans(spark, sf_dir):
    return S.section_spans(composed_pages(spark, sf_dir)).drop("matched_titles")


_SECTION_PAGES = f"""SELECT p.report_id, section, string_agg('<!-- page: ' || page_idx || ' -->' || chr(10) || {_SQUEEZED}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page_idx) AS markdown, count(*) AS pages
FROM pages p JOIN located v ON v.report_id = p.report_id AND page_idx BETWEEN start_page_idx AND end_page_idx WHERE text <> '' GROUP BY ALL"""


@query(f"WITH {COMPOSED_SQL}, {_RANGES}, {_SPANS}, {_VERIFIED}, {_LOCATED} {_SECTION_PAGES}")
def section_documents(spark, sf_dir):
    return jobs.section_documents(composed_pages(spark, sf_dir))


@query(f"WITH {COMPOSED_SQL}, {_RANGES}, {_SPANS}, {_VERIFIED}, {_LOCATED}, docs AS ({_SECTION_PAGES}) SELECT report_id, section, start_page_idx, end_page_idx, fallback_used, pages, length(markdown)::BIGINT AS chars, cast(floor(length(markdown) / 1.5) AS bigint) AS est_tokens FROM docs JOIN located USING (report_id, section)")
def section_slim(spark, sf_dir):
    return jobs.section_slim(composed_pages(spark, sf_dir)).drop("markdown", "matched_titles")


@query(f"""WITH {COMPOSED_SQL}, heads AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY page_idx) AS rn FROM pages),
named AS (SELECT report_id, x AS line FROM (SELECT report_id, unnest(string_split(text, chr(10))) AS x FROM heads WHERE rn <= 10) WHERE length(x) BETWEEN 4 AND 40 AND regexp_full_match(x, '.+(股份有限公司|有限公司)'))
SELECT report_id, string_agg(DISTINCT line, ',' ORDER BY line) AS noise FROM (SELECT report_id, unnest([line, translate(line, '（）', '()'), translate(line, '()', '（）')]) AS line FROM named) GROUP BY report_id""")
def report_noise(spark, sf_dir):
    return P.report_noise(composed_pages(spark, sf_dir)).withColumn("noise", F.array_join("noise", ","))


@query(f"""WITH {DOCUMENTS_SQL} SELECT DISTINCT source || '-' || 7 AS report_id FROM documents WHERE source || '-' || 7 NOT IN (SELECT report_id FROM pages) UNION SELECT DISTINCT source || '-0' FROM documents WHERE source || '-0' NOT IN (SELECT report_id FROM pages)""")
def pending_reports(spark, sf_dir):
    wanted = read(spark, sf_dir, "documents").select(F.explode(F.array(F.concat("source", F.lit("-7")), F.concat("source", F.lit("-0")))).alias("report_id")).distinct()
    return P.pending_reports(wanted, document_pages(spark, sf_dir))


@query("""SELECT report_id, regexp_replace(regexp_replace(name, '\\.pages\\.json$', ''), '\\.md$', '') AS stem, CASE WHEN contains(name, '半年度报告') THEN 'interim' WHEN contains(name, '年报') THEN 'annual' END AS kind
FROM (SELECT s_suppkey AS report_id, 'c' || s_suppkey || CASE s_suppkey % 3 WHEN 0 THEN '年报.pages.json' WHEN 1 THEN '半年度报告.md' ELSE 'x' END AS name FROM supplier)""")
def report_names(spark, sf_dir):
    ending = F.expr("CASE s_suppkey % 3 WHEN 0 THEN '年报.pages.json' WHEN 1 THEN '半年度报告.md' ELSE 'x' END")
    named = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("report_id"), F.concat(F.lit("c"), F.col("s_suppkey").cast("string"), ending).alias("name"))
    return named.select("report_id", files.report_id_from_path(F.concat(F.lit("/in/"), "name")).alias("stem"), files.classify_report(F.col("name")).alias("kind"))


_COMPANY = "'示例' || report_id || '保险股份有限公司'"
#: Blanks within numbers go, line breaks too; then runs of blanks.
_HEADED = _sql(f"({_COMPANY} || chr(10) || text || chr(10) || page_idx)", *_SYMBOLS[:3], ("[^\\S\\n]{2,}", "' '"))
_STAYS = "trim(x) <> '' AND trim(x) <> company AND NOT regexp_full_match(trim(x), '[0-9]{1,4}|财务报表|审计报告|关于我们') AND (starts_with(trim(x), '|') OR length(trim(x)) > 14 OR regexp_matches(x, '[，。；：？！,.%()（）]') OR regexp_matches(x, '[A-Za-z]{3,}'))"


def _cut(lines: str) -> str:
    return f"{lines}[coalesce(nullif(list_position(list_transform({lines}[1:8], lambda x: {_STAYS}), true), 0), least(8, len({lines})) + 1):]"


@query(f"""WITH {COMPOSED_SQL}, headed AS (SELECT report_id, page_idx, {_COMPANY} AS company, string_split({_HEADED}, chr(10)) AS l FROM pages WHERE page_idx > 20),
topped AS (SELECT report_id, page_idx, company, list_reverse({_cut("l")}) AS l FROM headed)
SELECT report_id, page_idx, regexp_replace(array_to_string(list_reverse({_cut("l")}), chr(10)), '^\\s+|\\s+$', '', 'g') AS text FROM topped""")
def page_headers(spark, sf_dir):
    """Pages under their company's name and over their number: both go, with the short lines beside them."""
    pages = composed_pages(spark, sf_dir)
    body = pages.where("page_idx > 20").selectExpr("report_id", "page_idx", "concat('示例', report_id, '保险股份有限公司', chr(10), text, chr(10), page_idx) AS text")
    return jobs.cleaned(body, pages).select("report_id", "page_idx", "text")


_LINES = "rows AS (SELECT report_id, page_idx, cast(unnest(range(0, len(l))) AS int) AS line_no, unnest(l) AS line FROM (SELECT report_id, page_idx, string_split(text, chr(10)) AS l FROM pages))"


def _page_lines(pages: DataFrame) -> DataFrame:
    return pages.select("report_id", "page_idx", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


_CELL = "regexp_replace(string_split(line, '|')[3], '^\\s+|\\s+$', '', 'g')"
_REF = "^([0-9]{1,2})(?:\\s*[（(]([0-9]{1,2})[）)])?"


@query(f"""WITH {COMPOSED_SQL}, {_LINES}, cells AS (SELECT *, string_split({_CELL}, '/')[1] AS c FROM rows WHERE starts_with(line, '|'))
SELECT report_id, page_idx, line_no, regexp_extract(c, '{_REF}', 1) || CASE WHEN regexp_extract(c, '{_REF}', 2) <> '' THEN '(' || regexp_extract(c, '{_REF}', 2) || ')' ELSE '' END AS note_key,
       cast(regexp_extract(c, '{_REF}', 1) AS int) AS note_no, nullif(regexp_extract(c, '{_REF}', 2), '') AS note_subref FROM cells WHERE regexp_matches(c, '{_REF}')""")
def note_references(spark, sf_dir):
    rows = _page_lines(composed_pages(spark, sf_dir)).where(F.col("line").startswith("|"))
    cell = X.strip(F.element_at(F.split("line", r"\|"), 3))
    return rows.withColumn("ref", X.parse_note_reference(cell)).where("ref is not null").select("report_id", "page_idx", "line_no", "ref.*")


@query(f"""WITH {COMPOSED_SQL}, {_LINES}, cells AS (SELECT *, regexp_replace(regexp_replace(string_split(line, '|')[2], '^\\s+|\\s+$', '', 'g'), '^(?:其中|加|减)\\s*[:：]\\s*', '') AS item FROM rows WHERE starts_with(line, '|'))
SELECT report_id, page_idx, line_no, item || CASE WHEN regexp_replace(item, '[（(][^()（）]{{0,40}}[)）]', '', 'g') <> item THEN '；' || regexp_replace(item, '[（(][^()（）]{{0,40}}[)）]', '', 'g') ELSE '' END AS terms FROM cells""")
def item_terms(spark, sf_dir):
    rows = _page_lines(composed_pages(spark, sf_dir)).where(F.col("line").startswith("|"))
    return rows.select("report_id", "page_idx", "line_no", F.array_join(X.item_search_terms(F.element_at(F.split("line", r"\|"), 2)), "；").alias("terms"))


_HEAD = "^\\s*([0-9]{1,2})(?:[.、]|\\s+)([^\\n]{1,80})$"


@query(f"""WITH {COMPOSED_SQL}, found AS (SELECT report_id, page_idx, list_filter(string_split(text, chr(10))[1:8], lambda x: {_TRIMMED} <> '' AND NOT starts_with(x, '|') AND regexp_matches(x, '{_HEAD}'))[1] AS h FROM pages)
SELECT report_id, page_idx, cast(regexp_extract(h, '{_HEAD}', 1) AS int) AS note_no, regexp_replace(regexp_replace(regexp_extract(h, '{_HEAD}', 2), '[（(]续[）)]$', ''), '^\\s+|\\s+$', '', 'g') AS title FROM found WHERE h IS NOT NULL""")
def note_headings(spark, sf_dir):
    return composed_pages(spark, sf_dir).withColumn("h", X.note_heading(F.col("text"))).where("h is not null").select("report_id", "page_idx", "h.*")


@query(f"""WITH {COMPOSED_SQL}, {_LINES}, cells AS (SELECT report_id, page_idx, line_no, unnest(range(1, len(c) + 1)) AS cell_no, regexp_replace(unnest(c), '^\\s+|\\s+$', '', 'g') AS cell FROM (SELECT *, string_split(line, '|') AS c FROM rows WHERE starts_with(line, '|')))
SELECT report_id, page_idx, line_no, count(*) FILTER (regexp_matches(replace(cell, ',', ''), '^(?:[-—]|\\(?-?[0-9]+(?:\\.[0-9]+)?%?\\)?)$')) AS n_values FROM cells GROUP BY ALL""")
def value_cells(spark, sf_dir):
    rows = _page_lines(composed_pages(spark, sf_dir)).where(F.col("line").startswith("|"))
    return rows.select("report_id", "page_idx", "line_no", F.size(F.filter(F.split("line", r"\|"), X.is_value_like)).cast("long").alias("n_values"))


@query("SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS text FROM pages")
def html_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", X.strip_tags(F.col("html")).alias("text"))


@query("""SELECT o_orderkey, regexp_replace(strftime(cast(o_orderdate AS date) + INTERVAL 10 YEAR, '%Y年%m月%d日'), '([年月])0', '\\1', 'g') AS day FROM orders""")
def expanded_dates(spark, sf_dir):
    day = F.date_format(F.add_months(F.to_date("o_orderdate"), 120), "yyyyMMdd")
    return read(spark, sf_dir, "orders").select("o_orderkey", X.expand_compact_date(day).alias("day"))


@query("SELECT l_orderkey, l_linenumber, cast(l_orderkey * 7919 + l_partkey AS varchar) || '.5%' AS amount FROM lineitem")
def collapsed_numbers(spark, sf_dir):
    number = (F.col("l_orderkey") * 7919 + F.col("l_partkey")).cast("string")
    spaced = F.concat(F.regexp_replace(number, "(?<=[0-9])(?=[0-9])", " "), F.lit(" . 5 %"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.collapse_spaced_number(spaced).alias("amount"))


def _statements(spark, sf_dir) -> DataFrame:
    """The composed reports' statement pages as documents."""
    pages = composed_pages(spark, sf_dir).where(F.col("text").contains("| --- |"))
    return pages.select("report_id", F.when(F.col("text").contains("利润表"), F.lit("income_statement")).otherwise(F.lit("balance_sheet")).alias("statement"), F.col("text").alias("markdown"))


_REFS = f"""{_LINES}, tables AS (
  SELECT report_id, CASE WHEN bool_or(contains(line, '利润表')) OVER w THEN 'income_statement' ELSE 'balance_sheet' END AS statement, line_no, list_transform(string_split(line[2:length(line) - 1], '|'), lambda x: {_TRIMMED}) AS c, starts_with(line, '|') AS is_row, bool_or(contains(line, '| --- |')) OVER w AS has
  FROM rows WINDOW w AS (PARTITION BY report_id, page_idx)
), body AS (SELECT *, string_split(c[2], '/')[1] AS ref, regexp_replace(c[1], '^(?:其中|加|减)\\s*[:：]\\s*', '') AS item_name FROM tables WHERE has AND is_row AND line_no > 2),
refs AS (
  SELECT report_id, statement, cast(row_number() OVER (PARTITION BY report_id, statement ORDER BY line_no) - 1 AS int) AS ord, item_name,
         regexp_extract(ref, '{_REF}', 1) || CASE WHEN regexp_extract(ref, '{_REF}', 2) <> '' THEN '(' || regexp_extract(ref, '{_REF}', 2) || ')' ELSE '' END AS note_key,
         cast(regexp_extract(ref, '{_REF}', 1) AS int) AS note_no, nullif(regexp_extract(ref, '{_REF}', 2), '') AS note_subref, nullif(c[3], '') AS current_amount, nullif(c[4], '') AS prior_amount
  FROM body WHERE regexp_matches(ref, '{_REF}') AND item_name <> ''
)"""


@query(f"WITH {COMPOSED_SQL}, {_REFS} SELECT * FROM refs")
def statement_note_refs(spark, sf_dir):
    return N.statement_note_refs(_statements(spark, sf_dir))


@query(f"""WITH {COMPOSED_SQL}, {_REFS} SELECT report_id, statement, note_key, note_no, note_subref, min(ord) AS ord, string_agg(item_name, ';' ORDER BY ord) AS items,
 string_agg(item_name || CASE WHEN contains(item_name, '（') THEN ';' || regexp_replace(item_name, '（[^（）]*）', '') ELSE '' END, ';' ORDER BY ord) AS terms, string_agg(concat_ws(';', nullif(current_amount, '-'), CASE WHEN prior_amount <> current_amount THEN nullif(prior_amount, '-') END), ';' ORDER BY ord) AS amounts FROM refs GROUP BY ALL""")
def ref_groups(spark, sf_dir):
    groups = N.group_refs(N.statement_note_refs(_statements(spark, sf_dir)))
    return groups.select("report_id", "statement", "note_key", "note_no", "note_subref", "ord", *[F.array_join(c, ";").alias(c) for c in ("items", "terms", "amounts")])


def _note_pages(spark, sf_dir) -> DataFrame:
    pages = composed_pages(spark, sf_dir).where(F.col("page_idx") - 22 - F.col("report_id").cast("int") % 3 >= 8)
    return pages.select("report_id", F.col("page_idx").alias("page_no"), "page_idx", "text").where("text <> ''")


_BLOCKS = f"""heads AS (
  SELECT report_id, page_idx, text, list_filter(string_split(text, chr(10))[1:8], lambda x: {_TRIMMED} <> '' AND NOT starts_with(x, '|') AND regexp_matches(x, '{_HEAD}'))[1] AS h
  FROM pages WHERE text <> '' AND page_idx - 22 - cast(report_id AS int) % 3 >= 8
), blocks AS (
  SELECT report_id, cast(row_number() OVER (PARTITION BY report_id ORDER BY page_idx) - 1 AS int) AS block_id, page_idx, CASE WHEN h IS NOT NULL THEN cast(regexp_extract(h, '{_HEAD}', 1) AS int) END AS note_no, text FROM heads
)"""


@query(f"WITH {COMPOSED_SQL}, {_BLOCKS} SELECT * FROM blocks")
def note_blocks(spark, sf_dir):
    return N.note_blocks(_note_pages(spark, sf_dir)).drop("title")


#: Of the composed reports' references only 2(3) names a subsection of note 8, which has no block; amounts never stand in unassigned blocks.
_MATCHED_SQL = f"""groups AS (SELECT report_id, statement, note_key, note_no, min(ord) AS ord, arg_min(item_name, ord) AS item FROM refs GROUP BY ALL),
matched AS (SELECT g.*, (SELECT count(*) FROM blocks b WHERE b.report_id = g.report_id AND b.note_no = g.note_no) AS n FROM groups g)"""


@query(f"""WITH {COMPOSED_SQL}, {_REFS}, {_BLOCKS}, {_MATCHED_SQL}
SELECT report_id, groups, matched, groups - matched AS unmatched, note_blocks, unassigned
FROM (SELECT report_id, count(*) AS groups, count(*) FILTER (n > 0) AS matched FROM matched GROUP BY 1) JOIN (SELECT report_id, count(note_no) AS note_blocks, count(*) FILTER (note_no IS NULL) AS unassigned FROM blocks GROUP BY 1) USING (report_id)""")
def statement_notes_stats(spark, sf_dir):
    groups, blocks = N.group_refs(N.statement_note_refs(_statements(spark, sf_dir))), N.note_blocks(_note_pages(spark, sf_dir))
    return N.statement_notes_stats(N.match_notes(groups, blocks), blocks)


@query(f"""WITH {COMPOSED_SQL}, cells AS (SELECT report_id, cast(unnest(regexp_extract_all(text, '\\|\\s*([0-9]{{1,2}})(?:[/\\s（(]|\\s*\\|)', 1)) AS int) AS n FROM pages WHERE contains(text, '| --- |'))
SELECT report_id, string_agg(DISTINCT n, ',' ORDER BY n) AS sub_notes FROM cells WHERE n BETWEEN 1 AND 99 GROUP BY 1""")
def note_ref_set(spark, sf_dir):
    docs = _statements(spark, sf_dir).withColumn("is_bs", F.col("statement") == "balance_sheet").withColumn("seq", F.when(F.col("is_bs"), 0).otherwise(1))
    return N.note_ref_set(docs).select("report_id", F.array_join(F.col("sub_notes").cast("array<string>"), ",").alias("sub_notes"))


@query(f"WITH {COMPOSED_SQL}, {_LISTS} SELECT report_id, name, no AS page_idx FROM found JOIN lists USING (report_id, spot)")
def subtoc_pages(spark, sf_dir):
    return N.subtoc_pages(composed_pages(spark, sf_dir))


def _table_pages(spark, sf_dir) -> DataFrame:
    """A page for each region, with a table of its nations, contents lines in a second table, and text around them."""
    nations = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k"), "n_nationkey", F.format_string("<tr><td>%s</td><td> %s </td><td>%s</td></tr>", F.col("n_name"), F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string")).alias("row"))
    held = nations.groupBy("k").agg(F.array_join(P.ordered("row", "n_nationkey"), "").alias("rows"))
    text = F.concat(F.lit("目录 of "), F.col("k").cast("string"), F.lit("。<table><tr><th>国家</th><th>地区</th><th>编号</th></tr>"), "rows", F.lit("</table>末。"))
    return held.select(F.col("k").cast("string").alias("report_id"), F.lit(3).alias("page_idx"), text.alias("text"))


@query("""WITH own AS (SELECT n_regionkey AS k, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS row_no FROM nation)
SELECT cast(k AS varchar) AS report_id, 3 AS page_idx, 0 AS table_no, cast(row_no AS int) AS row_no, n_name || ';' || k || ';' || n_nationkey AS cells FROM own
UNION ALL SELECT DISTINCT cast(k AS varchar), 3, 0, 0, '国家;地区;编号' FROM own""")
def table_rows(spark, sf_dir):
    return B.table_rows(_table_pages(spark, sf_dir)).withColumn("cells", F.array_join("cells", ";"))


@query("""SELECT cast(n_regionkey AS varchar) AS report_id, 3 AS toc_page_idx, cast(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS int) AS row_no, n_name AS title, cast(n_nationkey AS int) AS reported_page_no FROM nation""")
def html_toc_entries(spark, sf_dir):
    return B.html_toc_entries(_table_pages(spark, sf_dir)).drop("table_no")


@query("""SELECT cast(n_regionkey AS varchar) AS report_id, 3 AS toc_page_idx, cast(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS int) AS ord, n_name AS title, cast(n_nationkey AS int) AS reported_page_no FROM nation WHERE n_nationkey >= 1""")
def toc_tables(spark, sf_dir):
    return C.toc_entries(_table_pages(spark, sf_dir))


@query("""SELECT cast(n_regionkey AS varchar) AS report_id, '目录 of ' || n_regionkey || '。' || chr(10) || chr(10) || '| 国家 | 地区 | 编号 |' || chr(10) || '|---|---|---|' || string_agg(chr(10) || '| ' || n_name || ' | ' || n_regionkey || ' | ' || n_nationkey || ' |', '' ORDER BY n_nationkey) || chr(10) || chr(10) || '末。' AS text FROM nation GROUP BY n_regionkey""")
def cleaned_tables(spark, sf_dir):
    pages = _table_pages(spark, sf_dir).withColumn("noise", F.lit(None).cast("array<string>"))
    return B.clean_pages(pages).select("report_id", "text")


_HEAD_LINES = "'| 项目 | 2025年 / 户数 | 2025年 / 余额 |' || chr(10) || '|---|---|---|'"
#: The rows that stay, with the section that they stand in: a total by its own values, unless a row has them, then one without a balance.
_STAYING = f"""segments AS ({SEGMENTS_SQL}), totals AS (SELECT k, min(m) AS m, min(n) AS n, min(cents) AS cents FROM segments GROUP BY k), staying AS (
  SELECT k, row_no AS place, CASE WHEN k % 2 = 1 OR m < 4 OR row_no < 2 THEN 0 WHEN row_no < 4 THEN 1 ELSE 2 END AS part, name || CASE WHEN row_no = 3 THEN ' / a\\|b' ELSE '' END AS label, n, cents FROM segments
  UNION ALL SELECT k, 100, CASE WHEN k % 2 = 1 OR m < 4 THEN 0 ELSE 2 END, '合计', n, cents FROM totals t WHERE NOT EXISTS (SELECT 1 FROM segments s WHERE s.k = t.k AND s.n = t.n AND s.cents = t.cents)
  UNION ALL SELECT k, 101, CASE WHEN k % 2 = 1 OR m < 4 THEN 0 ELSE 2 END, '合计', n, '-' FROM totals
), blocks AS (
  SELECT k, part, CASE part WHEN 1 THEN '**甲部**' || chr(10) WHEN 2 THEN '**乙部**' || chr(10) ELSE '' END || {_HEAD_LINES} || string_agg(chr(10) || '| ' || label || ' | ' || n || ' | ' || cents || ' |', '' ORDER BY place) AS block FROM staying GROUP BY k, part
)"""


@query(f"WITH {_STAYING} SELECT cast(k AS varchar) AS report_id, 'Before.' || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY part) || chr(10) || chr(10) || 'After.' AS text FROM blocks GROUP BY k")
def spanned_tables(spark, sf_dir):
    """Tables with merged header cells, line breaks, blank labels, repeated totals and section rows, in cleaned pages."""
    pages = spanned_pages(spark, sf_dir).withColumn("noise", F.lit(None).cast("array<string>"))
    return B.clean_pages(pages).select("report_id", "text")


@query(f"""WITH {_STAYING} SELECT cast(k AS varchar) AS report_id, cast(row_number() OVER (PARTITION BY k ORDER BY place, part) - 1 AS int) AS row_no, label || ';' || n || ';' || cents AS cells
FROM (SELECT k, place, 1 AS part, replace(replace(label, ' / a', chr(10) || 'a'), '\\|', '|') AS label, n, cents FROM staying UNION ALL SELECT DISTINCT k, 2, 0, '甲部', '', '' FROM staying WHERE part = 2 UNION ALL SELECT DISTINCT k, 4, 0, '乙部', '', '' FROM staying WHERE part = 2)""")
def table_row_cleanup(spark, sf_dir):
    """The rows of each table below its header, without blank and repeated ones."""
    rows = B.table_rows(spanned_pages(spark, sf_dir)).where("row_no >= 2")
    body = rows.groupBy("report_id", "page_idx", "table_no").agg(P.ordered("cells", "row_no").alias("body"))
    cleaned = body.select("report_id", F.posexplode(B.cleaned_rows(F.col("body"))).alias("row_no", "cells"))
    return cleaned.withColumn("cells", F.array_join("cells", ";"))


@query(f"""WITH segments AS ({SEGMENTS_SQL}), heads AS (SELECT DISTINCT k FROM segments)
SELECT cast(k AS varchar) AS report_id, row_no, col_no, text, rowspan, colspan, is_anchor FROM heads CROSS JOIN (VALUES (0, 0, '项目', 2, 1, true), (0, 1, '2025年', 1, 2, true), (0, 2, '', 1, 2, false), (1, 0, '', 2, 1, false), (1, 1, '户数', 1, 1, true), (1, 2, '余额', 1, 1, true)) v(row_no, col_no, text, rowspan, colspan, is_anchor)""")
def header_grid(spark, sf_dir):
    """Header cells with what they cover."""
    cells = B.table_cells(spanned_pages(spark, sf_dir)).where("is_header")
    return cells.select("report_id", "row_no", "col_no", "text", "rowspan", "colspan", "is_anchor")


@query(f"""WITH {COMPOSED_SQL} SELECT report_id, min(page_idx) AS start_page_idx, coalesce(min(CASE WHEN contains(text, '补充资料') AND NOT contains(text, '目录') THEN page_idx END) - 1, max(page_idx)) AS end_page_idx
FROM pages JOIN (SELECT report_id, min(page_idx) AS s FROM pages WHERE NOT (page_idx <= 20 AND contains(text, '目录')) AND regexp_matches(substring(text, 1, 220), '财务报表附注') GROUP BY 1) USING (report_id) WHERE page_idx >= s GROUP BY 1""")
def note_windows(spark, sf_dir):
    return S.note_windows(composed_pages(spark, sf_dir), ("财务报表附注",), ("财务报表补充资料",))


@query(f"""WITH {COMPOSED_SQL}, {_REFS}, {_BLOCKS}, {_MATCHED_SQL}, titled AS (
  SELECT m.*, coalesce((SELECT arg_min(regexp_replace(regexp_replace(regexp_extract(h, '{_HEAD}', 2), '[（(]续[）)]$', ''), '^\\s+|\\s+$', '', 'g'), page_idx) FROM heads d WHERE d.report_id = m.report_id AND h IS NOT NULL AND cast(regexp_extract(h, '{_HEAD}', 1) AS int) = m.note_no), item) AS title,
    coalesce((SELECT string_agg('<!-- page: ' || page_idx || ' -->' || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY block_id) FROM blocks b WHERE b.report_id = m.report_id AND b.note_no = m.note_no), '{N.REVIEW}') AS body FROM matched m
), parts AS (
  SELECT report_id, statement, string_agg(chr(10) || chr(10) || '### 附注 ' || note_key || ' ' || title || chr(10) || chr(10) || '对应主表科目：' || item || chr(10) || chr(10) || body, '' ORDER BY ord) AS part FROM titled GROUP BY ALL
)
SELECT report_id, statement, '# ' || CASE statement WHEN 'balance_sheet' THEN '合并资产负债表' ELSE '合并利润表' END || '及对应财务报表附注' || chr(10) || chr(10) || '## 原始主表' || chr(10) || chr(10) || text || chr(10) || chr(10) || '## 对应附注' || part || chr(10) AS markdown
FROM parts JOIN (SELECT report_id, CASE WHEN contains(text, '利润表') THEN 'income_statement' ELSE 'balance_sheet' END AS statement, text FROM pages WHERE contains(text, '| --- |')) USING (report_id, statement)""")
def statement_documents(spark, sf_dir):
    docs = _statements(spark, sf_dir)
    groups, blocks = N.group_refs(N.statement_note_refs(docs)), N.note_blocks(_note_pages(spark, sf_dir))
    return N.statement_documents(docs, N.match_notes(groups, blocks))


RANGES_SQL, SPANS_SQL, VERIFIED_SQL, LOCATED_SQL = _RANGES, _SPANS, _VERIFIED, _LOCATED


def stripped_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


from . import ledger  # noqa: E402, F401  (its queries use the SQL above)
