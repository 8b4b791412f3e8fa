"""Statement line items, the notes they refer to, and the pages of these notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import normalize_lookup
from ..functions.text import LINE_BREAKS, clean_item_name, either, is_furniture, is_short_garble, item_search_terms, note_heading, parse_note_reference, strip

# Names, numerals and signs of the reports' formats: fixed values.
SUBTOC_NAMES = ("合并及公司资产负债表", "合并资产负债表", "合并及公司利润表", "合并利润表", "财务报表附注", "合并现金流量表", "合并股东权益变动表")
#: What follows a name in a statement table.
SUBTOC_TAIL = r"[^0-9P\n]{0,15}(P?)([0-9]{1,4})"
NUMERALS = ("一", "二", "三", "四", "五", "六", "七", "八", "九", "十", "十一", "十二", "十三", "十四", "十五", "十六", "十七", "十八", "十九", "二十")
EMPTY_AMOUNTS = ("-", "–", "—")
NOISE_DEPTH = 8


def table_rows(docs: DataFrame, *keys: str) -> DataFrame:
    """keys, line_no, table_no and cells of the table lines of Markdown texts; a run of such lines is a table."""
    rows = docs.select(*keys, F.posexplode(F.split("markdown", "\n")).alias("line_no", "line")).withColumn("line", strip(F.col("line"))).where(F.col("line").startswith("|"))
    run = F.col("line_no") - F.row_number().over(Window.partitionBy(*keys).orderBy("line_no"))
    inner = F.regexp_replace("line", r"^\|+|\|+\z", "")
    cells = F.when(F.col("line").endswith("|") & (F.length("line") > 0), F.transform(F.split(inner, r"\|"), strip)).otherwise(F.array().cast("array<string>"))
    return rows.select(*keys, "line_no", run.alias("table_no"), cells.alias("cells"))


def is_separator_row(cells: Column) -> Column:
    return (F.size(cells) > 0) & F.forall(cells, lambda c: c.rlike(r"^:?-{3,}:?\z"))


def statement_note_refs(docs: DataFrame) -> DataFrame:
    """(report_id, statement, ord, item_name, note_key, note_no, note_subref, current_amount, prior_amount).

    docs: report_id, statement, markdown. The note column is the first cell with 附注 in the rows up to two below a table's
    separator; the rows below the separator that have a name and a reference there count.
    """
    keys = ("report_id", "statement")
    table = Window.partitionBy(*keys, "table_no")
    rows = table_rows(docs, *keys).withColumn("rule", F.min(F.when(is_separator_row(F.col("cells")), F.col("line_no"))).over(table)).where("rule is not null")
    at = F.get(F.filter(F.sequence(F.lit(0), F.size("cells")), lambda i: F.coalesce(F.get("cells", i).contains("附注"), F.lit(False))), F.lit(0))
    rows = rows.withColumn("here", F.when(F.col("line_no") <= F.col("rule") + 2, at)).withColumn("col", F.min_by("here", F.when(F.col("here").isNotNull(), F.col("line_no"))).over(table))
    body = rows.where((F.col("line_no") > F.col("rule")) & F.col("col").isNotNull() & (F.col("col") < F.size("cells")))
    amount = lambda by: F.nullif(F.get("cells", F.col("col") + by), F.lit(""))
    refs = body.select(*keys, "line_no", clean_item_name(F.get("cells", F.lit(0))).alias("item_name"), parse_note_reference(F.get("cells", F.col("col"))).alias("ref"), amount(1).alias("current_amount"), amount(2).alias("prior_amount"))
    refs = refs.where("item_name <> '' AND ref IS NOT NULL")
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("line_no")) - 1
    return refs.select(*keys, order.alias("ord"), "item_name", "ref.*", "current_amount", "prior_amount")


def group_refs(refs: DataFrame) -> DataFrame:
    """One row for each note of a statement: first use, and its items, terms and amounts, each once and in order."""
    taken = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", c.alias("v")))), lambda x: x.v)))
    amounts = F.filter(F.array("current_amount", "prior_amount"), lambda a: a.isNotNull() & ~a.isin(*EMPTY_AMOUNTS))
    return refs.groupBy("report_id", "statement", "note_key", "note_no", "note_subref").agg(F.min("ord").alias("ord"), taken(F.array("item_name")).alias("items"), taken(item_search_terms(F.col("item_name"))).alias("terms"), taken(amounts).alias("amounts"))


def markdown_pages(docs: DataFrame) -> DataFrame:
    """(report_id, page_no, page_idx, text) of the non-blank pages of documents; a marker that flags a hit is no page mark."""
    mark = r"(?m)^<!-- page: ([0-9]+) -->\s*$"
    parts = F.slice(F.split("markdown", mark, -1), 2, F.greatest(F.size(F.split("markdown", mark, -1)) - 1, F.lit(0)))
    zipped = F.arrays_zip(F.expr(rf"regexp_extract_all(markdown, r'{mark}', 1)").alias("page_idx"), parts.alias("text"))
    rows = docs.select("report_id", F.posexplode(zipped).alias("page_no", "p"))
    return rows.select("report_id", "page_no", F.col("p.page_idx").cast("int").alias("page_idx"), strip(F.col("p.text")).alias("text")).where("text <> ''")


def note_blocks(pages: DataFrame, first_note: DataFrame | None = None) -> DataFrame:
    """(report_id, block_id, page_idx, note_no, title, text): paragraphs with the note they belong to, or none.

    On a page with headings, blocks take the heading before them; those before its first heading take the last heading of
    earlier pages. Pages without a heading are unassigned. On the first page, what comes before any heading takes
    the report's first_note (report_id, note_no) if it is given.
    """
    blocks = pages.select("report_id", "page_no", "page_idx", F.posexplode(F.filter(F.transform(F.split("text", r"\n{2,}"), strip), lambda b: b != "")).alias("pos", "text"))
    blocks = blocks.withColumn("h", note_heading(F.col("text")))
    narrow = blocks.select("report_id", "page_no", "pos", F.col("h.note_no").alias("own"), F.col("h.title").alias("title"))
    report, page = Window.partitionBy("report_id").orderBy("page_no", "pos"), Window.partitionBy("report_id", "page_no")
    within = page.orderBy("pos")
    earlier = F.last("own", ignorenulls=True).over(report.rowsBetween(Window.unboundedPreceding, -1))
    narrow = narrow.withColumn("block_id", F.row_number().over(report) - 1).withColumn("before", earlier).withColumn("headed", F.max(F.col("own").isNotNull()).over(page)).withColumn("first", F.col("page_no") == F.min("page_no").over(Window.partitionBy("report_id")))
    narrow = narrow.withColumn("here", F.last("own", ignorenulls=True).over(within)).withColumn("title", F.last("title", ignorenulls=True).over(within))
    if first_note is not None:
        narrow = narrow.join(first_note.select("report_id", F.col("note_no").alias("initial")), "report_id", "left")
    else:
        narrow = narrow.withColumn("initial", F.lit(None).cast("int"))
    note = F.when(F.col("headed"), F.coalesce("here", "before", F.when(F.col("first"), F.col("initial")))).otherwise(F.when(F.col("first"), F.col("initial")))
    placed = narrow.select("report_id", "page_no", "pos", "block_id", note.alias("note_no"), F.when(F.col("here").isNotNull(), F.col("title")).alias("title"))
    return blocks.select("report_id", "page_no", "pos", "page_idx", "text").join(placed, ["report_id", "page_no", "pos"]).select("report_id", "block_id", "page_idx", "note_no", "title", "text")


def initial_notes(refs: DataFrame) -> DataFrame:
    """(report_id, note_no): the smallest note number that a report's statements refer to."""
    return refs.groupBy("report_id").agg(F.min("note_no").alias("note_no"))


def note_titles(blocks: DataFrame) -> DataFrame:
    """(report_id, note_no, title): the first title of each note."""
    return blocks.where("note_no is not null").groupBy("report_id", "note_no").agg(F.min_by("title", F.when(F.col("title").isNotNull(), F.col("block_id"))).alias("title"))


def block_score(terms: Column, amounts: Column, lookup: Column, text: Column) -> Column:
    """How well a block fits a group: 12 and the term's length (12 at most) for its best term, and 4 for each amount.

    terms and lookup are in the form of normalize_lookup(), so that none is normalised twice.
    """
    best = F.array_max(F.transform(F.filter(terms, lambda t: (t != "") & lookup.contains(t)), lambda t: 12 + F.least(F.length(t), F.lit(12))))
    return F.coalesce(best, F.lit(0)) + 4 * F.size(F.filter(amounts, lambda a: (a != "") & text.contains(a)))


LEAST_SCORE = 8
_GROUP = ("report_id", "statement", "note_key")


def scored_blocks(groups: DataFrame, blocks: DataFrame, least: int = LEAST_SCORE) -> DataFrame:
    """(report_id, statement, note_key, block_id, score): unassigned blocks and the groups that they fit.

    A report's groups travel as one array beside each of its unassigned blocks, so only pairs that fit become rows.
    """
    own = F.struct("statement", "note_key", F.transform("terms", normalize_lookup).alias("terms"), "amounts")
    held = groups.groupBy("report_id").agg(F.collect_list(own).alias("groups"))
    free = blocks.where("note_no is null").select("report_id", "block_id", "text", normalize_lookup(F.col("text")).alias("lookup"))
    scores = F.transform("groups", lambda g: F.struct(g.statement.alias("statement"), g.note_key.alias("note_key"), block_score(g.terms, g.amounts, F.col("lookup"), F.col("text")).alias("score")))
    return free.join(held, "report_id").select("report_id", "block_id", F.explode(F.filter(scores, lambda g: g.score >= least)).alias("g")).select(F.col("report_id"), "g.statement", "g.note_key", "block_id", "g.score")


SUBSECTION = r"(?U)^[（(]([0-9]{1,2})[）)]\s*(.+)?$"


def subsection_blocks(groups: DataFrame, blocks: DataFrame) -> DataFrame:
    """(report_id, statement, note_key, block_id, sub_title): the blocks of each group's note.

    For a reference such as 31(5) those under the line (5) and, if it has a heading, the note's first block; all blocks of
    the note where no such line is. sub_title: what follows the mark, where it last stands.
    """
    order = Window.partitionBy("report_id", "note_no").orderBy("block_id")
    heads = F.filter(F.transform(F.slice(F.split("text", LINE_BREAKS), 1, 8), strip), lambda x: x.rlike(SUBSECTION))
    mark = F.get(heads, F.lit(0))
    own = blocks.where("note_no is not null").withColumn("mark", mark)
    own = own.select("report_id", "note_no", "block_id", F.nullif(F.regexp_extract("mark", SUBSECTION, 1), F.lit("")).alias("own"), F.nullif(strip(F.regexp_extract("mark", SUBSECTION, 2)), F.lit("")).alias("named"), note_heading(F.col("text")).isNotNull().alias("headed"))
    own = own.withColumn("sub", F.last("own", ignorenulls=True).over(order)).withColumn("first", F.row_number().over(order) == 1)
    joined = groups.select(*_GROUP, "note_no", "note_subref").join(own, ["report_id", "note_no"])
    group = Window.partitionBy(*_GROUP)
    inside = F.coalesce(F.col("sub") == F.col("note_subref"), F.lit(False))
    joined = joined.withColumn("inside", inside).withColumn("any", F.max("inside").over(group))
    here = F.when(F.col("own") == F.col("note_subref"), F.struct("block_id", "named"))
    joined = joined.withColumn("sub_title", F.max(here).over(group)["named"])
    return joined.where("NOT any OR inside OR (first AND headed)").select(*_GROUP, "block_id", "sub_title")


def match_notes(groups: DataFrame, blocks: DataFrame) -> DataFrame:
    """groups with title (of the subsection or the note, else the first item) and blocks, an array of (block_id, page_idx, text)
    in order: those of the note or its subsection, and unassigned ones that fit. An empty array where nothing is found."""
    scoped = subsection_blocks(groups, blocks)
    extra = scored_blocks(groups, blocks).select(*_GROUP, "block_id", F.lit(None).cast("string").alias("sub_title"))
    found = scoped.unionByName(extra).groupBy(*_GROUP, "block_id").agg(F.max("sub_title").alias("sub_title"))
    texts = found.join(blocks.select("report_id", "block_id", "page_idx", "text"), ["report_id", "block_id"])
    held = texts.groupBy(*_GROUP).agg(F.max("sub_title").alias("sub_title"), F.array_sort(F.collect_list(F.struct("block_id", "page_idx", "text"))).alias("blocks"))
    named = groups.join(held, list(_GROUP), "left").join(note_titles(blocks), ["report_id", "note_no"], "left")
    title = F.coalesce("sub_title", "title", F.get("items", F.lit(0)), F.lit(""))
    none = F.array().cast("array<struct<block_id: int, page_idx: int, text: string>>")
    return named.withColumn("title", title).withColumn("blocks", F.coalesce("blocks", none)).drop("sub_title")


def statement_notes_stats(matched: DataFrame, blocks: DataFrame) -> DataFrame:
    """For each report: groups, matched and unmatched ones of both statements, blocks of notes and unassigned blocks. matched: see match_notes()."""
    of_groups = matched.groupBy("report_id").agg(F.count("*").alias("groups"), F.count_if(F.size("blocks") > 0).alias("matched"), F.count_if(F.size("blocks") == 0).alias("unmatched"))
    of_blocks = blocks.groupBy("report_id").agg(F.count_if(F.col("note_no").isNotNull()).alias("note_blocks"), F.count_if(F.col("note_no").isNull()).alias("unassigned"))
    return of_groups.join(of_blocks, "report_id", "full")


TITLES = {"balance_sheet": "合并资产负债表", "income_statement": "合并利润表"}
REVIEW = "未在财务报表附注中定位到明确内容，建议人工复核。"


def rendered_blocks(blocks: Column) -> Column:
    """Blocks in order, with a page mark where the page changes."""
    numbered = F.transform(blocks, lambda b, i: F.struct(b.page_idx.alias("page_idx"), F.get(blocks, i - 1).page_idx.alias("before"), b.text.alias("text")))
    marked = F.transform(numbered, lambda b: F.concat(F.when(~b.page_idx.eqNullSafe(b.before), F.concat(F.lit("<!-- page: "), b.page_idx.cast("string"), F.lit(" -->\n\n"))).otherwise(F.lit("")), b.text))
    return strip(F.array_join(marked, "\n\n"))


def statement_documents(docs: DataFrame, matched: DataFrame) -> DataFrame:
    """(report_id, statement, markdown): each statement followed by the notes it refers to. docs: report_id, statement, markdown."""
    head = F.concat(F.lit("### 附注 "), "note_key", F.when(F.col("title") != "", F.concat(F.lit(" "), "title")).otherwise(F.lit("")))
    body = F.when(F.size("blocks") > 0, rendered_blocks(F.col("blocks"))).otherwise(F.lit(REVIEW))
    part = F.concat(head, F.lit("\n\n对应主表科目："), F.array_join("items", "；"), F.lit("\n\n"), body)
    parts = matched.select("report_id", "statement", F.struct("ord", part.alias("part")).alias("p")).groupBy("report_id", "statement").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p.part).alias("parts"))
    title = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for t in TITLES.items() for x in t]), F.col("statement")), F.col("statement"))
    start = F.concat(F.lit("# "), title, F.lit("及对应财务报表附注\n\n## 原始主表\n\n"), strip(F.col("markdown")), F.lit("\n\n## 对应附注"))
    joined = docs.join(parts, ["report_id", "statement"], "left")
    whole = F.concat_ws("\n\n", F.array(start), F.coalesce("parts", F.array().cast("array<string>")))
    return joined.select("report_id", "statement", F.concat(strip(whole), F.lit("\n")).alias("markdown"))


def note_ref_set(docs: DataFrame) -> DataFrame:
    """(report_id, main_section, sub_notes, first_bs_note) of a report's statements, in the order of seq.

    docs: report_id, seq, markdown, is_bs. Without a main section, numbers below a first balance-sheet note above 3 are dropped.
    """
    section = F.nullif(F.regexp_extract("markdown", f"附注([{''.join(NUMERALS[:10])}]+)", 1), F.lit(""))
    found = F.expr(r"transform(regexp_extract_all(markdown, r'(?U)\|\s*([0-9]{1,2})(?:[/\s（(]|\s*\|)', 1), x -> cast(x AS int))")
    numbers = F.filter(found, lambda n: n.between(1, 99))
    each = docs.select("report_id", "seq", "is_bs", section.alias("section"), numbers.alias("numbers"))
    first = F.when(F.col("is_bs") & (F.size("numbers") > 0), F.col("seq"))
    sums = each.groupBy("report_id").agg(F.min_by("section", F.when(F.col("section").isNotNull(), F.col("seq"))).alias("main_section"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("numbers")))).alias("all"), F.min_by(F.get("numbers", F.lit(0)), first).alias("first_bs_note"))
    low = F.col("main_section").isNull() & (F.coalesce("first_bs_note", F.lit(0)) > 3)
    return sums.select("report_id", "main_section", F.when(low, F.filter("all", lambda n: n >= F.col("first_bs_note"))).otherwise(F.col("all")).alias("sub_notes"), "first_bs_note")


def referenced_pages(pages: DataFrame, refs: DataFrame) -> DataFrame:
    """Pages (report_id, page_idx) of the notes that refs name; all pages of reports without references, or without a row in refs.

    Page order is a state machine over windows: the main section starts and stops, an explicit number opens a segment,
    and without a main section a page that starts with a table is taken for the first referenced note
    while the number so far is lower. A main section that is no known numeral, or the last known one, has no successor and is not left.
    """
    texts = pages.select("report_id", "page_idx", F.substring("text", 1, 500).alias("t"), F.array_join(F.slice(F.split("text", "\n"), 1, 3), "\n").alias("lines3"), F.regexp_replace("text", r"(?U)^\s+", "").startswith("<table>").alias("table"))
    state = texts.join(refs.where("size(sub_notes) > 0"), "report_id")
    order = Window.partitionBy("report_id").orderBy("page_idx").rowsBetween(Window.unboundedPreceding, 0)
    prefix = F.col("main_section").isNotNull()
    following = F.create_map(*[x for a, b in zip(NUMERALS, NUMERALS[1:], strict=False) for x in (F.lit(a), F.lit(f"{b}、"))])
    entry = F.when(prefix, F.substring("t", 1, 60).contains(F.concat("main_section", F.lit("、")))).otherwise(F.lit(True))
    state = state.withColumn("inside", F.max(entry).over(order))
    leaves = F.col("inside") & F.coalesce(F.col("lines3").contains(F.element_at(following, F.col("main_section"))), F.lit(False))
    state = state.withColumn("active", F.col("inside") & ~F.max(leaves).over(order)).where("active")
    number = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit("")).cast("int")
    m1 = number(F.col("t"), r"(?U)(?:^|\n)\s*([0-9]{1,2})[、.\s]")
    m2 = number(F.substring("t", 1, 200), r"(?U)[（(]续[）)].*?([0-9]{1,2})[、.\s]")
    numeral = F.regexp_extract(F.substring("t", 1, 60), rf"(?:^|\n)({either(sorted(NUMERALS, key=len, reverse=True))})[、.]", 1)
    m3 = F.when(~prefix & (numeral != ""), F.array_position(F.array(*[F.lit(x) for x in NUMERALS]), numeral).cast("int"))
    start = F.when(prefix & (F.row_number().over(Window.partitionBy("report_id").orderBy("page_idx")) == 1), F.array_min("sub_notes"))
    state = state.withColumn("said", F.coalesce(m3, m2, m1, start)).withColumn("segment", F.count("said").over(order)).withColumn("now", F.last("said", ignorenulls=True).over(order))
    fired = F.max("table").over(Window.partitionBy("report_id", "segment").orderBy("page_idx").rowsBetween(Window.unboundedPreceding, 0))
    late = ~prefix & F.col("first_bs_note").isNotNull() & (F.col("now").isNull() | (F.col("now") < F.col("first_bs_note"))) & fired
    state = state.withColumn("note", F.when(late, F.col("first_bs_note")).otherwise(F.col("now")))
    kept = state.where(F.array_contains("sub_notes", F.col("note"))).select("report_id", "page_idx")
    bound = refs.where("size(sub_notes) > 0").select("report_id")
    return kept.unionByName(pages.select("report_id", "page_idx").join(bound, "report_id", "left_anti"))


def subtoc_pages(pages: DataFrame) -> DataFrame:
    """(report_id, name, page_idx): page numbers of the statements from the first page that lists at least two of them."""
    tail = SUBTOC_TAIL
    found = [F.when(F.col("text").rlike(n + tail), F.struct(F.lit(n).alias("name"), (F.regexp_extract("text", n + tail, 1) == "P").alias("relative"), F.regexp_extract("text", n + tail, 2).cast("int").alias("no"))) for n in SUBTOC_NAMES]
    lists = pages.select("report_id", F.col("page_idx").alias("at"), F.array_compact(F.array(*found)).alias("found")).where("size(found) >= 2")
    first = lists.groupBy("report_id").agg(F.min("at").alias("at"), F.min_by("found", "at").alias("found"))
    number = F.when(F.exists("found", lambda x: x.relative), F.col("at")).otherwise(0) + F.col("x.no")
    return first.select("report_id", "at", "found", F.explode("found").alias("x")).select("report_id", "x.name", number.alias("page_idx"))


def strip_noise(text: Column, noise: Column | None = None, footer: bool = False) -> Column:
    """The text without furniture and short garble at its head (or foot), if one of the outer lines is furniture.

    At most NOISE_DEPTH lines go; otherwise the text is unchanged.
    """
    rows = F.split(text, "\n")
    rows = F.reverse(rows) if footer else rows
    outer = F.slice(rows, 1, NOISE_DEPTH)
    found = F.exists(outer, lambda x: (strip(x) != "") & is_furniture(x, noise))
    stays = F.transform(outer, lambda x: ~(is_furniture(x, noise) | is_short_garble(x)))
    cut = F.coalesce(F.nullif(F.array_position(stays, True), F.lit(0)) - 1, F.size(outer).cast("long"))
    rest = F.slice(rows, (cut + 1).cast("int"), F.size(rows))
    return F.when(found, strip(F.array_join(F.reverse(rest) if footer else rest, "\n"))).otherwise(text)
