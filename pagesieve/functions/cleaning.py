"""Cleaning of page text: rules as pairs of a pattern and a replacement, applied by column functions, and by a plain
function inside the table helper. Digits and white space in the patterns are Unicode's."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import LINE_BREAKS, strip

Rule = tuple[str, str]

# Patterns and replacements of the reports' residue: fixed values.
SPACED_NUMBER: tuple[Rule, ...] = ((r"(?<=\d)\s+(?=[\d.%])", ""), (r"(?<=\.)\s+(?=\d)", ""))
SPACED_LETTERS = r"(?<![A-Za-z])(?:[A-Za-z]\s+){1,5}[A-Za-z](?![A-Za-z])"
FORMULA_SYMBOLS: tuple[Rule, ...] = (
    (r"\\%", "%"), (r"\\cdot", "·"), (r"\\times", "x"),
    (r"\\\^\s*\{\s*\+\s*\}", "+"), (r"\\\^\s*\+", "+"), (r"\^\s*\{\s*\+\s*\}", "+"), (r"\^\s*\+", "+"),
    (r"\\(?:mathsf|mathrm|text|operatorname)\s*", ""), (r"[{}]", " "), (r"\\", ""),
)
FORMULA_SPACES: tuple[Rule, ...] = ((r"\s+([%.,;:])", "$1"), (r"([(\"“])\s+", "$1"), (r"\s+([)\"”])", "$1"), (r"\s{2,}", " "))
FORMULA, CENTRE_DOT = r"(?s)\$.+?\$", r"\$\s*\\cdot\s*\$"
_DATE = r"(?<!\d)(20\d{2})(?:0([1-9])|(1[0-2]))(?:0([1-9])|([12]\d|3[01]))"
_DAY = "$1年$2$3月$4$5日"
_AMOUNT = r"(\d{1,3}(?:,\d{3})+(?:\.\d+)?)"
_WHOLE = r"(\d{1,3}(?:,\d{3})+)"
#: Before an amount such as 12.345.67, whose first point stands for a comma: it is no part of a network address. In a chain of four numbers or more
#: its middle one is then above 255; the ends of a chain do not tell, as other numbers may be glued to them.
_NO_ADDRESS = r"(?:(?<!\d\.)|(?=\d+\.(?:25[6-9]|2[6-9]\d|[3-9])))(?!\d+\.(?:[01]|2[0-4]|25[0-5])\d*\.\d+\.\d)"
#: One round over a line, in groups: what a text must hold for a group's rules to find anything, and the rules. Three rounds are made.
_GROUPED = r"\d,\d{3}"
RESIDUE: tuple[tuple[str, tuple[Rule, ...]], ...] = (
    (r"20\d{2}", ((r"(?<!\d)(20\d{2})\1年", "$1年"), (rf"{_DATE}(?=\d)", f"{_DAY} "), (rf"{_DATE}(?!\d)", _DAY))),
    (_GROUPED, (
        (rf"{_AMOUNT}(?=20\d{{2}}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01]))", "$1 / "), (rf"{_AMOUNT}(?=人民币)", "$1 / "),
        (rf"{_WHOLE}(?=\d{{1,3}}(?:,\d{{3}})+)", "$1 / "), (rf"{_WHOLE}(?=\d{{1,3}}(?:,\d{{3}})+\.\d)", "$1 / "),
        (r"(\d{1,3}(?:,\d{3})+\.\d+)(?=\d+(?:\.\d+)?%)", "$1 / "), (rf"{_WHOLE}(?=(?:\d{{1,3}}(?:,\d{{3}})+(?!\d)|\d+(?:\.\d+)?%))", "$1 / "),
    )),
    (r"\d\.\d{3}\.\d{2}", ((rf"(?<!\d){_NO_ADDRESS}(\d{{1,2}})\.(\d{{3}}\.\d{{2}})(?!\d)", "$1,$2"),)),
    (r"日\d", ((r"(?<=日)(?=\d)", " "),)),
    (_GROUPED, ((rf"{_AMOUNT}(?=20\d{{2}}年)", "$1 / "),)),
    (r"%\d", ((r"(?<=%)(?=\d+-\d+年)", " / "),)),
)
LINE_END: tuple[Rule, ...] = ((r"(?<!\d)(\d{1,3}(?:,\d{3})+)(\d{2,3})(?=\n|\Z)", "$1"), (r"[^\S\n]{2,}", " "))
SYMBOL_SPACES: tuple[Rule, ...] = ((r"\s+([%.,;:])", "$1"), (r"\(\s+", "("), (r"\s+\)", ")"), (r"\n{3,}", "\n\n"))
POLISH: tuple[Rule, ...] = (
    (r"\+\s*/\s*-\s*", "+/- "), (r"(?<=[\u4e00-\u9fff])\s*/\s*(?=[\u4e00-\u9fff])", "/"), (r"(\d+(?:\.\d+)?%)\s+(?=\d+(?:\.\d+)?%)", "$1、"),
    (rf"{_AMOUNT}\s*/\s*{_AMOUNT}\s*/\s*(\d+(?:\.\d+)?%)", "$1，$2，$3"), (rf"{_AMOUNT}\s*/\s*{_AMOUNT}", "$1，$2"), (rf"{_AMOUNT}\s*/\s*(\d+(?:\.\d+)?%)", "$1，$2"),
    (rf"{_AMOUNT}\s*/\s*(20\d{{2}}年)", "$1，$2"), (rf"{_AMOUNT}\s*/\s*人民币", "$1，人民币"), (r"(?<=\d)%\s+([，。；：])", "%$1"), (r"(?<=\d)\s+([，。；：])", "$1"),
    (r"([（(])\s+", "$1"), (r"\s+([）)])", "$1"), (r"(?<=\S)\s{2,}", " "), (r"^-  ", "- "),
)
#: Running headers that one company's notes carry on every page; others can be given.
RUNNING_HEADERS = (r"\n?财务报表\s*\n?二零二五年年报\s*\n?中国平安保险（集团）股份有限公司\s*\n?", r"\n?二零二五年年报\s*\n?中国平安保险（集团）股份有限公司\s*\n?")
# What a text must hold for these rules to find anything; one look in place of all of them.
RESIDUE_SIGNS = "|".join(dict.fromkeys(sign for sign, _ in RESIDUE))
NUMBER_SIGNS, SYMBOL_SIGNS = r"\d\s+[\d.%]|\.\s+\d", r"\s[%.,;:)]|\(\s|\n{3}"
#: A compact date with blanks between its digits; a number of up to four digits alone on a text's last line, below a digit; a code point of no text.
SPACED_DATE = r"(?<!\d)2\s*0\s*\d\s*\d\s*(?:0\s*[1-9]|1\s*[0-2])\s*(?:0\s*[1-9]|[12]\s*\d|3\s*[01])"
PAGE_NUMBER, MARK = rf"\d(?=\s*?(?:{LINE_BREAKS}))\s+\d{{1,4}}\s*\Z", "\ufdd0"
POLISH_SIGNS = r"/|%\s|\d\s+[，。；：]|[（(]\s|\s[）)]|\s{2}"


def _java(pattern: str) -> str:
    return "(?U)" + pattern.replace(r"\Z", r"\z")


def apply(c: Column, rules: Iterable[Rule]) -> Column:
    return reduce(lambda x, r: F.regexp_replace(x, _java(r[0]), r[1]), rules, c)


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once, however often f uses it."""
    return F.transform(F.array(c), f)[0]


def made_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is made once for each row. A generator gives it, as filters on it then stay above; below they would make it again."""
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, F.explode(F.array(value)).alias(name))


def replace_each(c: Column, pattern: str, f: Callable[[Column], Column]) -> Column:
    """Every match of a pattern (never an empty one) replaced by a function of it; texts without a match are left as they are."""

    def replaced(x: Column) -> Column:
        pieces, found = F.split(x, pattern, -1), F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
        joined = F.array_join(F.zip_with(pieces, F.transform(found, f), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        return F.when(x.rlike(pattern), joined).otherwise(x)

    return bound(c, replaced)


def where_signs(c: Column, signs: str, f: Callable[[Column], Column]) -> Column:
    """f of the texts that hold the signs; the others are left as they are."""
    return bound(c, lambda x: F.when(x.rlike(_java(signs)), f(x)).otherwise(x))


def unified_lines(c: Column) -> Column:
    """All line breaks as newlines; one at the end of the text goes."""
    others = LINE_BREAKS.replace(r"\n", "")
    same = where_signs(c, others, lambda x: F.regexp_replace(x, LINE_BREAKS, "\n"))
    return bound(same, lambda x: F.when(x.endswith("\n"), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x))


def collapse_spaced_letters(c: Column) -> Column:
    """Two to six single letters with blanks between them become a word."""
    return replace_each(c, _java(SPACED_LETTERS), lambda m: F.regexp_replace(m, r"(?U)\s+", ""))


def normalize_formula(c: Column) -> Column:
    """The plain text of a formula's inside."""
    c = apply(apply(strip(c), FORMULA_SYMBOLS), SPACED_NUMBER)
    return strip(apply(collapse_spaced_letters(c), FORMULA_SPACES))


def _residue_round(c: Column) -> Column:
    return reduce(lambda x, group: where_signs(x, group[0], lambda y: apply(y, group[1])), RESIDUE, c)


def _residue_rounds(c: Column, rounds: int = 3) -> Column:
    """A round that changes nothing is the last."""
    pair = lambda before, now: F.struct(before.alias("before"), now.alias("now"))
    again = lambda at, _: F.when(at["before"].eqNullSafe(at["now"]), at).otherwise(pair(at["now"], _residue_round(at["now"])))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), pair(F.lit(None).cast("string"), c), again, lambda at: at["now"])


def clean_ocr_residue(c: Column) -> Column:
    """Repeated years, compact dates, glued amounts and dangling page numbers of every line."""
    c = unified_lines(F.replace(c, F.lit("\uffa0"), F.lit(" ")))
    c = where_signs(c, RESIDUE_SIGNS, lambda x: apply(_residue_rounds(x), LINE_END[:1]))
    return apply(c, LINE_END[1:])


def clean_special_symbols(c: Column) -> Column:
    """Formulas as text, spaced numbers, residue, and blanks before signs; null counts as empty."""

    def formulas(x: Column) -> Column:
        return replace_each(F.regexp_replace(x, _java(CENTRE_DOT), "- "), FORMULA, lambda m: normalize_formula(F.substring(m, F.lit(2), F.length(m) - 2)))

    c = where_signs(F.coalesce(c, F.lit("")), r"\$", formulas)
    c = clean_ocr_residue(where_signs(c, NUMBER_SIGNS, lambda x: apply(x, SPACED_NUMBER)))
    return strip(where_signs(c, SYMBOL_SIGNS, lambda x: apply(x, SYMBOL_SPACES)))


def clean_page_symbols(c: Column) -> Column:
    """clean_special_symbols() of a whole page: an amount and the page's number below it, whose digits are joined, make no date."""
    apart = lambda m: F.regexp_replace(m, _java(r"\s+(?=\d+\Z)"), MARK)
    c = where_signs(c, PAGE_NUMBER, lambda x: replace_each(x, _java(rf"{SPACED_DATE}(?=\d{{0,3}}\s*\Z)"), apart))
    return where_signs(clean_special_symbols(c), MARK, lambda x: F.regexp_replace(x, _java(rf"(?<=\d){MARK}(?=\d)"), ""))


def polish_readability(c: Column) -> Column:
    """Signs between amounts and blanks in every line that is no table row; null counts as empty."""

    def line(x: Column) -> Column:
        return bound(F.regexp_replace(x, r"(?U)\s+\z", ""), lambda y: F.when((y.startswith("|") & y.endswith("|")) | ~y.rlike(_java(POLISH_SIGNS)), y).otherwise(apply(y, POLISH)))

    def text(x: Column) -> Column:
        by_line = F.array_join(F.transform(F.split(x, "\n"), line), "\n")
        return F.when(x.rlike(_java(POLISH_SIGNS)), by_line).otherwise(F.regexp_replace(x, r"(?U)[^\S\n]+(?=\n|\z)", ""))

    return strip(F.regexp_replace(bound(unified_lines(F.coalesce(c, F.lit(""))), text), r"\n{3,}", "\n\n"))


def clean_note_text(c: Column, headers: Sequence[str] = RUNNING_HEADERS) -> Column:
    """Text in which keywords are looked for: symbols cleaned, running headers and lines of a bare number removed."""
    c = clean_special_symbols(c)
    if headers:
        c = where_signs(c, "|".join(f"(?:{h})" for h in headers), lambda x: apply(x, [(h, "\n") for h in headers]))
    c = F.regexp_replace(c, r"(?mdU)^\d{1,3}\s*$", "")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def may_appear(text: Column, word: str) -> Column:
    """Whether clean_note_text() of a text may hold a word: where the text does, or where cleaning may make it.

    Cleaning makes words of letters only in formulas; it may make others of digits, blanks, dates and signs anywhere.
    """
    if re.search(r"[\W\d_年月日x]", word):
        return F.lit(True)
    return text.contains(word) | text.contains("$")


def normalize_lookup(c: Column) -> Column:
    """The form in which terms are looked for in blocks: no blanks, no separators, ASCII brackets, lower case."""
    c = F.translate(clean_note_text(c), "（）", "()")
    return F.lower(F.regexp_replace(c, r"(?U)[：:\-·•,，。；;、\s]+", ""))


_COMPILED: dict[str, re.Pattern] = {}


def plain(text: str, rules: Iterable[Rule]) -> str:
    for pattern, new in rules:
        found = _COMPILED.get(pattern) or _COMPILED.setdefault(pattern, re.compile(pattern))
        text = found.sub(re.sub(r"\$(\d)", r"\\\1", new), text)
    return text


def plain_special_symbols(text: str) -> str:
    """clean_special_symbols for one string, as the table helper needs it."""

    def formula(m: re.Match) -> str:
        inside = plain(plain(m[0][1:-1].strip(), FORMULA_SYMBOLS), SPACED_NUMBER)
        inside = re.sub(SPACED_LETTERS, lambda x: re.sub(r"\s+", "", x[0]), inside)
        return plain(inside, FORMULA_SPACES).strip()

    text = re.sub(FORMULA, formula, plain(text, ((CENTRE_DOT, "- "),)))
    text = "\n".join(plain(text, SPACED_NUMBER).replace("\uffa0", " ").splitlines())
    rounds = [rule for _, rules in RESIDUE for rule in rules] * 3
    return plain(text, (*(rounds if re.search(RESIDUE_SIGNS, text) else ()), *LINE_END, *SYMBOL_SPACES)).strip()
