"""Section types, anchors and patterns. All of these are fixed values of the reports' formats."""

from __future__ import annotations

import re
from dataclasses import dataclass

STATEMENT_PATTERNS = ("合并资产负债表", "Consolidated Balance Sheet", "Balance Sheet")
NOTES_PATTERNS = ("财务报表附注", "Notes to the Financial Statements")
#: (text in a TOC title, pattern near the top of a body page), in order of trust.
OFFSET_ANCHORS = (
    ("合并资产负债表", "合并资产负债表"),
    ("合并利润表", "合并利润表"),
    ("财务报表附注", "财务报表附注"),
    ("管理层讨论与分析", "管理层讨论与分析"),
    ("业绩综述", "业绩综述"),
)
#: Lines that are page furniture in any report, as full matches.
FURNITURE = ("[0-9]{1,4}", "二零[二三四五六七八九零〇]+年年报", "20[0-9]{2}年年度报告", "关于我们", "财务报表", "审计报告")


@dataclass(frozen=True)
class Section:
    toc: tuple[str, ...]
    body: tuple[str, ...] = ()
    stop: tuple[str, ...] = ()
    subtoc: tuple[str, ...] = ()
    merge: bool = False


SECTIONS = {
    "management-discussion": Section(
        ("管理层讨论与分析", "经营业绩回顾与分析", "经营情况讨论", "业绩综述", "管理层分析", "经营业绩", "经营分析"),
        ("管理层讨论与分析", "经营业绩回顾与分析", "业绩综述", "经营情况讨论"),
        ("内含价值", "公司治理", "董事会报告"),
        merge=True,
    ),
    "balance-sheet": Section(
        ("合并资产负债表",),
        ("合并资产负债表", "合并及公司资产负债表", "资产.{1,40}附注.{1,40}合并", "资产.{1,40}附注[一二三四五六七八九十]+.{1,80}20[0-9]{2}年12月31日"),
        ("合并.*利润表", "合并损益表", "合并利润及其他综合收益表"),
        ("合并及公司资产负债表", "合并资产负债表"),
    ),
    "income-statement": Section(
        ("合并利润表", "合并损益表", "合并利润及其他综合收益表", "Consolidated.*Income", "Consolidated.*Profit"),
        ("合并.*利润表", "合并损益表", "合并利润及其他综合收益表"),
        ("合并股东权益变动表", "合并.*现金流量表", "合并综合收益表"),
        ("合并及公司利润表", "合并利润表"),
    ),
    "financial-notes": Section(
        ("财务报表附注", "合并财务报表项目附注", "Notes to.*Financial"),
        ("财务报表附注", "合并财务报表项目附注"),
        ("附录.*财务报表补充资料", "财务报表补充资料"),
        ("财务报表附注",),
    ),
}


@dataclass(frozen=True)
class Theme:
    keywords: tuple[str, ...]
    note_start: tuple[str, ...] = ()
    note_stop: tuple[str, ...] = ()


def section(name: str) -> Section:
    """A known section type, or one whose titles hold the name itself."""
    return SECTIONS.get(name) or Section((re.sub(r"([^\w\s])", r"\\\1", name),))  # a free title stands for itself


def theme(name: str, themes: dict[str, Theme]) -> Theme:
    """The named theme; ValueError that lists the known ones otherwise."""
    if name not in themes:
        raise ValueError(f"unknown theme {name!r}; known: {', '.join(sorted(themes))}")
    return themes[name]
