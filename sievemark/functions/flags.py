"""Obvious-PII predicates: regex rules, keywords, and their union."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A named regex. ``guard`` is a cheaper regex every hit must also satisfy.

    Most texts fail the guard, so the costly expression seldom runs.
    """

    name: str
    pattern: str
    guard: str | None = None


# The default regex rules and keywords.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
MOBILE_11 = r"(?<!\d)1[3-9]\d{9}(?!\d)"
ID_18 = r"(?<!\d)\d{17}[\dXx](?!\d)"
ID_15 = r"(?<!\d)\d{15}(?!\d)"
KEYWORDS = (
    "身份證",
    "身分證",
    "證件號",
    "護照號",
    "郵箱",
    "邮箱",
    "email",
    "手機",
    "手机号",
    "電話號碼",
    "聯絡電話",
    "住址",
    "地址",
    "銀行帳號",
)

LONG_NUMBER = r"\d{11}"
DEFAULT_RULES = (
    Rule("email", EMAIL, "@"),
    Rule("mobile_11", MOBILE_11, LONG_NUMBER),
    Rule("id_18", ID_18, LONG_NUMBER),
    Rule("id_15", ID_15, LONG_NUMBER),
)
IPV4_RULE = Rule("ipv4", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", r"\d\.\d")
CARD_16_RULE = Rule("digits_16", r"(?<!\d)\d{16}(?!\d)", LONG_NUMBER)


def _any(conditions: Iterable[Column]) -> Column:
    parts = list(conditions)
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def java_pattern(rule: Rule) -> str:
    r"""``\d`` and ``\w`` in their Unicode sense (full-width digits count)."""
    return f"(?U){rule.pattern}"


def _guard(col: Column, guard: str) -> Column:
    if guard.isalnum() or guard == "@":
        return F.contains(col, F.lit(guard))
    return col.rlike(f"(?U){guard}")


def rule_flag(col: Column, rule: Rule) -> Column:
    hit = col.rlike(java_pattern(rule))
    return hit if rule.guard is None else _guard(col, rule.guard) & hit


def any_rule(col: Column, rules: Iterable[Rule] = DEFAULT_RULES) -> Column:
    """True if any rule matches; rules sharing a guard are tested behind it once."""
    by_guard: dict[str | None, list[Column]] = {}
    for rule in rules:
        by_guard.setdefault(rule.guard, []).append(col.rlike(java_pattern(rule)))
    return _any(
        _any(hits) if guard is None else _guard(col, guard) & _any(hits)
        for guard, hits in by_guard.items()
    )


def any_keyword(col: Column, keywords: Iterable[str] = KEYWORDS) -> Column:
    """Case-insensitive substring test for a list of keywords.

    Keywords of a script without case are searched in the text as it is, behind one
    scan for the range of their first characters; only the others need the lowered text.
    """
    words = list(dict.fromkeys(k for k in keywords if k))
    caseless = [k for k in words if k.lower() == k.upper()]
    cased = [k.lower() for k in words if k.lower() != k.upper()]
    found = _any(F.contains(F.lower(col), F.lit(k)) for k in cased)
    if caseless:
        # One character range is far cheaper for the regex engine than a list.
        low, high = (f"\\x{{{ord(edge(k[0] for k in caseless)):x}}}" for edge in (min, max))
        guard = col.rlike(f"[{low}-{high}]")
        found = found | (guard & _any(F.contains(col, F.lit(k)) for k in caseless))
    return found


def has_obvious_pii(
    col: Column,
    rules: Iterable[Rule] = DEFAULT_RULES,
    keywords: Iterable[str] = KEYWORDS,
) -> Column:
    """Rule or keyword hit. An empty or null text counts as PII (never a safe sample)."""
    text = F.coalesce(col, F.lit(""))
    return (text == "") | any_rule(text, rules) | any_keyword(text, keywords)
