"""PII flags and PII spans over a table of texts."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.functions.flags import (
    DEFAULT_RULES,
    KEYWORDS,
    Rule,
    any_keyword,
    any_rule,
    java_pattern,
    rule_flag,
)


def pii_regex_flags(df: DataFrame, col: str, rules: Iterable[Rule] = DEFAULT_RULES) -> DataFrame:
    """One boolean column per rule, named ``has_<rule>``."""
    return df.withColumns({f"has_{r.name}": rule_flag(F.col(col), r) for r in rules})


def pii_flags(
    df: DataFrame,
    col: str,
    rules: Iterable[Rule] = DEFAULT_RULES,
    keywords: Iterable[str] = KEYWORDS,
) -> DataFrame:
    """Rule hit, keyword hit, and the union of both (empty text counts as PII).

    The union is taken of the two computed columns, and the rule hit of the columns of
    ``pii_regex_flags`` where the table has them all, so no pattern runs twice.
    """
    rules, keywords = tuple(rules), tuple(keywords)
    text = F.col(col)
    flags = [f"has_{r.name}" for r in rules]
    known = bool(flags) and all(dict(df.dtypes).get(f) == "boolean" for f in flags)
    hit = reduce(or_, map(F.col, flags)) if known else any_rule(text, rules)
    either = F.col("regex_pii") | F.col("keyword_pii")
    return df.withColumns(
        {"regex_pii": hit, "keyword_pii": any_keyword(text, keywords)}
    ).withColumn("obvious_pii", (F.coalesce(text, F.lit("")) == "") | either)


def pii_spans(
    df: DataFrame, id_col: str, col: str, rules: Iterable[Rule] = DEFAULT_RULES
) -> DataFrame:
    """Every hit as a row (id, rule, pos, fragment); ``pos`` counts hits per rule and text.

    One pass over the table: all rules are listed per row and exploded in place,
    texts without any hit leave before the explode.
    """
    rules = tuple(rules)
    text = F.col(col)
    per_rule = F.array(
        *[
            F.struct(
                F.lit(r.name).alias("rule"),
                F.regexp_extract_all(text, F.lit(java_pattern(r)), 0).alias("fragments"),
            )
            for r in rules
        ]
    )
    return (
        df.where(any_rule(text, rules))
        .select(F.col(id_col), F.explode(per_rule).alias("hit"))
        .select(id_col, F.col("hit.rule").alias("rule"), F.posexplode("hit.fragments"))
        .select(id_col, "rule", "pos", F.col("col").alias("fragment"))
    )
