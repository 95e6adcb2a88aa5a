"""Guard-model output: label text, categories, and per-token category arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievemark.functions.text import WS, strip

# The labelled-text format of a guard model.
SAFETY_PATTERN = r"Safety:\s*(Safe|Unsafe|Controversial)"
REFUSAL_PATTERN = r"Refusal:\s*(Yes|No)"
CATEGORIES = (
    "Violent",
    "Non-violent Illegal Acts",
    "Sexual Content or Sexual Acts",
    "PII",
    "Suicide & Self-Harm",
    "Unethical Acts",
    "Politically Sensitive Topics",
    "Copyright Violation",
    "Jailbreak",
    "None",
)
PII_CATEGORY = "PII"


def _labelled(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, "(?iuU)" + pattern.replace(r"\s", WS), 1)
    return F.nullif(found, F.lit(""))


def safety_label(text: Column) -> Column:
    return _labelled(text, SAFETY_PATTERN)


def refusal_label(text: Column) -> Column:
    return _labelled(text, REFUSAL_PATTERN)


def categories_in(text: Column) -> Column:
    """Category names anywhere in the text, in order, each spelling once."""
    pattern = "(?iu)(" + "|".join(CATEGORIES) + ")"
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 1))
    return found


def parse_guard_text(text: Column) -> Column:
    """Struct of risk level, categories and refusal read from a labelled text."""
    return F.struct(
        safety_label(text).alias("risk_level"),
        categories_in(text).alias("categories"),
        refusal_label(text).alias("refusal"),
    )


def is_pii_category(text: Column) -> Column:
    """The category text names PII anywhere, in any case; null and empty do not."""
    return F.coalesce(F.contains(F.upper(text), F.lit(PII_CATEGORY)), F.lit(False))


def has_pii_category(text: Column, parsed: Column) -> Column:
    """A non-empty parsed list decides by equality, otherwise the text decides."""
    return F.when(
        F.size(parsed) > 0,
        F.exists(parsed, lambda c: F.upper(strip(c)) == PII_CATEGORY),
    ).otherwise(is_pii_category(text))


def pick(values: Column, index: Column | int) -> Column:
    """Element at a 0-based index, the last one past the end, '' for an empty array."""
    position = (F.lit(index) if isinstance(index, int) else index) + 1
    return F.when(
        F.size(values) > 0,
        F.coalesce(F.element_at(values, F.least(position, F.size(values)).cast("int")), F.lit("")),
    ).otherwise(F.lit(""))


def last_item(values: Column) -> Column:
    return F.when(
        F.size(values) > 0, F.coalesce(F.try_element_at(values, F.lit(-1)), F.lit(""))
    ).otherwise(F.lit(""))


def first_pii_index(categories: Column) -> Column:
    """0-based index of the first PII category in an array; null if there is none."""
    hit = F.array_position(F.transform(categories, is_pii_category), F.lit(True))
    return F.when(hit > 0, (hit - 1).cast("bigint"))


def reason_text(risk_level: Column, category: Column, refusal: Column) -> Column:
    """``k=v; k=v`` over the parts that are not empty."""

    def part(name: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(f"{name}="), value))

    return F.concat_ws(
        "; ",
        part("risk_level", risk_level),
        part("category", category),
        part("refusal", refusal),
    )
