"""Turn messy model answers into typed decisions.

Functions that start from raw text and need the parsed JSON object work on the
struct produced by ``with_json_object``: the parse is one projection of its own,
so Catalyst evaluates it once however many fields are read from it.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemark.functions.text import JSON_WHITESPACE, WHITESPACE, WS, clean, strip
from sievemark.session import with_computed

# Answer keys in order of priority, accepted words, labels.
DECISION_KEYS = ("contains_pii", "has_pii", "pii", "prediction", "label", "result")
YES_WORDS = ("是", "有", "yes", "true", "1", "y")
NO_WORDS = ("否", "無", "no", "false", "0", "n")
TRUTH_WORDS = ("是", "yes", "true", "1", "有")
LABEL_YES, LABEL_NO, LABEL_UNPARSEABLE = "是", "否", "無法解析"
EMPTY_REASON = "empty content"

# Free-text answers, negative forms are tried before positive ones.
NO_PATTERNS = (
    r"^否\s*$",
    r"^否[。.，,]",
    r"[：:]\s*否",
    r"不含有\s*PII",
    r"不包含\s*PII",
    r"無\s*PII",
    r"沒有\s*PII",
    r"no",
    r"false",
    r"^無$",
)
YES_PATTERNS = (
    r"^是\s*$",
    r"^是[。.，,]",
    r"[：:]\s*是",
    r"含有\s*PII",
    r"包含\s*PII",
    r"有\s*PII",
    r"存在\s*PII",
    r"yes",
    r"true",
    r"^有$",
)
FREE_TEXT_CHARS = 80

PAYLOAD_KEYS = (*DECISION_KEYS, "confidence", "reason", "raw_text", "non_pii_text")
PAYLOAD_TYPE = ", ".join(f"{k}: variant" for k in PAYLOAD_KEYS)
NORMALIZED_TYPE = (
    "struct<contains_pii: boolean, label: string, confidence: double, "
    "reason: string, raw_text: string>"
)


# --- JSON objects ---------------------------------------------------------


def braced(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; null if there is no such span."""
    first = F.instr(text, "{")
    last = F.length(text) - F.instr(F.reverse(text), "}") + 1
    return F.when(
        (first > 0) & F.contains(text, F.lit("}")) & (last > first),
        F.substring(text, first, last - first + 1),
    )


def _wrapped(text: Column) -> Column:
    # from_json tolerates trailing text. Put into an envelope whose last field is
    # a hash of the text itself, trailing text breaks the envelope.
    seal = F.xxhash64(text).cast("string")
    return F.concat(F.lit('{"body":'), text, F.lit(',"seal":'), seal, F.lit("}"))


def _from_envelope(text: Column, body_type: str) -> Column:
    return F.from_json(
        _wrapped(text),
        f"body {body_type}, seal bigint, broken string",
        {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "broken"},
    )


def _accepted(parsed: Column, text: Column) -> Column:
    return F.when(
        parsed["broken"].isNull() & (parsed["seal"] == F.xxhash64(text)), parsed["body"]
    )


def with_strict_object(df: DataFrame, text: Column, out: str) -> DataFrame:
    """Add ``out``: the known keys of ``text`` as variants, null unless ``text`` is
    exactly one valid JSON object. A repeated key keeps its last value, at any depth:
    for variants that is a setting of the session, which is turned on here.
    """
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    tmp, src = f"__{out}_parsed", f"__{out}_text"
    return (
        df.withColumn(src, F.when(F.startswith(F.ltrim(text), F.lit("{")), text))
        .withColumn(tmp, _from_envelope(F.col(src), f"struct<{PAYLOAD_TYPE}>"))
        .withColumn(out, _accepted(F.col(tmp), F.col(src)))
        .drop(tmp, src)
    )


def valid_non_object(df: DataFrame, text: Column, out: str) -> DataFrame:
    """Add boolean ``out``: the text is valid JSON but an array or a string.

    Other scalars cannot contain an object, so they need no test here.
    """
    tmp, src = f"__{out}_parsed", f"__{out}_text"
    starts = F.substring(text, 1, 1).isin("[", '"')
    return (
        df.withColumn(src, F.when(starts, text))
        .withColumn(tmp, _from_envelope(F.col(src), "string"))
        .withColumn(out, F.coalesce(_accepted(F.col(tmp), F.col(src)).isNotNull(), F.lit(False)))
        .drop(tmp, src)
    )


def with_json_object(df: DataFrame, raw: Column, out: str, generator_form: bool = False) -> DataFrame:
    """Add ``out``: the JSON object found in a model answer, plain, fenced or in prose.

    The widest ``{...}`` span must be one valid object: a whole-text object is its
    own widest span, and a code fence holds no braces. The generator form differs
    in one case: a text that is valid JSON but not an object yields null at once.
    """
    text = clean(raw)
    found = with_strict_object(df, braced(text), out)
    if not generator_form:
        return found
    fenceless = strip(
        F.regexp_replace(
            F.regexp_replace(text, f"(?iU)^```(?:json)?{WS}*", ""), f"(?U){WS}*```$", ""
        )
    )
    flag = f"__{out}_other"
    return (
        valid_non_object(found, fenceless, flag)
        .withColumn(out, F.when(~F.col(flag), F.col(out)))
        .drop(flag)
    )


# --- values -----------------------------------------------------------------


def variant_text(value: Column) -> Column:
    """String content of a JSON string, null for any other JSON type."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _is_number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL"))


def coerce_text(col: Column) -> Column:
    """Boolean meaning of a yes/no word; null if it is neither."""
    word = F.lower(strip(col))
    return F.when(word.isin(*YES_WORDS), F.lit(True)).when(word.isin(*NO_WORDS), F.lit(False))


def _sql_words(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def decision(payload: str) -> Column:
    """First decision key of the payload column whose value has a boolean meaning:
    booleans, the numbers 1 and 0, yes/no words.

    Written as one SQL text: six keys as column calls would cost more time to build
    than to run on a small table.
    """

    def meaning(key: str) -> str:
        value = f"{payload}.{key}"
        word = f"lower(btrim(try_variant_get({value}, '$', 'string'), '{WHITESPACE}'))"
        number = f"try_variant_get({value}, '$', 'double')"
        return f"""CASE
            WHEN schema_of_variant({value}) = 'BOOLEAN' THEN try_variant_get({value}, '$', 'boolean')
            WHEN schema_of_variant({value}) = 'STRING' THEN
              CASE WHEN {word} IN ({_sql_words(YES_WORDS)}) THEN true
                   WHEN {word} IN ({_sql_words(NO_WORDS)}) THEN false END
            WHEN schema_of_variant({value}) IN ('BIGINT', 'DOUBLE', 'FLOAT')
              OR startswith(schema_of_variant({value}), 'DECIMAL') THEN
              CASE WHEN {number} = 1 THEN true WHEN {number} = 0 THEN false END
            END"""

    return F.expr(f"coalesce({', '.join(map(meaning, DECISION_KEYS))})")


def truth_from_text(col: Column) -> Column:
    """Ground truth written as text: the listed words are True, everything else False."""
    return F.coalesce(F.lower(strip(col.cast("string"))).isin(*TRUTH_WORDS), F.lit(False))


def label_of(flag: Column) -> Column:
    return (
        F.when(flag, F.lit(LABEL_YES))
        .when(~flag, F.lit(LABEL_NO))
        .otherwise(F.lit(LABEL_UNPARSEABLE))
    )


# --- fields of a cut-off answer ---------------------------------------------


def _field_pattern(key: str, value: str) -> str:
    return f'(?iuU)"{key}"{WS}*:{WS}*{value}'


def partial_text(raw: Column, key: str) -> Column:
    """String field of a possibly cut-off JSON text; empty if absent."""
    return strip(F.regexp_extract(raw, _field_pattern(key, r'"([^"\n\r}]*)'), 1))


def partial_number(raw: Column, key: str) -> Column:
    """Numeric field of a possibly cut-off JSON text; null if absent."""
    pattern = _field_pattern(key, r"([+-]?\d+(?:\.\d+)?)")
    return F.regexp_extract(raw, pattern, 1).try_cast("double")


def partial_decision(raw: Column) -> Column:
    """Decision from a cut-off answer: the flag, then the label, then loose words."""
    flag = F.regexp_extract(raw, _field_pattern("contains_pii", "(true|false|1|0)"), 1)
    lowered = F.lower(raw)
    mentioned = F.contains(lowered, F.lit("contains_pii"))
    return F.coalesce(
        coerce_text(flag),
        coerce_text(partial_text(raw, "label")),
        F.when(mentioned & F.contains(lowered, F.lit("true")), F.lit(True)).when(
            mentioned & F.contains(lowered, F.lit("false")), F.lit(False)
        ),
    )


# --- normalised record --------------------------------------------------------

_FLOAT_TEXT = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
_INFINITE_TEXT = r"(?i)^\+?inf(?:inity)?$"
_MINUS_INFINITE_TEXT = r"(?i)^-inf(?:inity)?$"
_NAN_TEXT = r"(?i)^[+-]?nan$"


def _text_to_double(text: Column) -> Column:
    body = strip(text)
    return (
        F.when(body.rlike(_FLOAT_TEXT), body.try_cast("double"))
        .when(body.rlike(_INFINITE_TEXT), F.lit(float("inf")))
        .when(body.rlike(_MINUS_INFINITE_TEXT), F.lit(float("-inf")))
        .when(body.rlike(_NAN_TEXT), F.lit(float("nan")))
    )


def unit_interval(number: Column) -> Column:
    """Clamp into [0, 1]; NaN becomes 0 and null stays null."""
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.nanvl(number, F.lit(0.0))))
    return F.when(number.isNotNull(), clamped)


def stated_confidence(payload: Column, raw: Column) -> Column:
    """Confidence as stated, else the one of a cut-off answer; not yet clamped."""
    value = payload["confidence"]
    kind = F.schema_of_variant(value)
    stated = (
        F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double"))
        .when(kind == "STRING", _text_to_double(F.try_variant_get(value, "$", "string")))
        .when(_is_number(kind), F.try_variant_get(value, "$", "double"))
    )
    return F.coalesce(stated, partial_number(raw, "confidence"))


def reason_of(payload: Column, raw: Column) -> Column:
    """Stated reason as text, else the reason of a cut-off answer, else empty.

    A null reads "None" and booleans "True"/"False"; nested values keep JSON form.
    """
    value = payload["reason"]
    kind = F.schema_of_variant(value)
    stated = (
        F.when(kind == "VOID", F.lit("None"))
        .when(kind == "BOOLEAN", F.initcap(F.try_variant_get(value, "$", "string")))
        .when(kind == "STRING", F.try_variant_get(value, "$", "string"))
        .when(kind.isNotNull(), F.to_json(value))
    )
    return F.coalesce(
        F.nullif(strip(stated), F.lit("")), partial_text(raw, "reason"), F.lit("")
    )


def with_normalized(df: DataFrame, raw: str, out: str = "normalized") -> DataFrame:
    """Add ``out``, the uniform record of a raw model answer."""
    payload, flag, number = f"__{out}_payload", f"__{out}_flag", f"__{out}_number"
    text = F.coalesce(F.col(raw), F.lit(""))
    staged = (
        with_json_object(df, text, payload)
        .withColumn(flag, F.coalesce(decision(payload), partial_decision(text)))
        .withColumn(number, stated_confidence(F.col(payload), text))
    )
    record = F.struct(
        F.col(flag).alias("contains_pii"),
        label_of(F.col(flag)).alias("label"),
        unit_interval(F.col(number)).alias("confidence"),
        reason_of(F.col(payload), text).alias("reason"),
        text.alias("raw_text"),
    )
    return with_computed(staged, out, record).drop(payload, flag, number)


def json_text(**fields: Column) -> Column:
    """Object text of the given fields with ``", "`` and ``": "`` between the parts.

    Nulls are kept and non-ASCII stays readable. The spacing matters: an answer
    without a decision is read as free text, and only its first characters count.
    """

    def member(name: str, value: Column) -> Column:
        alone = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
        inner = F.substring(alone, F.lit(6), F.length(alone) - 6)  # between {"v": and }
        return F.concat(F.lit(f'"{name}": '), inner)

    return F.concat(
        F.lit("{"), F.concat_ws(", ", *[member(n, v) for n, v in fields.items()]), F.lit("}")
    )


RECORD_FIELDS = ("contains_pii", "label", "confidence", "reason", "raw_text")


def record_json(record: Column) -> Column:
    """Uniform record as JSON text."""
    return json_text(**{name: record[name] for name in RECORD_FIELDS})


# --- free text ------------------------------------------------------------------


def _alternation(patterns: tuple[str, ...]) -> str:
    return "(?iuU)" + "|".join(p.replace(r"\s", WS) for p in patterns)


def free_text_decision(raw: Column) -> Column:
    """Yes/no reading of the first 80 characters, negative forms first.

    The words ``no``, ``yes``, ``true`` and ``false`` match inside longer words.
    """
    # Lowering can lengthen a text, never shorten it: cut first, and once more after.
    start = F.lower(F.substring(strip(raw), 1, FREE_TEXT_CHARS))
    head = strip(F.substring(start, 1, FREE_TEXT_CHARS))
    return (
        F.when(head.rlike(_alternation(NO_PATTERNS)), F.lit(False))
        .when(head.rlike(_alternation(YES_PATTERNS)), F.lit(True))
        .when(F.startswith(head, F.lit("是")), F.lit(True))
        .when(F.startswith(head, F.lit("否")), F.lit(False))
    )


def _meaning(value: object) -> bool | None:
    """Boolean meaning of a parsed JSON value, as ``decision`` reads it."""
    if isinstance(value, bool):
        return value
    if isinstance(value, int | float):
        return {1: True, 0: False}.get(value)
    if isinstance(value, str):
        word = value.strip(WHITESPACE).lower()
        return True if word in YES_WORDS else False if word in NO_WORDS else None
    return None


def _free_meaning(text: str) -> bool | None:
    """``free_text_decision`` of one text."""
    head = text.strip(WHITESPACE)[:FREE_TEXT_CHARS].lower()[:FREE_TEXT_CHARS].strip(WHITESPACE)
    for patterns, said in ((NO_PATTERNS, False), (YES_PATTERNS, True)):
        if any(re.search(p, head, re.IGNORECASE) for p in patterns):
            return said
    return True if head.startswith("是") else False if head.startswith("否") else None


def _deep_decision(text: str | None) -> bool | None:
    """Decision of an answer wrapped in ``raw_text`` any number of times."""
    levels: list[tuple[str, object]] = []
    while text is not None:
        try:
            found = json.loads(text.strip(JSON_WHITESPACE))
        except ValueError:
            found = None
        found = found if isinstance(found, dict) else {}
        levels.append((text, found))
        inner = found.get("raw_text")
        inner = inner.strip(WHITESPACE) if isinstance(inner, str) else ""
        text = inner if inner and inner != text.strip(WHITESPACE) else None
    result = None
    for outer, found in reversed(levels):
        stated = next((m for k in DECISION_KEYS if (m := _meaning(found.get(k))) is not None), None)
        result = stated if stated is not None else result
        result = _free_meaning(outer) if result is None else result
    return result


@F.pandas_udf(T.BooleanType())
def _deep_decisions(texts: pd.Series) -> pd.Series:
    return pd.Series([_deep_decision(t) for t in texts], dtype="object")


def with_parsed_decision(df: DataFrame, raw: str, out: str = "parsed") -> DataFrame:
    """Add boolean ``out``: the decision in an answer of any shape.

    JSON keys first; then the answer wrapped in ``raw_text``, however often (a normalised
    record wraps once); then the free-text reading of the inner text, then of the outer
    one. A JSON object without a decision is read as free text too, so a ``reason``
    starting early in it may decide. An inner text is parsed only where the outer one
    states nothing; two levels are columns, deeper ones go to Python.
    """
    outer, inner = f"__{out}_outer", f"__{out}_inner"
    text, deep = f"__{out}_text", f"__{out}_deep"
    stated, stated_inner = f"__{out}_stated", f"__{out}_stated_inner"

    def wrapped(payload: str, around: Column, told: str) -> Column:
        found = strip(variant_text(F.col(payload)["raw_text"]))
        return F.when(F.col(told).isNull() & (found != "") & (found != strip(around)), found)

    df = with_strict_object(df, F.btrim(F.col(raw), F.lit(JSON_WHITESPACE)), outer)
    df = df.withColumn(stated, decision(outer))
    df = with_computed(df, text, wrapped(outer, F.col(raw), stated))
    df = with_strict_object(df, F.btrim(F.col(text), F.lit(JSON_WHITESPACE)), inner)
    df = df.withColumn(stated_inner, decision(inner))
    df = df.withColumn(deep, wrapped(inner, F.col(text), stated_inner))
    result = F.coalesce(
        F.col(stated),
        F.col(stated_inner),
        _deep_decisions(F.col(deep)),
        free_text_decision(F.col(text)),
        free_text_decision(F.col(raw)),
    )
    return with_computed(df, out, result).drop(outer, inner, text, deep, stated, stated_inner)


# --- answer contract ----------------------------------------------------------------

# The declared answer keys and the longest allowed reason.
CONTRACT_KEYS = ("contains_pii", "label", "confidence", "reason")
REASON_CHARS = 20


def with_contract(df: DataFrame, raw: str, out: str = "contract") -> DataFrame:
    """Add struct ``out`` of booleans: does an answer keep the declared contract?"""
    payload, keys = f"__{out}_payload", f"__{out}_keys"
    text = F.btrim(F.col(raw), F.lit(JSON_WHITESPACE))
    df = with_strict_object(df, text, payload)
    df = df.withColumn(
        keys, F.when(F.col(payload).isNotNull(), F.json_object_keys(text))
    )
    p = F.col(payload)
    flag = F.try_variant_get(p["contains_pii"], "$", "boolean")
    label = variant_text(p["label"])
    confidence_kind = F.schema_of_variant(p["confidence"])
    confidence = F.try_variant_get(p["confidence"], "$", "double")
    known = F.array(*[F.lit(k) for k in CONTRACT_KEYS])

    def holds(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False))

    return with_computed(
        df,
        out,
        F.struct(
            p.isNotNull().alias("is_object"),
            holds(F.size(F.array_except(known, F.col(keys))) == 0).alias("has_required"),
            holds(F.size(F.array_except(F.col(keys), known)) == 0).alias("no_extra"),
            holds(F.schema_of_variant(p["contains_pii"]) == "BOOLEAN").alias("flag_ok"),
            holds(label.isin(LABEL_YES, LABEL_NO)).alias("label_ok"),
            holds(_is_number(confidence_kind) & confidence.between(0, 1)).alias("confidence_ok"),
            holds(variant_text(p["reason"]).isNotNull()).alias("reason_ok"),
            holds(
                (F.schema_of_variant(p["contains_pii"]) == "BOOLEAN")
                & (label == F.when(flag, LABEL_YES).otherwise(LABEL_NO))
            ).alias("label_agrees"),
            holds(F.length(variant_text(p["reason"])) <= REASON_CHARS).alias("reason_short"),
        ),
    ).drop(payload, keys)
