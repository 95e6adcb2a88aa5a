"""Token-by-token moderation with early stop at the first PII category (batch form).

Three inputs are supported: a step scorer run over texts, per-text arrays of step
results, and a long table of steps (sample_id, token_index, risk_level, category).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import suppress
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.functions.answers import EMPTY_REASON, LABEL_UNPARSEABLE, json_text, label_of
from sievemark.functions.guard import (
    PII_CATEGORY,
    categories_in,
    first_pii_index,
    has_pii_category,
    is_pii_category,
    last_item,
    pick,
    reason_text,
    refusal_label,
    safety_label,
)
from sievemark.functions.text import clean, words
from sievemark.session import require_columns, with_computed

MODE_TOKENS, MODE_FULL = "token_by_token", "full_sequence_fallback"

# Events of a moderated text.
START, FALLBACK = "start_predict", "fallback_to_full_sequence"
STEP_FAILED, EARLY_STOP = "token_step_failed", "early_stop_triggered_by_pii_category"

# --- long table of steps -------------------------------------------------------


def steps_from_texts(
    df: DataFrame,
    is_pii: Callable[[Column], Column],
    id_col: str = "sample_id",
    content_col: str = "content",
) -> DataFrame:
    """Long steps table of whole texts: one row per token, PII where ``is_pii`` holds."""
    tokens = df.select(F.col(id_col), F.posexplode(words(F.col(content_col))))
    return tokens.select(
        id_col,
        F.col("pos").cast("bigint").alias("token_index"),
        F.when(is_pii(F.col("col")), F.lit(PII_CATEGORY)).otherwise(F.lit("None")).alias("category"),
    )


def early_stop(steps: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """(id, processed_tokens, total_tokens, trigger_index, early_stopped) per text.

    One grouped aggregation that combines before the shuffle, so a text holding a
    large part of all steps is no hot spot. Steps are numbered from 0 without gaps.
    """
    require_columns(steps, id_col, "token_index", "category")
    index = F.col("token_index")
    trigger = F.min(F.when(is_pii_category(F.col("category")), index))
    return steps.groupBy(id_col).agg(
        trigger.cast("bigint").alias("trigger_index"),
        (F.max(index) + 1).cast("bigint").alias("total_tokens"),
    ).select(
        id_col,
        F.coalesce(F.col("trigger_index") + 1, F.col("total_tokens")).alias("processed_tokens"),
        "total_tokens",
        "trigger_index",
        F.col("trigger_index").isNotNull().alias("early_stopped"),
    )


def processed_steps(steps: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """The steps up to and including the first PII one; all steps of the other texts.

    Only triggering texts enter the joined side, one row each, so a text with very
    many steps is split by the adaptive skew join.
    """
    hits = (
        steps.where(is_pii_category(F.col("category")))
        .groupBy(id_col)
        .agg(F.min("token_index").alias("__trigger"))
    )
    return (
        steps.join(hits, id_col, "left")
        .where(F.col("__trigger").isNull() | (F.col("token_index") <= F.col("__trigger")))
        .drop("__trigger")
    )


def early_stop_sparse(steps: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """``early_stop`` for step numbers with gaps: processed steps are counted."""
    kept = processed_steps(steps, id_col)
    hit = is_pii_category(F.col("category"))
    return kept.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("processed_tokens"),
        F.min(F.when(hit, F.col("token_index"))).alias("trigger_index"),
        F.bool_or(hit).alias("early_stopped"),
    )


def reached_steps(steps: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """(id, reached): how many steps each text has from step 0 on without a gap.

    The first gap is the smallest index that follows a step and is no step itself. Steps
    meet their successors by id and index, so a text with very many steps is spread out.
    """
    have = steps.where("token_index IS NOT NULL").select(id_col, F.col("token_index").cast("bigint"))
    follow = have.select(id_col, (F.col("token_index") + 1).alias("token_index"))
    begin = have.select(id_col, F.lit(0).cast("bigint").alias("token_index")).distinct()
    gaps = follow.unionByName(begin).join(have, [id_col, "token_index"], "left_anti")
    return gaps.where("token_index >= 0").groupBy(id_col).agg(F.min("token_index").alias("reached"))


def early_stop_contiguous(
    steps: DataFrame, id_col: str = "sample_id", error_col: str | None = None
) -> DataFrame:
    """``early_stop`` for steps with gaps, where a step counts only once all steps before
    it are there: a gap shows as not processed, a trigger behind it as not reached.

    With ``error_col`` a failed step stops a text as well; fault_index and fault tell
    which one did and why.
    """
    require_columns(steps, id_col, "token_index", "category")
    index = F.col("token_index").cast("bigint")
    error = F.col(error_col) if error_col else F.lit(None).cast("string")
    fault = F.when(error.isNotNull(), F.struct(index.alias("at"), error.alias("text")))
    seen = steps.groupBy(id_col).agg(
        F.min(F.when(is_pii_category(F.col("category")), index)).alias("trigger"),
        F.min(fault).alias("fault"),
        (F.max(index) + 1).alias("total_tokens"),
    )
    trigger, at = F.col("trigger"), F.col("fault.at")
    first = F.least(trigger, at)
    stopped = F.coalesce(first < F.col("reached"), F.lit(False))
    failed = stopped & F.coalesce(at == first, F.lit(False))
    hit = stopped & ~failed
    return seen.join(reached_steps(steps, id_col), id_col, "left").select(
        id_col,
        F.when(stopped, first + F.when(failed, 0).otherwise(1))
        .otherwise(F.coalesce("reached", F.lit(0)))
        .cast("bigint")
        .alias("processed_tokens"),
        "total_tokens",
        F.when(hit, trigger).alias("trigger_index"),
        hit.alias("early_stopped"),
        F.when(failed, at).alias("fault_index"),
        F.when(failed, F.col("fault.text")).alias("fault"),
    )


def step_events(
    steps: DataFrame, id_col: str = "sample_id", error_col: str | None = None
) -> DataFrame:
    """(id, event, token_index, detail) of texts given as steps: the start of each, and
    what it stops at: PII, a failed step 0 (fallback), a failed later step."""
    stops = early_stop_contiguous(steps, id_col, error_col)
    index, fault = F.col("trigger_index"), F.col("fault_index")
    nothing = F.lit(None).cast("bigint"), F.lit(None).cast("string")

    def event(name: Column, at: Column, detail: Column) -> Column:
        return F.struct(name.alias("event"), at.alias("token_index"), detail.alias("detail"))

    kind = F.when(fault == 0, FALLBACK).otherwise(STEP_FAILED)
    events = [
        event(F.lit(START), *nothing),
        F.when(index.isNotNull(), event(F.lit(EARLY_STOP), index, nothing[1])),
        F.when(fault.isNotNull(), event(kind, fault, F.col("fault"))),
    ]
    listed = F.filter(F.array(*events), lambda e: e.isNotNull())
    return stops.select(id_col, F.explode(listed).alias("e")).select(id_col, "e.*")


# --- per-text arrays -------------------------------------------------------------


def early_stop_arrays(df: DataFrame, categories: str = "category") -> DataFrame:
    """Add trigger_index, early_stopped, processed_tokens and total_tokens from the
    per-token category array of each row; no shuffle."""
    total = F.greatest(F.size(categories), F.lit(0)).cast("bigint")
    staged = df.withColumn("trigger_index", first_pii_index(F.col(categories)))
    return staged.withColumns(
        {
            "early_stopped": F.col("trigger_index").isNotNull(),
            "processed_tokens": F.coalesce(F.col("trigger_index") + 1, total),
            "total_tokens": total,
        }
    )


def infer_trigger(df: DataFrame, categories: str = "category") -> DataFrame:
    """Add inferred_pii and inferred_trigger_index: PII found in the returned arrays
    of a text that was not stopped early. ``early_stopped`` stays as it is."""
    require_columns(df, "early_stopped")
    inferred = F.when(~F.col("early_stopped"), first_pii_index(F.col(categories)))
    return df.withColumn("inferred_trigger_index", inferred).withColumn(
        "inferred_pii", F.col("inferred_trigger_index").isNotNull()
    )


def with_fallback(
    steps: DataFrame, full: DataFrame, id_col: str = "sample_id", error_col: str = "error"
) -> DataFrame:
    """Category array per text, from the steps or from a whole-text result.

    ``steps`` has one row per text: id, ``category`` array and ``error`` array (null
    where a step worked). If step 0 failed, the row of ``full`` (id, ``category``)
    stands in; if a later step failed, the text fails with that error.
    """
    require_columns(steps, id_col, "category", error_col)
    errors = F.col(error_col)
    first_failed = F.coalesce(F.get(errors, F.lit(0)).isNotNull(), F.lit(False))
    later = F.filter(errors, lambda e: e.isNotNull())
    whole = full.select(F.col(id_col), F.col("category").alias("__full"))
    joined = steps.withColumn("__fallback", first_failed).join(whole, id_col, "left")
    fell_back = F.col("__fallback")
    return (
        joined.withColumns(
            {
                "stream_mode": F.when(fell_back, MODE_FULL).otherwise(MODE_TOKENS),
                "step_error": F.when(~fell_back, F.get(later, F.lit(0))),
                "category": F.when(fell_back, F.col("__full")).otherwise(F.col("category")),
            }
        )
        .drop("__fallback", "__full")
    )


def final_decision(
    df: DataFrame,
    risk_levels: str = "risk_level",
    categories: str = "category",
    contents: str = "content",
    out: str = "decision",
) -> DataFrame:
    """Add struct ``out``: risk_level, category, refusal, text_output, contains_pii,
    label and reason.

    The last element of each array counts. A labelled text in ``contents`` overrides
    risk level and category; PII follows the parsed list, else the category; without
    a category there is no decision.
    """
    text = f"__{out}_text"
    staged = df.withColumn(text, last_item(F.col(contents))).withColumns(
        {
            f"__{out}_parsed": F.when(F.col(text) != "", categories_in(F.col(text))).otherwise(
                F.array().cast("array<string>")
            ),
            f"__{out}_risk": F.coalesce(
                safety_label(F.col(text)), last_item(F.col(risk_levels))
            ),
            f"__{out}_refusal": refusal_label(F.col(text)),
        }
    )
    parsed, risk = F.col(f"__{out}_parsed"), F.col(f"__{out}_risk")
    refusal = F.col(f"__{out}_refusal")
    staged = staged.withColumn(
        f"__{out}_category",
        F.when(F.size(parsed) > 0, F.array_join(parsed, ", ")).otherwise(
            last_item(F.col(categories))
        ),
    )
    category = F.col(f"__{out}_category")
    staged = staged.withColumn(
        f"__{out}_flag", F.when(category != "", has_pii_category(category, parsed))
    )
    flag = F.col(f"__{out}_flag")
    return with_computed(
        staged,
        out,
        F.struct(
            risk.alias("risk_level"),
            category.alias("category"),
            refusal.alias("refusal"),
            F.col(text).alias("text_output"),
            flag.alias("contains_pii"),
            label_of(flag).alias("label"),
            reason_text(risk, category, refusal).alias("reason"),
        ),
    ).drop(*[f"__{out}_{n}" for n in ("text", "parsed", "risk", "refusal", "category", "flag")])


def moderate_arrays(
    df: DataFrame,
    risk_levels: str = "risk_level",
    categories: str = "category",
    contents: str | None = None,
) -> DataFrame:
    """Guard record from per-token arrays: early stop, then the decision at that step."""
    stopped = early_stop_arrays(df, categories)
    at = F.greatest(F.col("processed_tokens") - 1, F.lit(0)).cast("int")

    def seen(name: str) -> Column:
        return F.when(F.size(name) > 0, F.array(pick(F.col(name), at))).otherwise(
            F.array().cast("array<string>")
        )

    none = F.array().cast("array<string>")
    reached = stopped.withColumns(
        {
            "__risk": seen(risk_levels),
            "__category": seen(categories),
            "__content": seen(contents) if contents else none,
        }
    )
    decided = final_decision(reached, "__risk", "__category", "__content", "decision")
    return decided.drop("__risk", "__category", "__content")


STREAM_FIELDS = (
    "stream_mode", "early_stopped", "trigger_index", "inferred_pii",
    "inferred_trigger_index", "processed_tokens", "total_tokens",
)


def with_guard_output(df: DataFrame) -> DataFrame:
    """Add contains_pii and output_json to moderated texts (``decision`` and the
    stream columns), ready for the result rows and the run metrics. An empty text, of
    no tokens, gets the record that scorers give it."""
    d = {n: F.col(f"decision.{n}") for n in ("risk_level", "category", "refusal")}
    stream = {n: F.col(n) for n in STREAM_FIELDS}
    detail = json_text(**d, text_output=F.col("decision.text_output"), **stream)
    record = json_text(
        contains_pii=F.col("decision.contains_pii"),
        label=F.col("decision.label"),
        confidence=F.lit(None).cast("double"),
        reason=F.col("decision.reason"),
        raw_text=F.col("__detail"),
        **d,
        **stream,
    )
    error = F.col("step_error")
    failed = json_text(
        contains_pii=F.lit(None).cast("boolean"),
        label=F.lit(LABEL_UNPARSEABLE),
        confidence=F.lit(None).cast("double"),
        reason=F.concat(F.lit("model_error: "), error),
        raw_text=F.lit(""),
    )
    empty = json_text(
        contains_pii=F.lit(None).cast("boolean"),
        label=F.lit(LABEL_UNPARSEABLE),
        confidence=F.lit(None).cast("double"),
        reason=F.lit(EMPTY_REASON),
        raw_text=F.lit(""),
    )
    no_text = F.col("total_tokens") == 0
    written = F.when(error.isNotNull(), failed).when(no_text, empty).otherwise(record)
    decided = F.when(error.isNull() & ~no_text, F.col("decision.contains_pii"))
    return (
        df.withColumn("__detail", detail)
        .withColumn("contains_pii", decided)
        .withColumn("output_json", written)
        .drop("__detail")
    )


def early_stop_savings(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Processed and total tokens, stopped texts and the share of tokens processed."""
    processed, total = F.sum("processed_tokens"), F.sum("total_tokens")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_if(F.col("early_stopped")).alias("stopped"),
        F.coalesce(processed, F.lit(0)).alias("processed_tokens"),
        F.coalesce(total, F.lit(0)).alias("total_tokens"),
        F.round(
            F.coalesce(F.try_divide(processed.cast("double"), total), F.lit(0.0)), 6
        ).alias("processed_share"),
    )


def moderation_events(df: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Event log of moderated texts: start, fallback, failed step, early stop, inferred.

    One row per event (id, event, token_index, detail); write it as JSON lines.
    """
    names = set(df.columns)

    def event(name: str, index: Column, detail: Column, when: Column) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(name).alias("event"),
                index.cast("bigint").alias("token_index"),
                detail.cast("string").alias("detail"),
            ),
        )

    none = F.lit(None)
    events = [event(START, F.col("total_tokens"), none, F.lit(True))]
    if "stream_mode" in names:
        events.append(
            event(FALLBACK, none, none, F.col("stream_mode") == MODE_FULL)
        )
    if "step_error" in names:
        events.append(
            event(STEP_FAILED, none, F.col("step_error"), F.col("step_error").isNotNull())
        )
    events.append(
        event(
            EARLY_STOP,
            F.col("trigger_index"),
            none,
            F.col("early_stopped"),
        )
    )
    if "inferred_pii" in names:
        events.append(
            event(
                "pii_inferred_from_result_without_early_stop",
                F.col("inferred_trigger_index"),
                none,
                F.col("inferred_pii"),
            )
        )
    kept = F.filter(F.array(*events), lambda e: e.isNotNull())
    return df.select(id_col, F.explode(kept).alias("e")).select(id_col, "e.*")


# --- step scorer over texts --------------------------------------------------------


class StepScorer:
    """Base class of user token-step scorers; opened once per partition.

    ``step`` returns a dict with the category (and risk level, text) after one more
    token, plus the state for the next step. ``full`` moderates a whole sequence and
    is used when the very first step fails. ``finish`` releases the state of a text.
    """

    def open(self) -> None:
        pass

    def tokens(self, content: str) -> list:
        return content.split()

    def step(self, token: Any, state: Any) -> tuple[dict, Any]:
        raise NotImplementedError

    def full(self, tokens: list) -> dict:
        raise NotImplementedError

    def finish(self, state: Any) -> None:
        pass

    def close(self) -> None:
        pass


MODERATED_TYPE = (
    "risk_level array<string>, category array<string>, content array<string>, "
    "stream_mode string, early_stopped boolean, trigger_index bigint, "
    "processed_tokens bigint, total_tokens bigint, step_error string"
)


def _listed(value: Any) -> list[str]:
    if value is None:
        return []
    return [str(v) for v in value] if isinstance(value, list) else [str(value)]


def _names_pii(value: Any) -> bool:
    items = _listed(value)
    return bool(items) and "PII" in items[-1].upper()


def _moderate(scorer: StepScorer, content: str) -> tuple:
    """Walk the tokens of one text until PII shows or the text ends."""
    tokens = scorer.tokens(content)
    result: dict = {}
    state, mode, trigger, processed, error = None, MODE_TOKENS, None, 0, None
    try:
        for i, token in enumerate(tokens):
            try:
                result, state = scorer.step(token, state)
            except Exception as e:  # noqa: BLE001 - user code
                if i:
                    error = f"step failed at index={i}: {e}"
                    break
                mode, result, processed = MODE_FULL, scorer.full(tokens), len(tokens)
                break
            processed = i + 1
            if _names_pii(result.get("category")):
                trigger = i
                break
    except Exception as e:  # noqa: BLE001 - the whole-text call failed as well
        error = str(e)
    finally:
        if state is not None:
            with suppress(Exception):  # the result stands, whatever the clean-up does
                scorer.finish(state)
    return (
        _listed(result.get("risk_level")), _listed(result.get("category")),
        _listed(result.get("content")), mode, trigger is not None, trigger,
        processed, len(tokens), error,
    )


def moderate_texts(
    df: DataFrame, scorer: StepScorer, content_col: str = "content"
) -> DataFrame:
    """Run a step scorer over every text and add its guard record.

    Stops a text at its first PII step, so later tokens cost nothing. Adds the
    moderation columns, the inferred trigger and the final ``decision``; a text whose
    later step failed has a ``step_error`` and no decision.
    """
    require_columns(df, content_col)
    fields = [f.strip().split(" ")[0] for f in MODERATED_TYPE.split(", ")]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer.open()
        try:
            for texts in batches:
                yield pd.DataFrame([_moderate(scorer, t) for t in texts], columns=fields)
        finally:
            with suppress(Exception):
                scorer.close()

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    moderated: Callable = F.pandas_udf(run, MODERATED_TYPE).asNondeterministic()
    names = [f"__m_{f}" for f in fields]
    base = df.withColumn("__m", moderated(clean(F.col(content_col))))
    flat = base.withColumns({f"__m_{f}": F.col(f"__m.{f}") for f in fields}).drop("__m")
    decided = final_decision(flat, "__m_risk_level", "__m_category", "__m_content", "decision")
    failed = F.col("__m_step_error").isNotNull()
    spread = decided.withColumns(
        {
            "decision": F.when(~failed, F.col("decision")),
            **{
                f: F.col(f"__m_{f}")
                for f in fields
                if f not in ("risk_level", "category", "content")
            },
        }
    )
    return infer_trigger(spread, "__m_category").drop(*names)
