"""Confusion counts, rates, latency, cost, alignment and result rows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.functions.answers import label_of, with_parsed_decision
from sievemark.operators.ranks import (
    SINGLE_TASK_ROWS,
    exact_percentile,
    join_groups,
    largest_group,
)
from sievemark.session import require_columns

TASK_PII_BINARY = "pii_binary"


def _truth(truth: str | None) -> Column:
    """Without a truth column every row is a positive (recall = detection rate)."""
    return F.lit(True) if truth is None else F.coalesce(F.col(truth), F.lit(False))


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def confusion_columns(
    pred: str, truth: str | None, treat_unparseable_as: bool | None = False
) -> dict[str, Column]:
    """tp, tn, fp, fn, unparseable, total; a null prediction counts as unparseable
    and also as the given value (False unless stated)."""
    said = F.coalesce(F.col(pred), F.lit(bool(treat_unparseable_as)))
    true = _truth(truth)
    return {
        "tp": _count(true & said),
        "tn": _count(~true & ~said),
        "fp": _count(~true & said),
        "fn": _count(true & ~said),
        "unparseable": _count(F.col(pred).isNull()),
        "total": F.count(F.lit(1)),
    }


def _agg(df: DataFrame, by: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(name) for name, c in columns.items()])


def confusion(
    df: DataFrame,
    pred: str,
    truth: str | None,
    by: Sequence[str] = (),
    treat_unparseable_as: bool | None = False,
) -> DataFrame:
    return _agg(df, by, confusion_columns(pred, truth, treat_unparseable_as))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields 0 for a zero denominator."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator), F.lit(0.0))


def with_guard_rates(counts: DataFrame) -> DataFrame:
    """Add tpr and fpr, rounded to 4 places."""
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    return counts.withColumns(
        {"tpr": F.round(ratio(tp, tp + fn), 4), "fpr": F.round(ratio(fp, fp + tn), 4)}
    )


def with_binary_rates(counts: DataFrame) -> DataFrame:
    """Add accuracy, precision, recall and f1, rounded to 4 places."""
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.withColumns(
        {
            "accuracy": F.round(ratio(tp + tn, F.col("total")), 4),
            "precision": F.round(precision, 4),
            "recall": F.round(recall, 4),
            "f1": F.round(ratio(2 * precision * recall, precision + recall), 4),
        }
    )


def binary_metrics(
    df: DataFrame,
    pred: str,
    truth: str | None,
    by: Sequence[str] = (),
    treat_unparseable_as: bool | None = False,
) -> DataFrame:
    return with_binary_rates(confusion(df, pred, truth, by, treat_unparseable_as))


def latency_stats(
    df: DataFrame,
    latency: str,
    by: Sequence[str] = (),
    single_task_rows: int = SINGLE_TASK_ROWS,
) -> DataFrame:
    """Mean and linearly interpolated p95 latency, 2 places, 0 for no rows.

    NaN and null latencies are left out; rows without any have a null figure.
    """
    return _with_p95(
        df, by, {"overhead_latency_ms_avg": _mean(latency)}, latency, single_task_rows
    )


def _number(latency: str) -> Column:
    """Latency as a double; NaN counts as missing."""
    return F.nanvl(F.col(latency).cast("double"), F.lit(None))


def _unless_empty(figure: Column, rows: Column) -> Column:
    """2 places; 0 for no rows, null for rows that were never timed."""
    return F.round(F.when(rows == 0, F.lit(0.0)).otherwise(figure), 2)


def _mean(latency: str) -> Column:
    return _unless_empty(F.avg(_number(latency)), F.count(F.lit(1)))


def _with_p95(
    df: DataFrame,
    by: Sequence[str],
    columns: dict[str, Column],
    latency: str,
    single_task_rows: int,
    sized: DataFrame | None = None,
) -> DataFrame:
    """One aggregation; only a group too large for one buffer adds the rank search.

    ``sized`` is a cheaper table with the same rows, for counting the groups.
    """
    name = "overhead_latency_ms_p95"
    if largest_group(df if sized is None else sized, by) <= single_task_rows:
        p95 = _unless_empty(F.percentile(_number(latency), 0.95), F.count(F.lit(1)))
        return _agg(df, by, {**columns, name: p95})
    rows = df if sized is None else sized
    p95 = exact_percentile(rows, latency, 0.95, by, "__p95", single_task_rows)
    stats = _agg(df, by, {**columns, "__rows": F.count(F.lit(1))})
    if by:
        joined = join_groups(stats, p95, by, how="left")
    else:
        joined = stats.withColumn("__p95", p95.scalar())
    return joined.withColumn(name, _unless_empty(F.col("__p95"), F.col("__rows"))).drop(
        "__p95", "__rows"
    )


def cost_columns(cost: str) -> dict[str, Column]:
    return {
        "cost_usd_total": F.round(F.coalesce(F.sum(cost), F.lit(0.0)), 6),
        "cost_usd_avg": F.round(F.coalesce(F.avg(cost), F.lit(0.0)), 6),
    }


def cost_stats(df: DataFrame, cost: str, by: Sequence[str] = ()) -> DataFrame:
    return _agg(df, by, cost_columns(cost))


GUARD_COLUMNS = (
    "tpr", "fpr", "tp", "tn", "fp", "fn", "unparseable",
    "overhead_latency_ms_avg", "overhead_latency_ms_p95", "cost_usd_total", "cost_usd_avg",
)


def guard_metrics(
    df: DataFrame,
    pred: str = "contains_pii",
    truth: str | None = "ground_truth",
    latency: str = "latency_ms",
    cost: str = "cost_usd",
    by: Sequence[str] = (),
    single_task_rows: int = SINGLE_TASK_ROWS,
) -> DataFrame:
    """Counts, rates, latency and cost per group in one aggregation."""
    columns = {
        **confusion_columns(pred, truth),
        "overhead_latency_ms_avg": _mean(latency),
        **cost_columns(cost),
    }
    counts = _with_p95(df, by, columns, latency, single_task_rows)
    return with_guard_rates(counts).select(*by, *GUARD_COLUMNS)


def model_metrics(
    df: DataFrame,
    pred: str = "contains_pii",
    truth: str | None = "ground_truth",
    latency: str = "latency_ms",
    cost: str = "cost_usd",
    by: Sequence[str] = ("model_key",),
) -> DataFrame:
    """Counts, both sets of rates, mean latency and cost per group, for comparisons that
    need no percentile: one scan, one aggregation."""
    columns = {
        **confusion_columns(pred, truth),
        "overhead_latency_ms_avg": _mean(latency),
        **cost_columns(cost),
    }
    return with_binary_rates(with_guard_rates(_agg(df, by, columns)))


def decision_disagreements(
    df: DataFrame, left: str, right: str, by: Sequence[str] = ()
) -> DataFrame:
    """How often two decisions differ; null is a value of its own."""
    a, b = F.col(left), F.col(right)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        _count(~a.eqNullSafe(b)).alias("disagreements"),
        _count(a.isNull() & b.isNotNull()).alias("left_only_null"),
        _count(a.isNotNull() & b.isNull()).alias("right_only_null"),
    )


def check_alignment(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Compare the keys of two tables: one row of counts.

    A union and one grouped count, not a join: a key repeated on both sides would
    multiply in a join, here it combines before the shuffle.
    """
    sides = left.select(F.col(key), F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(
        right.select(F.col(key), F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    per_key = sides.groupBy(key).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    l, r = F.col("l"), F.col("r")
    return per_key.agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("right_rows"),
        _count((l > 0) & (r > 0)).alias("matched_keys"),
        _count((l > 0) & (r == 0)).alias("left_only_keys"),
        _count((l == 0) & (r > 0)).alias("right_only_keys"),
        _count((l > 1) | (r > 1)).alias("repeated_keys"),
    )


def require_alignment(left: DataFrame, right: DataFrame, key: str) -> None:
    """Raise unless both tables have exactly the same, unique keys."""
    row = check_alignment(left, right, key).first()
    if row.left_only_keys or row.right_only_keys or row.repeated_keys:
        raise ValueError(f"tables do not align on {key!r}: {row.asDict()}")


# --- result rows and run metrics ------------------------------------------------


def result_rows(scored: DataFrame, content_col: str = "content") -> DataFrame:
    """Per-row result table of scored samples: re-read decision, label, rounded figures."""
    require_columns(scored, "output_json", "model_key")
    parsed = with_parsed_decision(scored, "output_json", "prediction_bool")
    names = set(scored.columns)
    truth = F.col("ground_truth") if "ground_truth" in names else F.lit(True)
    kind = F.col("sample_type") if "sample_type" in names else F.lit("unknown")
    return parsed.select(
        *[c for c in ("sample_id",) if c in names],
        F.col(content_col),
        F.col("output_json").alias("model_output_raw"),
        label_of(F.col("prediction_bool")).alias("prediction"),
        "prediction_bool",
        truth.alias("ground_truth"),
        kind.alias("sample_type"),
        F.round("latency_ms", 2).alias("latency_ms"),
        F.round("cost_usd", 8).alias("cost_usd"),
        "model_key",
        "model_id",
        "provider",
    )


def process_results(
    outputs: DataFrame,
    samples: DataFrame,
    task_id: str = TASK_PII_BINARY,
    key: str = "sample_id",
    raw_col: str = "raw",
    truth: str | None = None,
) -> DataFrame:
    """Raw answers joined to their samples by key and read for one task.

    Keys must align exactly; an unknown task is an error.
    """
    if task_id != TASK_PII_BINARY:
        raise ValueError(f"unsupported task {task_id!r}; known: ['{TASK_PII_BINARY}']")
    require_alignment(outputs, samples, key)
    joined = samples.join(outputs.select(key, F.col(raw_col).alias("model_output_raw")), key)
    parsed = with_parsed_decision(joined, "model_output_raw", "prediction_bool")
    return parsed.withColumn("prediction", label_of(F.col("prediction_bool"))).withColumn(
        "ground_truth", _truth(truth)
    )


def run_metrics(
    scored: DataFrame,
    by: Sequence[str] = ("model_key", "model_id", "provider"),
    single_task_rows: int = SINGLE_TASK_ROWS,
) -> DataFrame:
    """Metrics row per model from stored scored rows, in one aggregation.

    The decision is taken twice: tpr and fpr follow the scorer's flag, while the
    counts and the accuracy figures follow the decision re-read from the stored
    answer. ``decision_disagreements`` tells how often the two differ.
    """
    reread = with_parsed_decision(scored, "output_json", "__reread")
    flag = confusion_columns("contains_pii", "ground_truth")
    columns = {
        **{f"__flag_{k}": flag[k] for k in ("tp", "tn", "fp", "fn")},
        **confusion_columns("__reread", "ground_truth"),
        "prompt_tokens_total": F.coalesce(F.sum("prompt_tokens"), F.lit(0)),
        "completion_tokens_total": F.coalesce(F.sum("completion_tokens"), F.lit(0)),
        "overhead_latency_ms_avg": _mean("latency_ms"),
        **cost_columns("cost_usd"),
        "decision_disagreements": _count(~F.col("contains_pii").eqNullSafe(F.col("__reread"))),
    }
    m = with_binary_rates(_with_p95(reread, by, columns, "latency_ms", single_task_rows, scored))
    tp, tn, fp, fn = (F.col(f"__flag_{k}") for k in ("tp", "tn", "fp", "fn"))
    return m.select(
        *by,
        "prompt_tokens_total",
        "completion_tokens_total",
        F.round(ratio(tp, tp + fn), 4).alias("tpr"),
        F.round(ratio(fp, fp + tn), 4).alias("fpr"),
        *("tp", "tn", "fp", "fn", "unparseable"),
        *("overhead_latency_ms_avg", "overhead_latency_ms_p95", "cost_usd_total", "cost_usd_avg"),
        *("accuracy", "precision", "recall", "f1", "total", "decision_disagreements"),
    )


def rescore(
    df: DataFrame, rules: dict[str, Column], truth: str, by: Sequence[str] = ()
) -> DataFrame:
    """Binary metrics of several decision rules over the same stored outputs, one scan."""
    rows = F.array(
        *[F.struct(F.lit(n).alias("rule"), c.alias("said")) for n, c in rules.items()]
    )
    long = df.select(*by, truth, F.explode(rows).alias("__r")).select(*by, truth, "__r.*")
    return binary_metrics(long, "said", truth, [*by, "rule"])


def run_id_of(started: datetime) -> str:
    return started.strftime("%Y%m%dT%H%M%S")


def with_run(
    df: DataFrame,
    experiment_started: datetime,
    model_started: datetime | None = None,
    model_finished: datetime | None = None,
) -> DataFrame:
    """Add run id and times; also the run length when both model times are known."""

    def stamp(moment: datetime | None) -> Column:
        return F.lit(moment.replace(microsecond=0) if moment else None).cast("timestamp")

    columns = {
        "run_id": F.lit(run_id_of(experiment_started)),
        "experiment_started_at": stamp(experiment_started),
        "model_started_at": stamp(model_started),
        "model_finished_at": stamp(model_finished),
    }
    if model_started and model_finished:
        seconds = (model_finished - model_started).total_seconds()
        columns["execution_time_sec"] = F.lit(round(seconds, 2))
    return df.withColumns(columns)
