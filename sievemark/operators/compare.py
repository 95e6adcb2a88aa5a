"""Comparison tables and leaderboards over metrics rows (one row per model and run)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemark.session import require_columns, small_or_materialized

# Known parameter counts in billions.
MODEL_PARAMS = {
    "granite4:1b-h": 1.0,
    "granite4:micro-h": 3.0,
    "granite4:tiny-h": 7.0,
    "granite4:1b": 1.0,
    "granite4:micro": 3.0,
    "granite4:tiny": 7.0,
    "ibm-granite/granite-4.0-h-micro": 3.0,
    "Qwen/Qwen3Guard-Stream-4B": 4.0,
}

# Columns of the comparison table and of the two reports.
COMPARISON_TYPES = {
    "model_id": "string",
    "accuracy": "double",
    "precision": "double",
    "recall": "double",
    "f1": "double",
    "execution_time_sec": "double",
    "model_params_b": "double",
    "total": "bigint",
    "unparseable": "bigint",
}
REPORT_COLUMNS = ("model_id", "accuracy", "recall", "f1", "execution_time_sec", "model_params_b")
LEADERBOARD_COLUMNS = (
    "model_key", "model_id", "provider", "status", "tpr", "fpr",
    "overhead_latency_ms_avg", "cost_usd_total", "execution_time_sec", "error",
)
UNKNOWN_MODEL = "unknown"


def with_params(
    df: DataFrame, params: Mapping[str, float] | DataFrame | None = None
) -> DataFrame:
    """Fill ``model_params_b``: the given value unless null or 0, else the known one.

    ``params`` is a dict added to the known models, or a table (model_id, params_b).
    """
    spark = df.sparkSession
    if not isinstance(params, DataFrame):
        known = {**MODEL_PARAMS, **(params or {})}
        params = spark.createDataFrame(list(known.items()), "model_id string, params_b double")
    params = small_or_materialized(params.select("model_id", "params_b"), "params")
    given = F.col("model_params_b") if "model_params_b" in df.columns else F.lit(None)
    filled = F.coalesce(F.nullif(given.cast("double"), F.lit(0.0)), F.col("params_b"))
    return (
        df.join(params, "model_id", "left")
        .withColumn("model_params_b", filled)
        .drop("params_b")
    )


def comparison_rows(
    metrics: DataFrame, params: Mapping[str, float] | DataFrame | None = None
) -> DataFrame:
    """Metrics rows cut to the nine comparison columns; absent ones are null."""
    present = set(metrics.columns)

    def column(name: str, kind: str) -> Column:
        value = F.col(name) if name in present else F.lit(None)
        return value.cast(kind).alias(name)

    rows = metrics.select(*[column(n, k) for n, k in COMPARISON_TYPES.items()])
    rows = rows.withColumn("model_id", F.coalesce("model_id", F.lit(UNKNOWN_MODEL)))
    return with_params(rows, params).select(*COMPARISON_TYPES)


def comparison(
    metrics: DataFrame,
    sort_by: str | None = "f1",
    params: Mapping[str, float] | DataFrame | None = None,
) -> DataFrame:
    """Comparison table, one column descending; an unknown column leaves it unsorted."""
    rows = comparison_rows(metrics, params)
    if sort_by and sort_by in rows.columns:
        return rows.orderBy(F.desc_nulls_last(sort_by), "model_id")
    return rows


def _leaderboard_order(tie: str) -> list[Column]:
    return [
        F.desc_nulls_last("tpr"),
        F.asc_nulls_last("fpr"),
        F.asc_nulls_last("overhead_latency_ms_avg"),
        F.asc_nulls_last("cost_usd_total"),
        F.asc_nulls_last(tie),
    ]


def leaderboard(df: DataFrame, tie: str = "model_key", by: Sequence[str] = ()) -> DataFrame:
    """Best models first: tpr down, fpr up, latency up, cost up, failed models last.

    Adds ``rank``. The ranked rows are models, not samples: a handful per board.
    ``by`` keeps separate boards, e.g. per run. Without metrics columns (every model
    failed) the rows keep the order of the tie column.
    """
    kinds = {n: "double" for n in ("tpr", "fpr", "overhead_latency_ms_avg", "cost_usd_total")}
    absent = {n: F.lit(None).cast(k) for n, k in kinds.items() if n not in df.columns}
    full = df.withColumns(absent) if absent else df
    order = _leaderboard_order(tie)
    window = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)
    return full.withColumn("rank", F.row_number().over(window)).orderBy(*by, "rank")


def report(df: DataFrame, columns: Sequence[str] = REPORT_COLUMNS) -> DataFrame:
    """The requested columns that exist, or every column if none does."""
    available = [c for c in columns if c in df.columns]
    return df.select(*available) if available else df


def resolve_models(models: DataFrame, selectors: Sequence[str]) -> DataFrame:
    """Models named by key or model id, each once; a key match hides id matches.

    Unknown selectors and an empty selection are errors that list what is known.
    """
    require_columns(models, "key", "model_id")
    wanted = list(dict.fromkeys(selectors))
    if not wanted:
        return models
    by_key = F.col("key").isin(wanted)
    matched = models.where(by_key | F.col("model_id").isin(wanted))
    pinned = small_or_materialized(matched, "models")
    keys = {r[0] for r in pinned.where(by_key).select("key").distinct().collect()}
    ids = [w for w in wanted if w not in keys]
    chosen = pinned.where(F.col("key").isin(list(keys)) | F.col("model_id").isin(ids))
    found_ids = {r[0] for r in chosen.select("model_id").distinct().collect()}
    unknown = [w for w in ids if w not in found_ids]
    if unknown:
        raise ValueError(f"unknown models {unknown}; {_known_models(models)}")
    if chosen.isEmpty():
        raise ValueError("no model selected")
    return chosen


def _known_models(models: DataFrame) -> str:
    rows = models.select("key", "model_id").distinct().collect()
    keys, ids = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    return f"known keys: {keys}; known model ids: {ids}"


def select_models(
    facts: DataFrame, models: DataFrame, selectors: Sequence[str], key_col: str = "model_key"
) -> DataFrame:
    """Result facts of the selected models."""
    chosen = resolve_models(models, selectors)
    keys = small_or_materialized(chosen.select(F.col("key").alias(key_col)), "model-keys")
    return facts.join(keys, key_col, "left_semi")


def history(*runs: DataFrame) -> DataFrame:
    """Metrics of many runs in one table; columns are matched by name."""
    if not runs:
        raise ValueError("no runs given")
    result = runs[0]
    for run in runs[1:]:
        result = result.unionByName(run, allowMissingColumns=True)
    return result
