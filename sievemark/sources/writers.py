"""Writers: results, metrics, generated corpora, comparison tables, event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sievemark.session import require_columns


def _mode(append: bool) -> str:
    return "append" if append else "overwrite"


def write_results(df: DataFrame, path: str, append: bool = False) -> None:
    """Result rows as Parquet, one folder per run and model.

    Overwriting replaces only the runs and models present in ``df``, so a repeated
    job leaves one copy and other runs stay. The rebalance evens out file sizes when
    one model holds most of the rows.
    """
    keys = ["run_id", "model_key"]
    require_columns(df, *keys)
    writer = df.hint("rebalance", *keys).write.partitionBy(*keys).mode(_mode(append))
    if not append:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def write_metrics(df: DataFrame, path: str, append: bool = False) -> None:
    """Metrics rows as JSON lines, null fields kept."""
    df.write.option("ignoreNullFields", False).mode(_mode(append)).json(path)


def write_generated(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    _write(df, path, fmt, append=False)


def write_comparison(
    df: DataFrame, path: str, append: bool = False, fmt: str = "parquet"
) -> None:
    """Comparison table. Appended runs may differ in columns, so history needs a
    self-describing format; ``csv`` is for single exports."""
    if append and fmt == "csv":
        raise ValueError("append needs a self-describing format such as parquet")
    _write(df, path, fmt, append)


def write_texts(df: DataFrame, path: str, content_col: str, fmt: str = "csv") -> None:
    """Only the content column reaches the sink."""
    _write(df.select(content_col), path, fmt, append=False)


def write_events(df: DataFrame, path: str, append: bool = True) -> None:
    """Moderation events as JSON lines."""
    df.write.mode(_mode(append)).json(path)


def _write(df: DataFrame, path: str, fmt: str, append: bool) -> None:
    writer = df.write.mode(_mode(append))
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)
