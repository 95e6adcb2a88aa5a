"""Whole workflows: benchmark a set of scorers, build a corpus, compare stored runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.operators.compare import comparison, history, leaderboard, with_params
from sievemark.operators.evalset import build_eval_set
from sievemark.operators.generation import Rewriter, generate_corpus
from sievemark.operators.metrics import result_rows, run_id_of, run_metrics, with_run
from sievemark.operators.scoring import Scorer, at_the_same_time, score
from sievemark.session import materialize
from sievemark.sources.readers import METRICS_FILES, read_metrics
from sievemark.sources.writers import (
    write_comparison,
    write_generated,
    write_metrics,
    write_results,
)

MODEL_COLUMNS = ("model_key", "model_id", "provider")


@dataclass(frozen=True)
class BenchmarkRun:
    run_id: str
    board: DataFrame
    results_path: str
    metrics_path: str
    board_path: str


def _failed_row(spark: SparkSession, scorer: Scorer, error: Exception) -> DataFrame:
    row = (scorer.key, scorer.model_id, scorer.provider, "failed", str(error))
    return spark.createDataFrame(
        [row], "model_key string, model_id string, provider string, status string, error string"
    )


def run_benchmark(
    source: DataFrame,
    scorers: Sequence[Scorer],
    out_dir: str,
    n: int = 100,
    include_negative: bool = True,
    non_pii: DataFrame | None = None,
    id_col: str = "sample_id",
    content_col: str = "content",
    append: bool = False,
    params: Mapping[str, float] | None = None,
    started: datetime | None = None,
    at_once: int = 4,
) -> BenchmarkRun:
    """Evaluation set -> scores -> result rows -> metrics -> leaderboard, all stored.

    Every model's scores are written once and aggregated from storage, because
    scoring again would cost again and may answer differently. ``at_once`` models score at
    the same time. A model that fails adds one ``failed`` row and the others go on.
    """
    spark = source.sparkSession
    started = started or datetime.now()
    run_id = run_id_of(started)
    samples = materialize(
        build_eval_set(source, n, include_negative, non_pii, id_col, content_col), "eval-set"
    )
    results_path, metrics_path = f"{out_dir}/results", f"{out_dir}/metrics"

    def scored_at(scorer: Scorer) -> tuple[DataFrame, datetime, datetime]:
        begun = datetime.now()
        rows = materialize(score(samples, scorer, "content"), f"scored-{scorer.key}")
        return rows, begun, datetime.now()

    begun = datetime.now()
    jobs = [(s.key, partial(scored_at, s)) for s in scorers]
    metrics: list[DataFrame] = []
    for scorer, found in zip(scorers, at_the_same_time(spark, jobs, at_once), strict=True):
        try:
            if isinstance(found, Exception):
                raise found
            scored, model_started, finished = found
            rows = with_run(result_rows(scored), started, model_started, finished)
            write_results(rows.drop("execution_time_sec"), results_path, append)
            # One row per model: pinned here so that a failure stays with its model.
            row = with_run(run_metrics(scored), started, model_started, finished)
            metrics.append(spark.createDataFrame(row.collect(), row.schema))
        except Exception as e:  # noqa: BLE001 - one model must not end the run
            failed = _failed_row(spark, scorer, e)
            metrics.append(with_run(failed, started, begun, datetime.now()))
    table = with_params(history(*metrics), params)
    if "status" not in table.columns:
        table = table.withColumns(
            {"status": F.lit(None).cast("string"), "error": F.lit(None).cast("string")}
        )
    write_metrics(table, metrics_path, append)
    board = leaderboard(table)
    board_path = f"{out_dir}/comparison"
    write_comparison(board, board_path, append)
    return BenchmarkRun(run_id, board, results_path, metrics_path, board_path)


def build_corpus(
    source: DataFrame,
    n: int,
    rewriter: Rewriter,
    path: str,
    max_retries: int = 2,
    id_col: str = "sample_id",
    content_col: str = "content",
) -> DataFrame:
    """Rewrite the first n texts and store the generation rows."""
    rows = generate_corpus(source, n, rewriter, max_retries, id_col, content_col)
    write_generated(rows, path)
    return source.sparkSession.read.schema(rows.schema).parquet(path)


def compare_stored(
    spark: SparkSession,
    folder: str,
    sort_by: str | None = "f1",
    pattern: str = METRICS_FILES,
) -> DataFrame:
    """Comparison table over the metrics files of a folder: single exports, or the
    ``metrics`` folder of a run."""
    good, _bad = read_metrics(spark, folder, pattern)
    return comparison(good, sort_by)
