"""Score every text with one or many scorers.

A ``RuleScorer`` is a column expression and stays in the JVM. A ``PythonScorer``
wraps user code (a model, a remote call): it is opened once per partition, gets
Arrow batches of the content column only, and its errors stay with their rows.
Scoring is costly and may not repeat, so store scored rows before aggregating.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress
from dataclasses import dataclass, field
from functools import partial, reduce
from typing import TypeVar

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target

from sievemark.functions.answers import (
    EMPTY_REASON,
    NORMALIZED_TYPE,
    free_text_decision,
    label_of,
    record_json,
    with_normalized,
)
from sievemark.functions.flags import DEFAULT_RULES, any_rule, has_obvious_pii
from sievemark.functions.text import clean
from sievemark.session import bound_text_batches, materialize, require_columns

T_ = TypeVar("T_")
RAISED = re.compile(r"[A-Za-z_][\w.]*(Error|Exception|Interrupt|Exit|Warning)\b")
ERROR_PREFIX = "model_error: "


@dataclass(frozen=True)
class RuleScorer:
    """A scorer written as a column expression: content column -> nullable boolean."""

    key: str
    expression: Callable[[Column], Column]
    model_id: str = "rules"
    provider: str = "rules"


@dataclass
class Answer:
    """What a Python scorer returns for one text."""

    raw_text: str = ""
    prompt_tokens: int = 0
    completion_tokens: int = 0
    cost_usd: float = 0.0


class PythonScorer:
    """Base class of user scorers; instances travel to the executors.

    ``open`` loads what is needed once per partition, ``score`` answers one text,
    ``close`` releases it. ``concurrency`` bounds the threads of one partition.
    """

    key = "python"
    model_id = "python"
    provider = "python"
    concurrency = 1

    def open(self) -> None:
        pass

    def score(self, content: str) -> Answer:
        raise NotImplementedError

    def close(self) -> None:
        pass


class BatchScorer(PythonScorer):
    """Base class of scorers that answer several texts per call.

    A call gets texts of similar length: at most ``batch_texts`` of them, which padded to
    the longest have at most ``batch_chars`` characters (one text may have more). It
    returns one answer per text, in order; an exception in the place of an answer, or
    raised for a call with one text, is the error of that text.
    """

    batch_texts = 64
    batch_chars = 1 << 20

    def score_batch(self, contents: list[str]) -> list[Answer | Exception]:
        raise NotImplementedError

    def score(self, content: str) -> Answer:
        (answer,) = self.score_batch([content])
        if isinstance(answer, Exception):
            raise answer
        return answer


Scorer = RuleScorer | PythonScorer

SCORED_COLUMNS = (
    "contains_pii", "output_json", "prompt_tokens", "completion_tokens",
    "cost_usd", "latency_ms", "error",
)

ANSWER_TYPE = T.StructType(
    [
        T.StructField("raw_text", T.StringType()),
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
        T.StructField("cost_usd", T.DoubleType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("error", T.StringType()),
    ]
)


EMPTY_ANSWER = ("", 0, 0, 0.0, 0.0, None)


def _row(answer: Answer | Exception, ms: float) -> tuple:
    """An answer as a row; an exception becomes an error text, its time still counts."""
    if isinstance(answer, Exception):
        return ("", 0, 0, 0.0, ms, str(answer))
    tokens = int(answer.prompt_tokens), int(answer.completion_tokens)
    return (answer.raw_text, *tokens, float(answer.cost_usd), ms, None)


def _timed_answer(scorer: PythonScorer, content: str) -> tuple:
    if not content:
        return EMPTY_ANSWER
    start = time.perf_counter()
    answer: Answer | Exception
    try:
        answer = scorer.score(content)
    except Exception as e:  # noqa: BLE001 - any failure of user code stays with its row
        answer = e
    return _row(answer, (time.perf_counter() - start) * 1000.0)


def batches_by_length(contents: Sequence[str], most: int, chars: int) -> list[list[int]]:
    """Positions of the texts that are not empty, in batches of similar length."""
    batches: list[list[int]] = []
    for at in sorted((i for i, c in enumerate(contents) if c), key=lambda i: len(contents[i])):
        # Ascending: the text that comes next is the one all others are padded to.
        last = batches[-1] if batches else None
        if last is None or len(last) >= most or (len(last) + 1) * len(contents[at]) > chars:
            batches.append([])
        batches[-1].append(at)
    return batches


def _timed_batch(scorer: BatchScorer, contents: list[str], spent_ms: float = 0.0) -> list[tuple]:
    """The rows of one call. A call that fails is repeated for each half of its texts, so
    only the text that is to blame keeps the error. A text's time is its share of all
    calls that it took part in."""
    start = time.perf_counter()
    answers: list[Answer | Exception] | Exception
    try:
        answers = list(scorer.score_batch(contents))
        if len(answers) != len(contents):
            raise ValueError(f"{len(answers)} answers to {len(contents)} texts")
    except Exception as e:  # noqa: BLE001 - any failure of user code stays with its row
        answers = e
    share = spent_ms + (time.perf_counter() - start) * 1000.0 / len(contents)
    if not isinstance(answers, Exception):
        return [_row(a, share) for a in answers]
    if len(contents) == 1:
        return [_row(answers, share)]
    half = len(contents) // 2
    return [r for part in (contents[:half], contents[half:]) for r in _timed_batch(scorer, part, share)]


def _all_answers(scorer: PythonScorer, contents: list[str], pool: ThreadPoolExecutor) -> list[tuple]:
    """One row per text, in order, whatever finishes first."""
    if not isinstance(scorer, BatchScorer):
        return list(pool.map(lambda c: _timed_answer(scorer, c), contents))
    contents = [c or "" for c in contents]
    batches = batches_by_length(contents, scorer.batch_texts, scorer.batch_chars)
    rows = [EMPTY_ANSWER] * len(contents)
    answered = pool.map(lambda batch: _timed_batch(scorer, [contents[i] for i in batch]), batches)
    for batch, found in zip(batches, answered, strict=True):
        for at, row in zip(batch, found, strict=True):
            rows[at] = row
    return rows


def _answers(scorer: PythonScorer, threads: int) -> Callable:
    names = ANSWER_TYPE.fieldNames()

    @F.pandas_udf(ANSWER_TYPE)
    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer.open()
        try:
            with ThreadPoolExecutor(max_workers=threads) as pool:
                for contents in batches:
                    yield pd.DataFrame(_all_answers(scorer, list(contents), pool), columns=names)
        finally:
            with suppress(Exception):  # answers already given stand
                scorer.close()

    return answers.asNondeterministic()


def rule_record(flag: Column, content: Column) -> Column:
    """Uniform record of a rule decision."""
    return F.struct(
        flag.alias("contains_pii"),
        label_of(flag).alias("label"),
        F.lit(None).cast("double").alias("confidence"),
        F.when(content == "", F.lit(EMPTY_REASON)).otherwise(F.lit("")).alias("reason"),
        F.lit("").alias("raw_text"),
    )


def _named(scorer: Scorer) -> dict[str, Column]:
    return {
        "model_key": F.lit(scorer.key),
        "model_id": F.lit(scorer.model_id),
        "provider": F.lit(scorer.provider),
    }


def _unread(reason: Column) -> Column:
    """The record of a text without an answer."""
    return F.struct(
        F.lit(None).cast("boolean").alias("contains_pii"),
        label_of(F.lit(None).cast("boolean")).alias("label"),
        F.lit(None).cast("double").alias("confidence"),
        reason.alias("reason"),
        F.lit("").alias("raw_text"),
    ).cast(NORMALIZED_TYPE)


def bounded_calls(df: DataFrame, concurrency: int, max_calls: int) -> tuple[DataFrame, int]:
    """(rows in few enough partitions, threads of each) for ``max_calls`` calls at once in
    the whole job, wherever its tasks run. Partitions are put together without a shuffle.

    A partition per call as far as there are cores, and threads only for the calls that are
    left: the more partitions, the less of the table one task has to read.
    """
    if max_calls < 1:
        raise ValueError("at least one call at a time")
    tasks = min(max_calls, max(1, df.sparkSession.sparkContext.defaultParallelism))
    return df.coalesce(tasks), min(max(1, concurrency), max_calls // tasks)


def score(
    df: DataFrame,
    scorer: Scorer,
    content_col: str = "content",
    partitions: int | None = None,
    max_calls: int | None = None,
) -> DataFrame:
    """Add the scored columns of one scorer, plus model_key, model_id and provider.

    An empty text never reaches the scorer: no decision, no tokens, no cost, 0 ms.
    ``concurrency`` bounds the threads of a partition; ``max_calls`` bounds the calls of a
    Python scorer that are under way at any time, over all executors. ``partitions`` deals
    the rows out evenly.
    """
    require_columns(df, content_col)
    model = _named(scorer)
    text = clean(F.col(content_col))
    if isinstance(scorer, RuleScorer):
        flag = F.when(text != "", scorer.expression(text))
        scored = df.withColumn("contains_pii", flag)
        return scored.withColumns(
            {
                "output_json": record_json(rule_record(F.col("contains_pii"), text)),
                "prompt_tokens": F.lit(0).cast("bigint"),
                "completion_tokens": F.lit(0).cast("bigint"),
                "cost_usd": F.lit(0.0),
                # Rules run inside the scan: there is no time to state for one row.
                "latency_ms": F.lit(None).cast("double"),
                "error": F.lit(None).cast("string"),
                **model,
            }
        )
    df = bound_text_batches(df)
    rows, threads = df.repartition(partitions) if partitions else df, max(1, scorer.concurrency)
    if max_calls is not None:
        rows, threads = bounded_calls(rows, threads, max_calls)
    answered = rows.withColumn("__answer", _answers(scorer, threads)(text))
    answered = answered.withColumns(
        {
            "__raw": F.col("__answer.raw_text"),
            "__error": F.col("__answer.error"),
            "__empty": clean(F.col(content_col)) == "",
        }
    )
    normal = with_normalized(answered, "__raw", "__record")
    # No answer, no reading: empty and failed rows get a record of their own.
    unread = _unread(
        F.when(F.col("__empty"), F.lit(EMPTY_REASON)).otherwise(
            F.concat(F.lit(ERROR_PREFIX), F.col("__error"))
        )
    )
    answered_ok = ~F.col("__empty") & F.col("__error").isNull()
    final = normal.withColumn("__final", F.when(answered_ok, F.col("__record")).otherwise(unread))
    return final.withColumns(
        {
            "contains_pii": F.col("__final.contains_pii"),
            "output_json": record_json(F.col("__final")),
            "prompt_tokens": F.col("__answer.prompt_tokens"),
            "completion_tokens": F.col("__answer.completion_tokens"),
            "cost_usd": F.col("__answer.cost_usd"),
            "latency_ms": F.col("__answer.latency_ms"),
            "error": F.col("__error"),
            **model,
        }
    ).drop("__answer", "__raw", "__error", "__empty", "__record", "__final")


def _score_rules(df: DataFrame, rules: Sequence[RuleScorer], content_col: str) -> DataFrame:
    """All rule scorers in one scan: flags side by side, unpivoted by an explode."""
    text = clean(F.col(content_col))
    fanned = F.array(
        *[
            F.struct(
                *[value.alias(name) for name, value in _named(s).items()],
                F.when(text != "", s.expression(text)).alias("contains_pii"),
            )
            for s in rules
        ]
    )
    record = rule_record(F.col("__s.contains_pii"), text)
    return df.select("*", F.explode(fanned).alias("__s")).select(
        *df.columns,
        F.col("__s.contains_pii"),
        record_json(record).alias("output_json"),
        F.lit(0).cast("bigint").alias("prompt_tokens"),
        F.lit(0).cast("bigint").alias("completion_tokens"),
        F.lit(0.0).alias("cost_usd"),
        F.lit(None).cast("double").alias("latency_ms"),
        F.lit(None).cast("string").alias("error"),
        F.col("__s.model_key"),
        F.col("__s.model_id"),
        F.col("__s.provider"),
    )


def failed_rows(df: DataFrame, scorer: Scorer, error: str) -> DataFrame:
    """Every text with the error of a scorer that failed as a whole."""
    return df.withColumns(
        {
            "contains_pii": F.lit(None).cast("boolean"),
            "output_json": record_json(_unread(F.lit(ERROR_PREFIX + error))),
            "prompt_tokens": F.lit(0).cast("bigint"),
            "completion_tokens": F.lit(0).cast("bigint"),
            "cost_usd": F.lit(0.0),
            "latency_ms": F.lit(None).cast("double"),
            "error": F.lit(error),
            **_named(scorer),
        }
    )


def failure_text(error: Exception) -> str:
    """What went wrong, in a line: of an error in a worker the last line of its traceback,
    which names the exception of the user's code."""
    lines = [line.strip() for line in str(error).splitlines() if line.strip()]
    raised = [line for line in lines if RAISED.match(line)]
    return raised[-1] if raised else lines[0] if lines else type(error).__name__


def at_the_same_time(
    spark: SparkSession, jobs: Sequence[tuple[str, Callable[[], T_]]], at_once: int
) -> list[T_ | Exception]:
    """The results of the jobs, or the exceptions they ended with, in their order. Each
    job runs in a scheduler pool of its name, so that under the fair scheduler none waits
    for the tasks of another."""

    def run(job: tuple[str, Callable[[], T_]]) -> T_ | Exception:
        name, work = job
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        try:
            return work()
        except Exception as e:  # noqa: BLE001 - a job's failure is its result
            return e
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max_workers=max(1, min(at_once, len(jobs)))) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(run), job) for job in jobs]
        return [s.result() for s in started]


def score_all(
    df: DataFrame,
    scorers: Sequence[Scorer],
    content_col: str = "content",
    on_error: str = "raise",
    at_once: int = 4,
    max_calls: int | None = None,
) -> DataFrame:
    """Samples x scorers, long form.

    Rule scorers share one scan, and each Python scorer adds a branch of its own. With
    ``on_error="row"`` the branches are scored and stored at the same time, ``at_once`` of
    them; a scorer that fails as a whole, say on opening, leaves its error on every one of
    its rows and the others go on. ``max_calls`` holds for each Python scorer.
    """
    if not scorers:
        raise ValueError("no scorers given")
    if on_error not in ("raise", "row"):
        raise ValueError(f"on_error is 'raise' or 'row', not {on_error!r}")
    rules = [s for s in scorers if isinstance(s, RuleScorer)]
    branches: list[tuple[str, Sequence[Scorer], DataFrame]] = []
    if rules:
        branches.append(("rules", rules, _score_rules(df, rules, content_col)))
    for s in scorers:
        if isinstance(s, PythonScorer):
            branches.append((s.key, [s], score(df, s, content_col, max_calls=max_calls)))
    parts = [rows for _, _, rows in branches]
    if on_error == "row":
        jobs = [(key, partial(materialize, rows, f"scored-{key}")) for key, _, rows in branches]
        parts = []
        done = at_the_same_time(df.sparkSession, jobs, at_once)
        for (_, members, _), found in zip(branches, done, strict=True):
            if isinstance(found, Exception):
                parts.extend(failed_rows(df, s, failure_text(found)) for s in members)
            else:
                parts.append(found)
    return reduce(DataFrame.unionByName, parts)


# --- registry ----------------------------------------------------------------

REGEX_SCORER = RuleScorer("regex", lambda c: any_rule(c, DEFAULT_RULES), "rules/regex")
EMAIL_SCORER = RuleScorer("email", lambda c: any_rule(c, DEFAULT_RULES[:1]), "rules/email")
OBVIOUS_SCORER = RuleScorer("obvious", has_obvious_pii, "rules/obvious")
CASCADE_SCORER = RuleScorer("cascade", free_text_decision, "rules/cascade")


@dataclass
class ScorerRegistry:
    """Provider name -> factory; the place to plug in scorers of one's own."""

    factories: dict[str, Callable[[Mapping], Scorer]] = field(default_factory=dict)

    def register(self, provider: str, factory: Callable[[Mapping], Scorer]) -> None:
        self.factories[provider] = factory

    def create(self, provider: str, spec: Mapping | None = None) -> Scorer:
        if provider not in self.factories:
            raise ValueError(f"unknown provider {provider!r}; known: {sorted(self.factories)}")
        return self.factories[provider](spec or {})


def default_registry() -> ScorerRegistry:
    registry = ScorerRegistry()
    for scorer in (REGEX_SCORER, EMAIL_SCORER, OBVIOUS_SCORER, CASCADE_SCORER):
        registry.register(scorer.key, lambda _spec, s=scorer: s)
    return registry

