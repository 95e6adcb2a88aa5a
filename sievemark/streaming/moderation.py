"""Early stop, events and fallback over a stream of steps (sample_id, token_index, category).

``early_stop_stream`` is a built-in streaming aggregation: it combines inside each
micro-batch before the shuffle, so one very long text is no hot spot, and arrival
order does not matter. The other operators keep custom state per text: which steps are
there, where it stops, what has been said of it. They let it go after a quiet period.
Texts are dealt over buckets, whose texts share a state row and a call of Python: a call
costs milliseconds and a text in it some hundred microseconds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sievemark.functions.guard import first_pii_index, is_pii_category, last_item
from sievemark.operators.moderation import (
    EARLY_STOP,
    FALLBACK,
    MODE_FULL,
    MODE_TOKENS,
    START,
    STEP_FAILED,
    early_stop,
)
from sievemark.session import new_scratch_path, require_columns
from sievemark.streaming.steps import FAILED, IS_END, IS_PII, NONE, STATE_TYPE, Progress


def early_stop_stream(
    steps: DataFrame, id_col: str = "sample_id", unbounded: bool = False
) -> DataFrame:
    """Running result per text; write it in update mode.

    Same plan as the batch operator: smallest PII index, largest index; a step that is
    missing counts as processed. A trigger that arrives late corrects the row of its text.
    The state of a text is two numbers, but it is never released, so a stream that goes
    on for ever needs ``early_stop_sessions``; ``unbounded`` states that this one ends or
    may grow.
    """
    if not steps.isStreaming:
        raise ValueError("early_stop_stream needs a streaming DataFrame")
    if not unbounded:
        raise ValueError("state is never released: use early_stop_sessions, or set unbounded")
    return early_stop(steps, id_col)


# --- state per text ----------------------------------------------------------------

SESSION_TYPE = (
    "sample_id bigint, processed_tokens bigint, total_tokens bigint, "
    "trigger_index bigint, early_stopped boolean, closed boolean"
)
GAP_TYPE = f"{SESSION_TYPE}, missing_tokens bigint"
EVENT_TYPE = "sample_id bigint, event string, token_index bigint, detail string"
OUTCOME_TYPE = (
    "sample_id bigint, stream_mode string, step_error string, steps bigint, "
    "first_pii bigint, last_category string"
)

# A step rewrites the state of its bucket, so this is a compromise: many texts ask for more.
BUCKETS = 2048

# (id, progress, whether it was closed for being quiet) -> rows to put out.
Report = Callable[[int | None, Progress, bool], list[tuple]]


def known(index: int) -> int | None:
    """One index as a nullable value."""
    return None if index == NONE else index


def rows_of(chunk: pd.DataFrame, known_ids: bool) -> Iterator[tuple]:
    """(id, token_index, flags, category, error, ts_ms) of every text in a chunk, as arrays."""
    names = ("token_index", "flags", "category", "error", "ts_ms")
    columns = [chunk[n].to_numpy() for n in names]
    if not known_ids:
        yield None, *columns
        return
    ids = chunk["sample_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, columns = ids[order], [c[order] for c in columns]
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    for low, high in zip(starts, [*starts[1:], len(ids)], strict=True):
        yield int(ids[low]), *(c[low:high] for c in columns)


def framed(rows: list[tuple], fields: list[tuple[str, str]]) -> pd.DataFrame:
    """Rows as a frame whose integers stay integers beside nulls."""
    kinds = {"bigint": "Int64", "boolean": "boolean"}
    columns = zip(*rows, strict=True)
    return pd.DataFrame(
        {
            name: pd.Series(list(values), dtype=kinds.get(kind, object))
            for (name, kind), values in zip(fields, columns, strict=True)
        }
    )


def by_text(
    steps: DataFrame,
    report: Report,
    out_type: str,
    mode: str,
    id_col: str,
    error_col: str | None,
    end_col: str | None,
    ts_col: str | None,
    quiet_seconds: int,
    keep_closed_seconds: int,
    watermark: str,
    unbounded: bool,
    intervals: bool = True,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Run ``report`` on the progress of every text that has new steps.

    A text is closed by a step whose ``end_col`` is true or, with ``ts_col``, once the
    watermark passes ``quiet_seconds`` after its last step. With ``ts_col`` its state stays
    for ``keep_closed_seconds`` of event time as a marker, so that late steps are merged
    into it and do not start it anew. Without ``ts_col`` a text is let go when it is closed
    and, with ``intervals``, no step before the end marker is missing. Steps without an
    index are left out.
    """
    if end_col is None and ts_col is None and not unbounded:
        raise ValueError("state is never released: give end_col or ts_col, or set unbounded")
    require_columns(steps, id_col, "token_index", "category")
    timed = steps.withWatermark(ts_col, watermark) if ts_col else steps
    none = F.lit(0).cast("bigint")
    ts = F.coalesce(F.unix_millis(F.col(ts_col).cast("timestamp")), none) if ts_col else none
    error = (F.col(error_col) if error_col else F.lit(None)).cast("string")
    kinds = {IS_PII: is_pii_category(F.col("category")), FAILED: error.isNotNull()}
    if end_col:
        kinds[IS_END] = F.col(end_col)
    flags = sum((F.when(holds, bit).otherwise(0) for bit, holds in kinds.items()), F.lit(0))
    text_id = F.col(id_col).cast("bigint")
    # Texts without an id have a bucket of their own: beside a null, pandas would turn the
    # other ids into floats.
    bucket = F.when(text_id.isNull(), -1).otherwise(F.pmod(F.xxhash64(text_id), F.lit(buckets)))
    columns = [
        bucket.cast("int").alias("bucket"),
        text_id.alias("sample_id"),
        F.col("token_index").cast("bigint").alias("token_index"),
        flags.alias("flags"),
        F.col("category").cast("string").alias("category"),
        error.alias("error"),
        ts.alias("ts_ms"),
    ]
    if ts_col:
        columns.append(F.col(ts_col))  # carries the watermark
    quiet_ms, keep_ms = quiet_seconds * 1000, keep_closed_seconds * 1000

    fields = [tuple(f.split()) for f in out_type.split(", ")]

    def advance(
        key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs() if ts_col else 0
        texts: dict[int | None, Progress] = {}
        until: dict[int | None, int] = {}
        for sample_id, quiet_until, *values in state.get[0] if state.exists else ():
            texts[sample_id], until[sample_id] = Progress.of(values), quiet_until
        latest: dict[int | None, int] = {}  # of the texts that have new steps
        for chunk in chunks:  # constant memory however many steps a text sends
            if not len(chunk):
                continue
            for sample_id, index, flags, category, error, ts_ms in rows_of(chunk, key[0] >= 0):
                progress = texts.setdefault(sample_id, Progress())
                progress.add(index, flags, category, error, intervals)
                latest[sample_id] = max(latest.get(sample_id, 0), int(ts_ms.max()))
        quiet = [i for i, end in until.items() if i not in latest and end < now] if ts_col else []
        rows: list[tuple] = []
        for sample_id in [*latest, *quiet]:
            progress, expired = texts[sample_id], sample_id not in latest
            if expired:
                if progress.closed:
                    del texts[sample_id]  # the marker has been kept long enough
                    continue
                progress.closed = True
            progress.closed = progress.closed or progress.last != NONE
            rows += report(sample_id, progress, expired)
            if ts_col:
                wait = keep_ms if progress.closed else quiet_ms
                until[sample_id] = max(max(latest.get(sample_id, 0), now) + wait, now + 1)
            elif progress.complete if intervals else progress.closed:
                del texts[sample_id]
        if rows:
            yield framed(rows, fields)
        if texts:
            held = [(i, until.get(i, 0), *progress.as_state()) for i, progress in texts.items()]
            state.update((held,))
            if ts_col:
                state.setTimeoutTimestamp(max(min(until[i] for i in texts), now + 1))
        elif state.exists:
            state.remove()

    timeout = GroupStateTimeout.EventTimeTimeout if ts_col else GroupStateTimeout.NoTimeout
    return (
        timed.where(F.col("token_index").isNotNull())
        .select(*columns)
        .groupBy("bucket")
        .applyInPandasWithState(advance, out_type, STATE_TYPE, mode, timeout)
    )


def early_stop_sessions(
    steps: DataFrame,
    id_col: str = "sample_id",
    end_col: str | None = None,
    ts_col: str | None = None,
    quiet_seconds: int = 600,
    watermark: str = "10 minutes",
    unbounded: bool = False,
    contiguous: bool = False,
    keep_closed_seconds: int = 86_400,
) -> DataFrame:
    """Early stop with session close; write it in update mode.

    A text's result is its smallest PII index and its largest index. With ``contiguous``
    a step counts only once all steps before it are there: a gap shows as not processed,
    a trigger behind it as not reached, and ``missing_tokens`` says how many steps are
    awaited. One of ``end_col`` and ``ts_col`` must be given, unless ``unbounded`` states
    that the stream ends or its state may grow.

    A late step of a closed text is merged: it may lower the trigger, raise the largest
    index or fill a gap, and the text stays closed. ``latest`` merges in the same way
    what a text without marker (no ``ts_col``, or older than ``keep_closed_seconds``)
    has said before and after.
    """

    def report(sample_id: int | None, progress: Progress, expired: bool) -> list[tuple]:
        reached = progress.reached if contiguous else progress.top + 1
        hit = NONE < progress.trigger < reached
        row = (
            sample_id,
            progress.trigger + 1 if hit else reached,
            progress.top + 1,
            known(progress.trigger if hit else NONE),
            hit,
            progress.closed,
        )
        return [row + ((progress.missing,) if contiguous else ())]

    return by_text(
        steps, report, GAP_TYPE if contiguous else SESSION_TYPE, "update", id_col, None, end_col,
        ts_col, quiet_seconds, keep_closed_seconds, watermark, unbounded, intervals=contiguous,
    )


def event_stream(
    steps: DataFrame,
    id_col: str = "sample_id",
    error_col: str | None = None,
    end_col: str | None = None,
    ts_col: str | None = None,
    quiet_seconds: int = 600,
    keep_closed_seconds: int = 86_400,
    watermark: str = "10 minutes",
    unbounded: bool = False,
) -> DataFrame:
    """(sample_id, event, token_index, detail) in append mode, each event once per text;
    write it with ``write_event_stream``.

    A text starts with its first step to arrive. It stops early, falls back to the whole
    sequence (step 0 failed) or fails (a later step did) as soon as that step and all
    before it are there, which no later step can undo. What was said is part of the state,
    so a restart and a step that comes twice repeat nothing, as long as the text is known:
    with ``ts_col`` that is ``keep_closed_seconds`` after it was closed, otherwise until all
    its steps have come. ``step_events`` in the batch operators gives the same rows.
    """

    def report(sample_id: int | None, progress: Progress, expired: bool) -> list[tuple]:
        rows = []
        if not progress.said & 1:
            rows.append((sample_id, START, None, None))
        if not progress.said & 2 and progress.stopped:
            at, failed = progress.first, progress.fault == progress.first
            kind = EARLY_STOP if not failed else FALLBACK if at == 0 else STEP_FAILED
            rows.append((sample_id, kind, at, progress.fault_text if failed else None))
            progress.said |= 2
        progress.said |= 1
        return rows

    return by_text(
        steps, report, EVENT_TYPE, "append", id_col, error_col, end_col, ts_col, quiet_seconds,
        keep_closed_seconds, watermark, unbounded,
    )


def fallback_stream(
    steps: DataFrame,
    full: DataFrame,
    id_col: str = "sample_id",
    error_col: str = "error",
    end_col: str = "is_end",
    ts_col: str | None = None,
    quiet_seconds: int = 600,
    keep_closed_seconds: int = 86_400,
    watermark: str = "10 minutes",
    unbounded: bool = False,
) -> DataFrame:
    """One row per text, in append mode: (sample_id, stream_mode, step_error, steps,
    first_pii, last_category). ``full`` is a stored table (id, ``category`` array).

    A text whose step 0 failed takes its result from ``full`` as soon as that is known;
    every other one is held until all steps up to its end marker are there. If a later
    step failed, ``step_error`` is the error of the first that did; a text that went
    quiet before all steps had come says how many are missing.
    """

    def report(sample_id: int | None, progress: Progress, expired: bool) -> list[tuple]:
        falls_back = progress.fault == 0
        if progress.said or not (falls_back or progress.complete or expired):
            return []
        progress.said = 1
        error = None if progress.fault == NONE else progress.fault_text
        if expired and error is None:
            error = f"{progress.missing} steps missing"
        row = (
            sample_id,
            MODE_FULL if falls_back else MODE_TOKENS,
            None if falls_back else error,
            known(NONE if falls_back else progress.top + 1),
            known(NONE if falls_back else progress.trigger),
            None if falls_back else progress.top_category,
        )
        return [row]

    held = by_text(
        steps, report, OUTCOME_TYPE, "append", id_col, error_col, end_col, ts_col, quiet_seconds,
        keep_closed_seconds, watermark, unbounded,
    )
    whole = full.select(F.col(id_col).alias("__id"), F.col("category").alias("__full"))
    falls_back, listed = F.col("__fallback"), F.col("__full")
    marked = held.withColumn("__fallback", F.col("stream_mode") == MODE_FULL)
    # Only rows that fall back look for a partner.
    joined = marked.join(whole, falls_back & (F.col("sample_id") == F.col("__id")), "left")
    return joined.select(
        "sample_id",
        "stream_mode",
        "step_error",
        F.when(falls_back, F.size(listed).cast("bigint")).otherwise(F.col("steps")).alias("steps"),
        F.when(falls_back, first_pii_index(listed)).otherwise(F.col("first_pii")).alias("first_pii"),
        F.when(falls_back, last_item(listed)).otherwise(F.col("last_category")).alias("last_category"),
    )


# --- sinks ---------------------------------------------------------------------------


def write_updates(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> None:
    """Drain a stream into Parquet, one folder per micro-batch.

    A replayed micro-batch overwrites its own folder, so a restart adds nothing twice.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(sink)
        .start()
    )
    query.awaitTermination()


def write_event_stream(
    stream: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Append moderation events to JSON lines as they come; the started query.

    The file sink commits a micro-batch as a whole, so a restart repeats no event.
    """
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.format("json").start(path)


def latest(spark: SparkSession, path: str, id_col: str = "sample_id") -> DataFrame:
    """The state of every text from its written rows: the last one, except for what only
    grows. The trigger is the smallest one said, the total the largest, and a text once
    closed stays so, even if a late step started it anew after its state was let go."""
    updates = spark.read.parquet(path)
    names = [c for c in updates.columns if c not in (id_col, "batch_id")]
    newest = F.max_by(F.struct(*names), F.col("batch_id")).alias("row")
    grown = {}
    if {"trigger_index", "total_tokens", "processed_tokens"} <= set(names):
        trigger = F.min("trigger_index")
        grown = {
            "trigger_index": trigger,
            "total_tokens": F.max("total_tokens"),
            "processed_tokens": F.coalesce(trigger + 1, F.max("processed_tokens")),
            "early_stopped": trigger.isNotNull(),
            "closed": F.bool_or("closed") if "closed" in names else F.lit(None),
        }
    aggregates = [newest, *[c.alias(f"__{n}") for n, c in grown.items() if n in names]]
    merged = [
        F.col(f"__{n}").alias(n) if n in grown else F.col(f"row.{n}") for n in names
    ]
    return updates.groupBy(id_col).agg(*aggregates).select(id_col, *merged)


def drain(stream: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Run an update-mode stream over all available input and return its final rows."""
    spark = stream.sparkSession
    path = new_scratch_path(spark, "stream-out")
    write_updates(stream, path, new_scratch_path(spark, "stream-state"))
    return latest(spark, path, id_col)


def drain_rows(stream: DataFrame) -> DataFrame:
    """Run an append-mode stream over all available input and return all its rows."""
    spark = stream.sparkSession
    path = new_scratch_path(spark, "stream-rows")
    write_updates(stream, path, new_scratch_path(spark, "stream-state"), "append")
    return spark.read.schema(stream.schema).parquet(f"{path}/batch_id=*")
