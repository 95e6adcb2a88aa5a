"""Streams of steps: gaps, late steps, events once, fallback; against the batch operators."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievemark.operators import moderation as M
from sievemark.streaming import moderation as S
from sievemark.streaming.steps import joined

SCHEMA = "sample_id bigint, token_index bigint, category string, error string, is_end boolean, at int"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), min_size=1, max_size=8), min_size=1, max_size=6))
def test_interval_sets(batches):
    starts, ends, seen = [], [], set()
    for batch in batches:
        starts, ends = joined(starts, ends, np.array(batch))
        seen.update(batch)
        inside = {i for a, b in zip(starts, ends) for i in range(a, b + 1)}
        assert inside == seen
        assert all(b + 1 < a for b, a in zip(ends, starts[1:]))


def texts(n=60, seed=4):
    """Steps of texts that trigger, fail at step 0 or later, lack steps or repeat some."""
    draw = random.Random(seed)
    rows = []
    for key in range(n):
        size = draw.randint(1, 12)
        lost = {draw.randrange(size)} if key % 5 == 1 else set()
        for i in range(size):
            if i in lost:
                continue
            category = "PII" if draw.random() < 0.08 else "None"
            error = "broke" if (key % 7 == 2 and i == 0) or (key % 7 == 3 and i == 4) else None
            for _ in range(2 if draw.random() < 0.1 else 1):
                rows.append((key, i, category, error, i == size - 1, draw.randrange(4)))
    return rows


def as_stream(spark, rows, path):
    """A stream that gets the rows in four micro-batches, by their column ``at``."""
    df = spark.createDataFrame(rows, SCHEMA)
    for number in range(4):
        df.where(F.col("at") == number).coalesce(1).write.mode("append").parquet(path)
    return df, spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def as_set(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


COLUMNS = ("sample_id", "processed_tokens", "total_tokens", "trigger_index", "early_stopped")


def test_gaps_are_not_processed(spark, tmp_path):
    rows = [(k, i, c, None, e, a) for k, i, c, _, e, a in texts()]
    df, stream = as_stream(spark, rows, str(tmp_path / "in"))
    found = S.drain(S.early_stop_sessions(stream, unbounded=True, contiguous=True))
    assert as_set(found, *COLUMNS) == as_set(M.early_stop_contiguous(df), *COLUMNS)
    plain = {}
    for key, index, category, *_ in rows:
        plain.setdefault(key, {})[index] = category
    for r in found.collect():
        steps = plain[r.sample_id]
        reached = next(i for i in range(99) if i not in steps)
        hit = next((i for i in range(reached) if steps[i] == "PII"), None)
        first = min((i for i, c in steps.items() if c == "PII"), default=max(steps))
        assert (r.trigger_index, r.processed_tokens) == (hit, reached if hit is None else hit + 1)
        assert r.missing_tokens == sum(i not in steps for i in range(min(first, max(steps)) + 1))
    whole = df.where((F.col("sample_id") % 5 != 1))
    assert as_set(M.early_stop_contiguous(whole), *COLUMNS) == as_set(M.early_stop(whole), *COLUMNS)


def test_late_steps_are_merged(spark, tmp_path):
    schema = "sample_id bigint, token_index bigint, category string, is_end boolean, ts timestamp"
    batches = [
        [(1, 0, "None", False, "00:00:00"), (1, 1, "PII", True, "00:00:01"), (2, 1, "None", True, "00:00:01")],
        [(1, 2, "None", False, "00:00:02"), (2, 0, "PII", False, "00:00:02"), (3, 0, "None", False, "00:00:02")],
        [(9, 0, "None", False, "00:09:00")],
        [(9, 0, "None", False, "00:09:30")],
        [(9, 1, "None", False, "00:10:00"), (3, 1, "PII", False, "00:10:00")],
    ]
    expected = {1: (2, 3, 1, True), 2: (1, 2, 0, True), 3: (2, 2, 1, True), 9: (2, 2, None, False)}
    for name, timed in (("timed", True), ("untimed", False)):
        path = str(tmp_path / name)
        for rows in batches:
            df = spark.createDataFrame([(*r[:4], f"2024-01-01 {r[4]}") for r in rows], schema.replace("timestamp", "string"))
            df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        more = {"ts_col": "ts", "quiet_seconds": 60, "watermark": "1 minute"} if timed else {}
        rows = S.drain(S.early_stop_sessions(source, end_col="is_end", **more)).collect()
        got = {r.sample_id: (r.processed_tokens, r.total_tokens, r.trigger_index, r.closed) for r in rows}
        if not timed:  # nothing closes a text without an end marker
            expected = expected | {3: (2, 2, 1, False)}
        assert got == expected


EVENT = ("sample_id", "event", "token_index", "detail")


def test_events_once_also_after_a_restart(spark, tmp_path):
    rows = texts(seed=8)
    df, _ = as_stream(spark, rows, str(tmp_path / "all"))
    path, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in (0, 1):
        df.where(F.col("at") % 2 == part).coalesce(1).write.mode("append").parquet(path)
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
        events = S.event_stream(source, error_col="error", unbounded=True)
        S.write_event_stream(events, out, state, available_now=True).awaitTermination()
    got = sorted(map(str, spark.read.schema(S.EVENT_TYPE).json(out).select(*EVENT).collect()))
    assert got == sorted(map(str, M.step_events(df, error_col="error").select(*EVENT).collect()))
    kinds = as_set(M.step_events(df, error_col="error"), "event")
    assert kinds == {(M.START,), (M.FALLBACK,), (M.STEP_FAILED,), (M.EARLY_STOP,)}


def test_fallback_waits_for_what_is_known(spark, tmp_path):
    rows = [r for r in texts(seed=5) if r[0] % 5 != 1]  # every step comes
    df, stream = as_stream(spark, rows, str(tmp_path / "in"))
    full = spark.createDataFrame(
        [(k, ["None", "PII" if k % 2 else "None", "None"]) for k in range(0, 60, 3)],
        "sample_id bigint, category array<string>",
    )
    found = S.drain_rows(S.fallback_stream(stream, full))
    once = df.dropDuplicates(["sample_id", "token_index"])
    ordered = F.array_sort(F.collect_list(F.struct("token_index", "category", "error")))
    arrays = once.groupBy("sample_id").agg(ordered.alias("s")).select(
        "sample_id",
        F.transform("s", lambda x: x["category"]).alias("category"),
        F.transform("s", lambda x: x["error"]).alias("error"),
    )
    batch = M.with_fallback(arrays, full).select(
        "sample_id", "stream_mode", "step_error", F.size("category").alias("steps"), "category"
    )
    expected = set()
    for r in batch.collect():
        listed = r.category or []
        first = next((i for i, c in enumerate(listed) if c == "PII"), None)
        expected.add(
            (r.sample_id, r.stream_mode, r.step_error, None if r.category is None else len(listed), first,
             listed[-1] if listed else ("" if r.category is not None else None))
        )
    got = [tuple(r) for r in found.select("sample_id", "stream_mode", "step_error", "steps", "first_pii", "last_category").collect()]
    assert len(got) == len(set(got)) == len(expected)
    modes = {m for _, m, *_ in got}
    assert modes == {M.MODE_FULL, M.MODE_TOKENS}
    assert {g[:5] for g in got} == {e[:5] for e in expected}


def test_quiet_texts_say_what_is_missing(spark, tmp_path):
    schema = "sample_id bigint, token_index bigint, category string, error string, is_end boolean, ts timestamp"
    path = str(tmp_path / "in")
    for index, at in ((0, "00:00:00"), (2, "00:00:01"), (0, "03:00:00"), (0, "04:00:00")):
        key = 1 if at < "01" else 2 + int(at[1])
        row = [(key, index, "None", None, False, f"2024-01-01 {at}")]
        df = spark.createDataFrame(row, schema.replace("ts timestamp", "ts string"))
        df.withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(path)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    full = spark.createDataFrame([], "sample_id bigint, category array<string>")
    rows = S.drain_rows(S.fallback_stream(source, full, ts_col="ts", quiet_seconds=60)).collect()
    assert [(r.sample_id, r.step_error) for r in rows if r.sample_id == 1] == [(1, "1 steps missing")]


def test_state_has_to_be_released(spark, tmp_path):
    _, stream = as_stream(spark, texts(3), str(tmp_path / "in"))
    with pytest.raises(ValueError, match="never released"):
        S.event_stream(stream)


def test_a_table_is_streamed_from_a_file_or_a_folder(spark, tmp_path):
    from sievemark.plans.queries import REGISTRY

    rows = [(i, "a b" if i % 2 else "a x@example.com b") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs.repartition(3).write.parquet(f"{tmp_path}/folder/documents.parquet")
    docs.coalesce(1).write.parquet(f"{tmp_path}/parts")
    (part,) = (tmp_path / "parts").glob("*.parquet")
    (tmp_path / "file").mkdir()
    (tmp_path / "file" / "documents.parquet").write_bytes(part.read_bytes())
    for kind in ("folder", "file"):
        found = REGISTRY["early_stop_stream"](spark, f"{tmp_path}/{kind}")
        assert {tuple(r) for r in found.select("doc_id", "processed_tokens", "total_tokens").collect()} == {
            (i, 2, 2 if i % 2 else 3) for i in range(20)
        }


def test_calls_of_python_do_not_grow_with_the_texts(spark, tmp_path, monkeypatch):
    """Ids of any size, null among them, share buckets; each keeps a state of its own."""
    monkeypatch.setattr(S.by_text, "__defaults__", (*S.by_text.__defaults__[:-1], 4))
    ids = [None, -1, 2**62 + 1, 2**62 + 2, *range(50)]
    rows = [(i, at, "PII" if at == 2 else "None") for i in ids for at in range(4)]
    steps = spark.createDataFrame(rows, "sample_id bigint, token_index bigint, category string")
    steps.repartition(5).write.parquet(f"{tmp_path}/steps")
    live = spark.readStream.schema(steps.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/steps")
    held = S.early_stop_sessions(live, unbounded=True)
    plan = held._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInPandasWithState advance" in plan and "[bucket" in plan
    found = S.drain(held).collect()
    assert sorted(map(str, (r.sample_id for r in found))) == sorted(map(str, ids))
    assert {tuple(r)[1:] for r in found} == {(3, 4, 2, True, False)}


def test_steps_without_a_time_count(spark, tmp_path):
    rows = [(i, at, "PII" if at == 1 else "None", at == 2, at != i % 3) for i in range(30) for at in range(3)]
    steps = spark.createDataFrame(
        rows, "sample_id bigint, token_index bigint, category string, is_end boolean, timed boolean"
    ).withColumn("ts", F.when(F.col("timed"), F.timestamp_seconds(F.col("token_index"))))
    steps.repartition(1).write.parquet(f"{tmp_path}/steps")
    live = spark.readStream.schema(steps.schema).parquet(f"{tmp_path}/steps")
    found = S.early_stop_sessions(live, end_col="is_end", ts_col="ts", watermark="36500 days")
    assert {tuple(r)[1:] for r in S.drain(found).collect()} == {(2, 3, 1, True, True)}
