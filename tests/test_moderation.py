"""Batch, array, step-scorer and streaming moderation give the same answers."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from sievemark.operators import moderation as M
from sievemark.operators import metrics
from sievemark.streaming import moderation as S

CASES = {
    1: ["PII", "None"],
    2: ["None", "PII", "PII"],
    3: ["None", "Violent", "pii, Violent"],
    4: ["None", "None"],
    5: ["Violent"],
    6: ["None"] * 40 + ["PII"] + ["None"] * 9,
}


def brute_force():
    out = {}
    for key, cats in CASES.items():
        hit = next((i for i, c in enumerate(cats) if "PII" in c.upper()), None)
        out[key] = (len(cats) if hit is None else hit + 1, len(cats), hit, hit is not None)
    return out


@pytest.fixture(scope="module")
def steps(spark):
    rows = [(k, i, c) for k, cats in CASES.items() for i, c in enumerate(cats)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "sample_id bigint, token_index bigint, category string")


def result(df):
    columns = ["processed_tokens", "total_tokens", "trigger_index", "early_stopped"]
    return {r.sample_id: tuple(r[c] for c in columns) for r in df.collect()}


def test_long_and_array_forms_agree(spark, steps):
    assert result(M.early_stop(steps)) == brute_force()
    arrays = spark.createDataFrame(list(CASES.items()), "sample_id bigint, category array<string>")
    assert result(M.early_stop_arrays(arrays)) == brute_force()
    sparse = steps.withColumn("token_index", F.col("token_index") * 10)
    got = {r.sample_id: (r.processed_tokens, r.trigger_index) for r in M.early_stop_sparse(sparse).collect()}
    assert got == {
        k: (v[0], None if v[2] is None else 10 * v[2]) for k, v in brute_force().items()
    }
    assert M.processed_steps(steps).count() == sum(v[0] for v in brute_force().values())


def stream_of(spark, steps, path, files):
    steps.repartition(files).write.parquet(path)
    return spark.readStream.schema(steps.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_streams_equal_batch_over_many_micro_batches(spark, steps, tmp_path):
    source = stream_of(spark, steps, str(tmp_path / "in"), 5)
    assert result(S.drain(S.early_stop_stream(source, unbounded=True))) == brute_force()
    again = spark.readStream.schema(steps.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    assert result(S.drain(S.early_stop_sessions(again, unbounded=True))) == brute_force()
    with pytest.raises(ValueError):
        S.early_stop_stream(steps)


def test_session_closes_at_end_marker_and_after_quiet_time(spark, tmp_path):
    schema = "sample_id bigint, token_index bigint, category string, is_last boolean, ts timestamp"
    batches = [
        [(1, 0, "None", False, "2024-01-01 00:00:00"), (2, 0, "PII", False, "2024-01-01 00:00:01")],
        [(1, 1, "PII", True, "2024-01-01 00:00:02")],
        [(3, 0, "None", False, "2024-01-01 03:00:00")],
        [(4, 0, "None", False, "2024-01-01 04:00:00")],
    ]
    path = str(tmp_path / "in")
    for rows in batches:
        df = spark.createDataFrame(rows, schema.replace("ts timestamp", "ts string"))
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = S.early_stop_sessions(source, end_col="is_last", ts_col="ts", quiet_seconds=60)
    rows = {r.sample_id: r for r in S.drain(out).collect()}
    assert (rows[1].closed, rows[1].trigger_index, rows[1].processed_tokens) == (True, 1, 2)
    assert (rows[2].closed, rows[2].trigger_index) == (True, 0)
    assert not rows[4].closed and rows[4].trigger_index is None


class WordSteps(M.StepScorer):
    """Says PII at the word 'secret'; some words make a step fail."""

    def step(self, token, state):
        if token == "fail":
            raise RuntimeError("bad token")
        seen = (state or []) + ["PII" if token == "secret" else "None"]
        return {"risk_level": ["Unsafe" if seen[-1] == "PII" else "Safe"], "category": seen}, seen

    def full(self, tokens):
        if "worse" in tokens:
            raise RuntimeError("no model")
        return {"category": ["PII" if "secret" in tokens else "None", "None"],
                "content": "Safety: Unsafe\nCategory: Jailbreak"}


def test_step_scorer_over_texts(spark):
    texts = ["a secret b", "a b", "fail secret", "a fail secret", "fail worse", "", None, "secret"]
    df = spark.createDataFrame(list(enumerate(texts)), "sample_id bigint, content string")
    rows = M.with_guard_output(M.moderate_texts(df, WordSteps())).orderBy("sample_id").collect()
    assert [r.early_stopped for r in rows] == [True, False, False, False, False, False, False, True]
    assert [r.trigger_index for r in rows] == [1, None, None, None, None, None, None, 0]
    assert [r.processed_tokens for r in rows][:5] == [2, 2, 2, 1, 0]
    assert [r.contains_pii for r in rows] == [True, False, False, None, None, None, None, True]
    fallback = rows[2]
    assert fallback.stream_mode == M.MODE_FULL and fallback.inferred_pii
    assert fallback.inferred_trigger_index == 0 and not fallback.early_stopped
    assert fallback.decision.category == "Jailbreak" and fallback.decision.risk_level == "Unsafe"
    assert rows[3].step_error == "step failed at index=1: bad token" and rows[3].decision is None
    assert json.loads(rows[3].output_json)["reason"].startswith("model_error: step failed")
    assert rows[4].step_error == "no model"
    record = json.loads(rows[0].output_json)
    assert record["label"] == "是" and record["reason"] == "risk_level=Unsafe; category=PII"
    assert json.loads(record["raw_text"])["trigger_index"] == 1 and record["total_tokens"] == 3
    empty = rows[5].decision
    assert (empty.contains_pii, empty.label, empty.category) == (None, "無法解析", "")


def test_guard_output_feeds_the_metrics(spark):
    df = spark.createDataFrame(
        [(1, "a secret", True), (2, "a b", False)], "sample_id bigint, content string, ground_truth boolean"
    )
    rows = M.with_guard_output(M.moderate_texts(df, WordSteps())).withColumns(
        {
            "model_key": F.lit("w"), "model_id": F.lit("w"), "provider": F.lit("w"),
            "latency_ms": F.lit(1.0), "cost_usd": F.lit(0.0),
            "prompt_tokens": F.col("total_tokens"), "completion_tokens": F.lit(0),
        }
    )
    m = metrics.run_metrics(rows).first()
    assert (m.tp, m.tn, m.tpr, m.fpr, m.decision_disagreements) == (1, 1, 1.0, 0.0, 0)


def test_final_decision_and_inference(spark):
    rows = [
        (1, ["Safe"], ["None", "PII"], ["Safety: Unsafe\nCategory: None, Violent\nRefusal: Yes"], False),
        (2, ["Safe", "Unsafe"], ["PII", "None"], [], False),
        (3, [], [], [], False),
        (4, ["Unsafe"], ["PII"], ["free words"], True),
    ]
    df = spark.createDataFrame(
        rows,
        "sample_id bigint, risk_level array<string>, category array<string>, "
        "content array<string>, early_stopped boolean",
    )
    got = {r.sample_id: r for r in M.infer_trigger(M.final_decision(df)).collect()}
    assert tuple(got[1].decision)[:3] == ("Unsafe", "None, Violent", "Yes")
    assert got[1].decision.contains_pii is False and got[1].inferred_trigger_index == 1
    assert got[2].decision.contains_pii is False and got[2].inferred_trigger_index == 0
    assert got[3].decision.contains_pii is None and not got[3].inferred_pii
    assert got[4].decision.contains_pii is True and got[4].inferred_trigger_index is None
    assert got[4].decision.reason == "risk_level=Unsafe; category=PII"


def test_events_and_savings(spark, steps):
    rows = M.early_stop(steps)
    events = M.moderation_events(rows)
    counts = {r.event: r["count"] for r in events.groupBy("event").count().collect()}
    assert counts == {"start_predict": 6, "early_stop_triggered_by_pii_category": 4}
    s = M.early_stop_savings(rows).first()
    assert (s.texts, s.stopped, s.processed_tokens, s.total_tokens) == (6, 4, 50, 61)
