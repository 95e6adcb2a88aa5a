from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from sievemark.operators import metrics as M
from sievemark.operators import scoring as S
from sievemark.session import materialize

SAFE_MARK = "匿名化文本"


class MarkerScorer(S.PythonScorer):
    key, model_id, provider = "fake", "fake/model", "fake"

    def __init__(self, concurrency=1):
        self.concurrency = concurrency

    def open(self):
        self.opened = True

    def score(self, content):
        assert self.opened
        if "boom" in content:
            time.sleep(0.01)
            raise RuntimeError("no service")
        hit = SAFE_MARK not in content
        body = {"contains_pii": hit, "label": "是" if hit else "否", "confidence": 0.9}
        return S.Answer(json.dumps(body, ensure_ascii=False), 10, 2, 0.001)


@pytest.fixture(scope="module")
def samples(spark):
    rows = [
        (1, "PII 內容", True, "positive"),
        (2, f"{SAFE_MARK}：安全內容", False, "negative"),
        (3, "  　", True, "positive"),
        (4, "boom", False, "negative"),
        (5, None, False, "negative"),
    ]
    return spark.createDataFrame(
        rows, "sample_id bigint, content string, ground_truth boolean, sample_type string"
    )


@pytest.mark.parametrize("concurrency", [1, 3])
def test_python_scorer(samples, concurrency):
    rows = {r.sample_id: r for r in S.score(samples, MarkerScorer(concurrency), partitions=2).collect()}
    assert [rows[i].contains_pii for i in range(1, 6)] == [True, False, None, None, None]
    assert [rows[i].prompt_tokens for i in range(1, 6)] == [10, 10, 0, 0, 0]
    assert [rows[i].cost_usd for i in range(1, 6)] == [0.001, 0.001, 0.0, 0.0, 0.0]
    assert rows[3].latency_ms == 0.0 and rows[5].latency_ms == 0.0 and rows[4].latency_ms >= 10
    assert rows[4].error == "no service" and rows[3].error is None
    assert json.loads(rows[4].output_json)["reason"] == "model_error: no service"
    assert json.loads(rows[3].output_json) == {
        "contains_pii": None, "label": "無法解析", "confidence": None,
        "reason": "empty content", "raw_text": "",
    }
    assert json.loads(rows[1].output_json)["confidence"] == 0.9
    assert rows[1].model_key == "fake"


def test_run_metrics_over_scored_rows(samples):
    scored = materialize(S.score(samples, MarkerScorer()), "scored")
    m = M.run_metrics(scored.where("sample_id <= 2")).first()
    assert (m.tp, m.tn, m.fp, m.fn, m.tpr, m.fpr) == (1, 1, 0, 0, 1.0, 0.0)
    assert (m.prompt_tokens_total, m.completion_tokens_total) == (20, 4)
    assert m.decision_disagreements == 0 and m.f1 == 1.0
    every = M.run_metrics(scored).first()
    assert every.unparseable == 3 and every.total == 5


def test_score_all_and_registry(samples):
    rows = S.score_all(samples, [S.REGEX_SCORER, S.OBVIOUS_SCORER, MarkerScorer()])
    got = {r.model_key: r.n for r in rows.groupBy("model_key").agg(F.count("*").alias("n")).collect()}
    assert got == {"regex": 5, "obvious": 5, "fake": 5}
    with pytest.raises(ValueError, match="known"):
        S.default_registry().create("nope")
    registry = S.default_registry()
    registry.register("mine", lambda spec: MarkerScorer(spec.get("concurrency", 1)))
    assert registry.create("mine", {"concurrency": 4}).concurrency == 4
    assert registry.create("email") is S.EMAIL_SCORER
    with pytest.raises(ValueError):
        S.score_all(samples, [])


# --- metrics --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def four(spark):
    rows = [
        (True, True, 10.0, 0.01),
        (False, True, 20.0, 0.02),
        (True, False, 30.0, 0.03),
        (None, False, 40.0, 0.0),
    ]
    return spark.createDataFrame(
        rows, "contains_pii boolean, ground_truth boolean, latency_ms double, cost_usd double"
    )


def test_guard_metrics(four):
    m = M.guard_metrics(four).first()
    assert (m.tp, m.fn, m.fp, m.tn, m.unparseable) == (1, 1, 1, 1, 1)
    assert (m.tpr, m.fpr, m.cost_usd_total, m.cost_usd_avg) == (0.5, 0.5, 0.06, 0.015)
    assert (m.overhead_latency_ms_avg, m.overhead_latency_ms_p95) == (25.0, 38.5)
    ranked = M.guard_metrics(four, single_task_rows=2).first()
    assert ranked == m
    by = M.guard_metrics(four, by=["ground_truth"], single_task_rows=1).collect()
    plain = M.guard_metrics(four, by=["ground_truth"]).collect()
    assert sorted(by) == sorted(plain) and len(by) == 2


def test_empty_and_one_sided_inputs(four):
    none = M.guard_metrics(four.where("latency_ms < 0")).first()
    assert (none.tp, none.tpr, none.fpr, none.overhead_latency_ms_p95, none.cost_usd_avg) == (
        0, 0.0, 0.0, 0.0, 0.0,
    )
    binary = M.binary_metrics(four.where("latency_ms < 0"), "contains_pii", "ground_truth").first()
    assert (binary.accuracy, binary.precision, binary.f1, binary.total) == (0.0, 0.0, 0.0, 0)
    positives = M.guard_metrics(four.where("ground_truth")).first()
    assert positives.fpr == 0.0 and positives.tpr == 0.5
    single = M.latency_stats(four.where("latency_ms = 20"), "latency_ms").first()
    assert tuple(single) == (20.0, 20.0)


def test_unparseable_handling(four):
    def counts(value):
        r = M.confusion(four, "contains_pii", "ground_truth", treat_unparseable_as=value).first()
        return r.tp, r.tn, r.fp, r.fn, r.unparseable, r.total

    assert counts(False) == counts(None) == (1, 1, 1, 1, 1, 4)
    assert counts(True) == (1, 0, 2, 1, 1, 4)
    no_truth = M.binary_metrics(four, "contains_pii", None).first()
    assert (no_truth.tp, no_truth.fn, no_truth.recall) == (2, 2, 0.5)


def test_process_results(spark):
    samples = spark.createDataFrame([(1,), (2,), (3,)], "sample_id bigint")
    raws = ['{"contains_pii": true}', '{"contains_pii": false}', "???"]
    outputs = spark.createDataFrame(list(enumerate(raws, 1)), "sample_id bigint, raw string")
    truth = spark.createDataFrame([(1, "是"), (2, "否"), (3, "是")], "sample_id bigint, t string")
    from sievemark.functions.answers import truth_from_text

    labelled = samples.join(truth, "sample_id").select(
        "sample_id", truth_from_text(F.col("t")).alias("truth")
    )
    rows = M.process_results(outputs, labelled, truth="truth")
    assert [r.prediction for r in rows.orderBy("sample_id").collect()] == ["是", "否", "無法解析"]
    m = M.binary_metrics(rows, "prediction_bool", "ground_truth").first()
    assert (m.tp, m.tn, m.fn, m.unparseable, m.total) == (1, 1, 1, 1, 3)
    with pytest.raises(ValueError, match="pii_binary"):
        M.process_results(outputs, samples, "content_safety")
    with pytest.raises(ValueError, match="align"):
        M.process_results(outputs.where("sample_id < 3"), samples)


def test_alignment_counts_duplicates_without_pairs(spark):
    left = spark.range(100).select((F.col("id") % 2).alias("k"))
    right = spark.range(3).select(F.col("id").alias("k"))
    r = M.check_alignment(left, right, "k").first()
    assert tuple(r) == (100, 3, 2, 0, 1, 2)


def test_disagreements_and_rescore(four):
    df = four.withColumn("other", F.lit(True))
    d = M.decision_disagreements(df, "contains_pii", "other").first()
    assert tuple(d) == (4, 2, 1, 0)
    rules = {"flag": F.col("contains_pii"), "slow": F.col("latency_ms") > 25}
    got = {r.rule: (r.tp, r.tn, r.fp, r.fn) for r in M.rescore(four, rules, "ground_truth").collect()}
    assert got == {"flag": (1, 1, 1, 1), "slow": (0, 0, 2, 2)}


def test_nan_latency_counts_as_missing_on_both_routes(spark):
    from sievemark.operators import metrics as M

    rows = [("a", float(v)) for v in range(20)] + [("a", float("nan")), ("a", None), ("b", None)]
    df = spark.createDataFrame(rows, "k string, ms double")
    found = [
        {r.k: tuple(r)[1:] for r in M.latency_stats(df, "ms", ["k"], single_task_rows=n).collect()}
        for n in (1000, 5)
    ]
    assert found[0] == found[1] == {"a": (9.5, 18.05), "b": (None, None)}
