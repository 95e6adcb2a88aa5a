"""Scorers that take batches, scorers that fail as a whole, and the bound on calls at once."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from sievemark.operators import scoring as S


class Words(S.PythonScorer):
    key = model_id = "words"

    def score(self, content):
        if "bad" in content:
            raise ValueError("bad text")
        return S.Answer('{"label": "%s"}' % ("是" if "pii" in content else "否"), len(content), 3, 0.5)


class WordBatches(S.BatchScorer):
    key = model_id = "batches"
    batch_texts, batch_chars = 4, 40

    def score_batch(self, contents):
        assert len(contents) <= 4 and (len(contents) == 1 or len(contents) * max(map(len, contents)) <= 40)
        assert contents == sorted(contents, key=len)
        return [Words().score(c) for c in contents]


class PlacedErrors(WordBatches):
    key = model_id = "placed"

    def score_batch(self, contents):
        return [ValueError("bad text") if "bad" in c else Words().score(c) for c in contents]


class TooFew(WordBatches):
    key = model_id = "few"

    def score_batch(self, contents):
        return [Words().score(c) for c in contents][: max(1, len(contents) - 1)]


TEXTS = [None, "", "  ", "bad", "a pii", "x" * 90, "so bad pii", *[f"word {i} " * (i % 5 + 1) for i in range(30)]]
SHOWN = ["id", "contains_pii", "output_json", "prompt_tokens", "completion_tokens", "cost_usd", "error"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, content string").repartition(8, "id")


@pytest.mark.parametrize("scorer", [WordBatches(), PlacedErrors(), TooFew()])
def test_batches_equal_single_calls(texts, scorer):
    one = sorted(map(tuple, S.score(texts, Words()).select(*SHOWN).collect()))
    rows = S.score(texts, scorer)
    assert sorted(map(tuple, rows.select(*SHOWN).collect())) == one
    assert sum(e is not None for *_, e in one) == 2
    assert rows.where("latency_ms < 0 OR latency_ms IS NULL").isEmpty()


def test_batches_by_length():
    assert S.batches_by_length(["aaaa", "", "b", "cc", "d" * 9], 2, 8) == [[2, 3], [0], [4]]
    assert S.batches_by_length([], 2, 8) == []


class Broken(S.PythonScorer):
    key = model_id = "broken"

    def open(self):
        raise RuntimeError("no weights")


class Slow(S.PythonScorer):
    key = model_id = "slow"
    concurrency = 4

    def score(self, content):
        start = time.time()
        time.sleep(0.15)
        return S.Answer(f"{start} {time.time()}")


class Slower(Slow):
    key = model_id = "slower"


def test_a_failing_scorer_leaves_the_others(spark, texts):
    scorers = [Broken(), S.EMAIL_SCORER, Words(), WordBatches()]
    rows = S.score_all(texts, scorers, on_error="row")
    counts = {r.model_key: r for r in rows.groupBy("model_key").agg(F.count("*").alias("n"), F.count("error").alias("e")).collect()}
    n = len(TEXTS)
    assert {k: (r.n, r.e) for k, r in counts.items()} == {
        "broken": (n, n), "email": (n, 0), "words": (n, 2), "batches": (n, 2)
    }
    first = rows.where("model_key = 'broken'").first()
    assert first.error == "RuntimeError: no weights"
    assert "model_error: RuntimeError: no weights" in first.output_json
    plain = S.score_all(texts, scorers[1:])
    assert sorted(map(str, plain.select("model_key", *SHOWN).collect())) == sorted(
        map(str, rows.where("model_key <> 'broken'").select("model_key", *SHOWN).collect())
    )
    with pytest.raises(Exception, match="no weights"):
        S.score_all(texts, scorers).collect()
    with pytest.raises(ValueError):
        S.score_all(texts, scorers, on_error="skip")


def most_at_once(rows):
    times = sorted(
        point for r in rows if r.raw for a, b in [map(float, r.raw.split())] for point in ((a, 1), (b, -1))
    )
    now = most = 0
    for _, change in times:
        now += change
        most = max(most, now)
    return most


@pytest.mark.parametrize("bound", [1, 3, 6, 8])
def test_calls_at_once_are_bounded_over_all_partitions(texts, bound):
    rows = S.score(texts, Slow(), max_calls=bound)
    raw = F.get_json_object("output_json", "$.raw_text").alias("raw")
    assert texts.rdd.getNumPartitions() == 8
    assert 1 <= most_at_once(rows.select(raw).collect()) <= bound


def test_scorers_run_at_the_same_time(spark, texts):
    few = texts.limit(16).repartition(1).cache()
    few.count()
    start = time.time()
    rows = S.score_all(few, [Slow(), Slower()], on_error="row")
    raw = F.get_json_object("output_json", "$.raw_text").alias("raw")
    spans = {}
    for r in rows.select("model_key", raw).where("raw <> ''").collect():
        a, b = map(float, r.raw.split())
        low, high = spans.get(r.model_key, (a, b))
        spans[r.model_key] = (min(low, a), max(high, b))
    assert time.time() - start < 60
    (a, b), (c, d) = spans["slow"], spans["slower"]
    assert max(a, c) < min(b, d)


@pytest.mark.parametrize(("calls", "concurrency"), [(1, 4), (3, 4), (6, 1), (8, 4), (100, 4)])
def test_bounded_calls_are_dealt_over_many_tasks(texts, calls, concurrency):
    cores = texts.sparkSession.sparkContext.defaultParallelism
    many = texts.repartition(200)
    rows, threads = S.bounded_calls(many, concurrency, calls)
    assert rows.rdd.getNumPartitions() == min(calls, cores)
    assert 1 <= threads <= concurrency and threads * rows.rdd.getNumPartitions() <= calls


class BatchSizes(S.BatchScorer):
    key = model_id = "sizes"
    batch_texts, batch_chars = 1 << 30, 1 << 60

    def score_batch(self, contents):
        return [S.Answer(str(sum(map(len, contents))))] * len(contents)


def test_what_python_holds_does_not_grow_with_the_partitions(spark):
    long = spark.range(4000).coalesce(1).select(F.repeat(F.lit("abcdefgh"), 500).alias("content"))
    raw = F.get_json_object("output_json", "$.raw_text").cast("long")
    most = S.score(long, BatchSizes()).agg(F.max(raw)).first()[0]
    assert most <= 5 << 20
