from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sievemark.operators import compare as C
from sievemark.operators import scoring as S
from sievemark.plans import benchmark as B
from sievemark.sources import readers as R
from sievemark.sources import writers as W
from test_generation import ScriptedRewriter
from test_scoring_metrics import MarkerScorer


@pytest.fixture(scope="module")
def metrics(spark):
    rows = [
        ("a", "granite4:tiny", None, 0.9, 0.1, 5.0, 0.1, 0.8),
        ("b", "x", 0.0, 0.9, 0.0, 9.0, 0.1, 0.9),
        ("c", "x", 2.5, 0.9, 0.1, 4.0, 0.1, None),
        ("d", None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(
        rows,
        "model_key string, model_id string, model_params_b double, tpr double, fpr double, "
        "overhead_latency_ms_avg double, cost_usd_total double, f1 double",
    )


def test_comparison(metrics):
    rows = C.comparison(metrics, params={"x": 7.0}).collect()
    assert [r.f1 for r in rows] == [0.9, 0.8, None, None]
    assert [r.model_params_b for r in rows][:2] == [7.0, 7.0]  # 0 counts as not given
    by_id = {(r.model_id, r.model_params_b) for r in rows}
    assert ("x", 2.5) in by_id and ("unknown", None) in by_id
    assert rows[0].accuracy is None and len(rows[0]) == 9
    assert C.comparison(metrics, sort_by="nope").count() == 4


def test_leaderboard(spark, metrics):
    board = C.leaderboard(metrics).collect()
    assert [r.model_key for r in board] == ["b", "c", "a", "d"]
    assert [r["rank"] for r in board] == [1, 2, 3, 4]
    failed = spark.createDataFrame([("x", "failed"), ("w", "failed")], "model_key string, status string")
    assert [r.model_key for r in C.leaderboard(failed).collect()] == ["w", "x"]
    assert C.report(metrics, ["tpr", "absent"]).columns == ["tpr"]
    assert C.report(metrics, ["absent"]).columns == metrics.columns


def test_select_models(spark):
    models = spark.createDataFrame(
        [("k1", "m"), ("k2", "m"), ("k3", "z"), ("m2", "k3")], "key string, model_id string"
    )
    facts = spark.range(8).select(
        F.element_at(F.array(*map(F.lit, ("k1", "k2", "k3", "m2"))), (F.col("id") % 4 + 1).cast("int"))
        .alias("model_key")
    )

    def chosen(*names):
        return sorted({r[0] for r in C.select_models(facts, models, names).collect()})

    assert chosen("k1") == ["k1"] and chosen("m") == ["k1", "k2"]
    assert chosen("k3") == ["k3"]  # the key wins over the equal model id
    assert chosen("m", "k1", "z") == ["k1", "k2", "k3"]
    assert C.resolve_models(models, []).count() == 4
    with pytest.raises(ValueError, match="nope.*known keys"):
        C.select_models(facts, models, ["k1", "nope"])


# --- sources and sinks -------------------------------------------------------------------

TEXTS = ['plain', 'with "quotes", commas', "two\nlines", "中文\t。"]


def test_people_array(spark, tmp_path):
    person = {"name": "白", "age": 43, "idCardNumbers": 230103198008273629, "income": 560000,
              "naturalParagraph": "白是一位…"}
    other = {**person, "idCardNumbers": "23010319800827362X"}
    (tmp_path / "p.json").write_text(json.dumps([person, other], ensure_ascii=False), "utf-8")
    rows = R.read_people(spark, str(tmp_path / "p.json")).collect()
    assert [r.idCardNumbers for r in rows] == ["230103198008273629", "23010319800827362X"]
    assert rows[0].age == 43 and rows[0].gender is None


def test_csv_round_trip_and_checks(spark, tmp_path):
    df = spark.createDataFrame([(t, "x") for t in TEXTS], "naturalParagraph string, other string")
    W.write_texts(df, str(tmp_path / "t"), "naturalParagraph")
    back = R.read_texts(spark, str(tmp_path / "t"))
    assert back.columns == ["sample_id", "naturalParagraph"]
    assert sorted(r[1] for r in back.collect()) == sorted(TEXTS)
    W.write_texts(df.union(df), str(tmp_path / "twice"), "naturalParagraph")
    twice = R.read_texts(spark, str(tmp_path / "twice"))
    ids = [r[0] for r in twice.collect()]
    assert len(set(ids)) == 8 and ids == [r[0] for r in twice.collect()]
    with pytest.raises(ValueError, match="missing"):
        R.read_texts(spark, str(tmp_path / "t"), "nope")


def test_non_pii_source(spark, tmp_path):
    rows = [("a", "ok"), ("b", "failed"), (None, "ok")]
    df = spark.createDataFrame(rows, "naturalParagraph string, generation_status string")
    W.write_generated(df, str(tmp_path / "g"), "csv")
    usable = R.read_non_pii(spark, str(tmp_path / "g")).collect()
    assert [r.naturalParagraph for r in usable] == ["a"] and usable[0].sample_id
    assert R.read_non_pii(spark, str(tmp_path / "absent")) is None
    assert R.read_non_pii(spark, str(tmp_path / "g"), "other") is None


def test_metrics_folder(spark, tmp_path):
    good = {"model_id": "m", "f1": 0.5, "total": 4, "tp": 1}
    (tmp_path / "a_metrics.json").write_text(json.dumps(good, indent=2))
    (tmp_path / "b_metrics.json").write_text('{"model_id": "broken", ')
    (tmp_path / "c.json").write_text(json.dumps(good))
    ok, bad = R.read_metrics(spark, str(tmp_path))
    assert [(r.model_id, r.f1, r._source_file) for r in ok.collect()] == [("m", 0.5, "a_metrics.json")]
    assert [r._source_file for r in bad.collect()] == ["b_metrics.json"]
    lines = json.dumps(good) + "\n" + json.dumps({**good, "model_id": "n"}) + "\n{cut\n"
    (tmp_path / "d_metrics.json").write_text(lines)
    ok, bad = R.read_metrics(spark, str(tmp_path))
    assert sorted(r.model_id for r in ok.collect()) == ["m", "m", "n"]
    assert sorted(r._broken for r in bad.collect())[1] == "{cut"
    assert B.compare_stored(spark, str(tmp_path)).first().model_id == "m"


def test_results_overwrite_one_model_and_append(spark, tmp_path):
    path = str(tmp_path / "r")
    df = spark.createDataFrame(
        [("r1", "a", 1), ("r1", "b", 2), ("r2", "a", 3)], "run_id string, model_key string, v int"
    )
    W.write_results(df, path)
    W.write_results(df.where("v = 2").withColumn("v", F.lit(20)), path)

    def values():
        return sorted(r.v for r in spark.read.parquet(path).collect())

    assert values() == [1, 3, 20]
    W.write_results(df.where("v = 3"), path, append=True)
    assert values() == [1, 3, 3, 20]


def test_metrics_sink_and_history(spark, tmp_path):
    df = spark.createDataFrame([("m", None), ("n", 0.5)], "model_id string, f1 double")
    W.write_metrics(df, str(tmp_path / "m"))
    W.write_metrics(df, str(tmp_path / "m"), append=True)
    lines = [json.loads(x) for f in (tmp_path / "m").glob("*.json") for x in f.read_text().splitlines()]
    assert len(lines) == 4 and {"model_id": "m", "f1": None} in lines
    W.write_comparison(df, str(tmp_path / "h"), append=True)
    W.write_comparison(df.drop("f1").withColumn("tpr", F.lit(1.0)), str(tmp_path / "h"), append=True)
    rows = R.read_history(spark, str(tmp_path / "h")).collect()
    assert len(rows) == 4 and sum(r.tpr is None for r in rows) == 2
    with pytest.raises(ValueError):
        W.write_comparison(df, str(tmp_path / "c"), append=True, fmt="csv")


# --- workflows ------------------------------------------------------------------------------


class BrokenScorer(MarkerScorer):
    key = "broken"

    def open(self):
        raise RuntimeError("cannot load")


def test_benchmark_run(spark, tmp_path):
    source = spark.createDataFrame(
        [(i, f"person {i} a{i}@example.com") for i in range(1, 8)], "sample_id bigint, content string"
    )
    run = B.run_benchmark(
        source, [S.EMAIL_SCORER, MarkerScorer(), BrokenScorer()], str(tmp_path), n=5,
        started=datetime(2024, 5, 1, 8, 30, 0),
    )
    board = run.board.collect()
    assert run.run_id == "20240501T083000"
    assert [r.model_key for r in board][-1] == "broken" and board[-1].status == "failed"
    assert "cannot load" in board[-1].error
    assert {r.model_key: (r.tp, r.tn, r.tpr) for r in board[:2]} == {
        "email": (5, 5, 1.0), "fake": (5, 5, 1.0),
    }
    results = spark.read.parquet(run.results_path)
    assert results.count() == 20 and set(results.columns) >= {"prediction", "run_id", "model_finished_at"}
    good, _ = R.read_metrics(spark, run.metrics_path, "*.json", lines=True)
    assert C.comparison(good).count() == 3
    assert spark.read.parquet(run.board_path).count() == 3


def test_build_corpus(spark, tmp_path):
    df = spark.createDataFrame([(1, "0"), (2, "1")], "sample_id bigint, content string")
    rows = B.build_corpus(df, 2, ScriptedRewriter(), str(tmp_path / "c")).orderBy("id").collect()
    assert [(r.id, r.content, r.retry_count) for r in rows] == [(1, "safe 0", 0), (2, "safe 1", 1)]


def test_only_the_result_of_a_block_stays(spark, tmp_path, monkeypatch):
    from sievemark import session

    monkeypatch.setattr(session, "scratch_dir", lambda _: str(tmp_path))

    def make():
        some = session.materialize(spark.range(10).toDF("a"), "some")
        more = session.materialize(some.where("a > 3"), "more")
        return more.where("a < 8")

    kept = session.result_of(spark, make, "kept")
    assert sorted(r.a for r in kept.collect()) == [4, 5, 6, 7]
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["kept"]
    with pytest.raises(ValueError):
        session.result_of(spark, lambda: make().limit(int("x")), "lost")
    assert len(list(tmp_path.iterdir())) == 1
