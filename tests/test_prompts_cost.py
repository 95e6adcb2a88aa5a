from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sievemark.operators import cost as C
from sievemark.operators import prompts as P


def test_binary_prompt_names_the_answer_keys(spark):
    df = spark.createDataFrame([("測試 {content} {x}",)], "content string")
    user = P.render_user(df, "pii_binary").first().user
    for key in ("contains_pii", "label", "confidence", "reason"):
        assert f'"{key}"' in user
    assert "測試 {content} {x}" in user and "{{" not in user and '{\n  "contains_pii"' in user


def test_render_fans_out_and_overrides(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, content string")
    rows = P.render(df, ["m1", "m2"], ["pii_binary", "stream_safety"], {"m2": "own"}).collect()
    assert len(rows) == 8
    assert {r.system for r in rows if r.model_id == "m2"} == {"own"}
    assert {r.system for r in rows if r.model_id == "m1"} == {P.SYSTEM_PROMPT}
    plain = P.STREAM_SAFETY.format(content="a")
    assert {r.user for r in rows if r.id == 1 and r.task_id == "stream_safety"} == {plain}
    binary = P.PII_BINARY.format(content="")
    assert {r.user for r in rows if r.id == 2 and r.task_id == "pii_binary"} == {binary}


def test_prompt_errors(spark):
    df = spark.createDataFrame([(1,)], "id int")
    with pytest.raises(ValueError, match="lacks columns"):
        P.render_user(df, "pii_binary")
    with pytest.raises(ValueError, match="pii_detection"):
        P.render_user(df, "nope")
    own = {"own": "{a}-{{{b}}}"}
    two = df.select(F.lit("x{b}").alias("a"), F.lit("y").alias("b"))
    assert P.render_user(two, "own", own).first().user == "x{b}-{y}"


def test_messages(spark):
    df = spark.createDataFrame([("s", "u\nv")], "s string, u string")
    chat = P.messages(F.col("s"), F.col("u"))
    assert df.select(P.flatten_messages(chat)).first()[0] == "system: s\nuser: u\nv"
    strict, normal = df.select(
        P.rewrite_messages(F.col("u"), True)[1]["content"],
        P.rewrite_messages(F.col("u"), False)[1]["content"],
    ).first()
    assert strict.startswith(P.REWRITE_STRICT) and normal.startswith(P.REWRITE_NORMAL)
    assert strict.endswith("u\nv")


def test_pricing_and_cost(spark):
    raw = spark.createDataFrame(
        [(
            '{"data": [{"id": "m", "pricing": {"prompt": "1", "completion": "1"}},'
            '{"id": "m", "pricing": {"prompt": 0.5, "completion": "2"}},'
            '{"id": "x", "pricing": {"prompt": "free", "completion": "2"}},'
            '{"id": "", "pricing": {"prompt": "1", "completion": "2"}},'
            '{"id": "y", "pricing": null}, {"id": "z"}]}',
        )],
        "raw string",
    )
    prices = C.clean_pricing(raw)
    assert [tuple(r) for r in prices.collect()] == [("m", 0.5, 2.0)]
    usage = spark.createDataFrame(
        [("m", 2, 3, None), ("m", 2, None, "n/a"), ("m", 1, 1, "0.25"), ("u", 5, 5, None)],
        "model_id string, prompt_tokens bigint, completion_tokens bigint, reported string",
    )
    costs = C.with_cost(usage, prices, "reported").collect()
    assert sorted(r.cost_usd for r in costs) == [0.0, 0.25, 1.0, 7.0]
    totals = C.token_totals(usage).first()
    assert (totals.prompt_tokens_total, totals.completion_tokens_total) == (10, 9)
