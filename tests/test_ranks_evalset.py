from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from sievemark.operators import evalset as E
from sievemark.operators import ranks as R


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, and most of those share a few values."""
    hot = spark.range(6000).select(
        F.lit("hot").alias("g"),
        F.when(F.col("id") % 3 == 0, F.lit(7.5)).otherwise(F.sqrt(F.col("id")) * 3).alias("v"),
    )
    cold = spark.range(50).select(F.lit("cold").alias("g"), (F.col("id") * 1.0).alias("v"))
    odd = spark.createDataFrame(
        [("one", 4.0), ("flat", 2.0), ("flat", 2.0), (None, 1.0), (None, 9.0), ("hot", None),
         ("wide", -1e12), ("wide", 0.0), ("wide", 1e-9), ("wide", 1e12)],
        "g string, v double",
    )
    return hot.unionAll(cold).unionAll(odd).cache()


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_percentile_by_rank_search_equals_builtin(skewed, q):
    expected = {r.g: r.p for r in skewed.groupBy("g").agg(F.percentile("v", q).alias("p")).collect()}
    found = R.exact_percentile(skewed, "v", q, ["g"], "p", single_task_rows=20)
    got = {r.g: r.p for r in found.collect()}
    assert set(got) == set(expected)
    for g, value in expected.items():
        assert math.isclose(got[g], value, rel_tol=1e-12), g


def test_global_percentile_and_routes_agree(skewed):
    narrow = R.exact_percentile(skewed, "v", 0.95, [], "p", single_task_rows=10).first().p
    plain = R.exact_percentile(skewed, "v", 0.95, [], "p").first().p
    assert narrow == plain == skewed.agg(F.percentile("v", 0.95)).first()[0]


def test_take_smallest_routes_agree(spark):
    df = spark.range(2000).select((F.col("id") * 7 % 2000).alias("k"), F.lit("t").alias("text"))
    for n in (1, 10, 333, 1999, 2000, 5000):
        for limit in (5, 10_000):
            got = R.take_smallest(df, n, "k", "k", limit, 20).select("k").collect()
            assert sorted(r.k for r in got) == list(range(min(n, 2000))), (n, limit)
    with pytest.raises(ValueError):
        R.take_smallest(df, 0, "k", "k")


def test_take_smallest_breaks_ties_by_id(spark):
    df = spark.range(100).select("id", (F.col("id") % 2).alias("k"))
    for limit in (3, 10_000):
        got = R.take_smallest(df, 60, "k", "id", limit, 20).collect()
        assert len(got) == 60
        assert sorted(r.id for r in got if r.k == 1) == list(range(1, 20, 2))


def test_number_rows_routes_agree(spark):
    df = spark.range(500).select((F.col("id") * F.col("id")).alias("k"))
    for parts in (1, 13):
        got = R.number_rows(df.repartition(parts), "k", "n").orderBy("k").collect()
        assert [r.n for r in got] == list(range(1, 501)), rows


# --- evaluation sets -----------------------------------------------------------------


@pytest.fixture(scope="module")
def source(spark):
    return spark.createDataFrame(
        [(1, "王小明，可透過test@example.com聯絡"), (2, "李小美，28歲，mail@abc.com")],
        "sample_id bigint, content string",
    )


def test_eval_set_without_a_non_pii_table(source):
    rows = E.build_eval_set(source, 2).collect()
    assert len(rows) == 4 and len({r.sample_id for r in rows}) == 4
    assert {r.sample_type for r in rows} == {"positive", "negative"}
    assert {r.ground_truth for r in rows} == {True, False}
    assert all(r.content in E.SAFE_TEMPLATES for r in rows if not r.ground_truth)


def test_eval_set_prefers_the_non_pii_table(spark, source):
    given = spark.createDataFrame(
        [(1, "安全文本1"), (2, "安全文本2"), (3, None)], "sample_id bigint, content string"
    )
    rows = E.build_eval_set(source, 2, non_pii=given).collect()
    assert {r.content for r in rows if not r.ground_truth} == {"安全文本1", "安全文本2"}


def test_eval_set_top_up_and_modes(spark, source):
    one = spark.createDataFrame([(9, "安全")], "sample_id bigint, content string")
    rows = E.build_eval_set(source, 2, non_pii=one).collect()
    negatives = [r for r in rows if not r.ground_truth]
    assert len(negatives) == 2 and {"安全"} < {r.content for r in negatives}
    short = E.build_eval_set(source, 5, non_pii=one).collect()
    assert sum(not r.ground_truth for r in short) == 3  # 1 given + 2 positives redacted
    only = E.build_eval_set(source, 1, include_negative=False).collect()
    assert [r.content[:3] for r in only] == ["王小明"]
    with pytest.raises(ValueError):
        E.build_eval_set(source, 0)
    with pytest.raises(ValueError):
        E.build_eval_set(source, 1, content_col="nope")


def test_sampling_repeats_and_ignores_partitions(spark):
    df = spark.range(1000).select(F.col("id").alias("sample_id"))
    a = sorted(r[0] for r in E.sample_n(df, 50, "sample_id").collect())
    b = sorted(r[0] for r in E.sample_n(df.repartition(13), 50, "sample_id").collect())
    c = sorted(r[0] for r in E.sample_n(df, 50, "sample_id", seed=1).collect())
    assert a == b and len(a) == 50 and a != c
    few = E.shuffle(df, "sample_id", at_most=1000).collect()
    many = E.shuffle(df, "sample_id").collect()
    assert few == many and few != df.collect()


def test_redaction_is_stable(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "t string")
    got = [r[0] for r in df.select(E.redact(F.col("t"))).collect()]
    assert got[0] == got[1] and all(g in E.SAFE_TEMPLATES for g in got)


def test_repeated_and_text_keys_on_every_route(spark):
    rows = [(1, "a")] * 7 + [(2, "b")] * 5 + [(None, "c")] * 2
    df = spark.createDataFrame(rows, "k int, name string").withColumn("text", F.col("name"))
    for n in (1, 2, 7, 8, 12, 13, 14, 20):
        for top_k, single in ((1000, 10**6), (0, 3)):
            got = R.take_smallest(df, n, "k", "k", top_k, single).collect()
            by_text = R.take_smallest(df, n, "name", "name", top_k, single).collect()
            expected = [r[1] for r in rows][:n]
            assert sorted(r.name for r in got) == expected
            assert sorted(r.name for r in by_text) == expected
    words = spark.createDataFrame([(w,) for w in "the quick brown fox".split()], "w string")
    numbered = R.number_rows(words, "w", "n").orderBy("n").collect()
    assert [tuple(r) for r in numbered] == [("brown", 1), ("fox", 2), ("quick", 3), ("the", 4)]


def test_evaluation_set_with_text_ids(spark):
    texts = spark.createDataFrame([("x", "t1"), ("y", "t2")], "sample_id string, content string")
    others = spark.createDataFrame([(7, "n1"), (8, "n2")], "sample_id bigint, content string")
    built = E.build_eval_set(texts, 2, non_pii=others).collect()
    assert sorted(r.sample_id for r in built) == ["7:1", "8:1", "x:0", "y:0"]
    assert {r.content for r in built if not r.ground_truth} == {"n1", "n2"}
