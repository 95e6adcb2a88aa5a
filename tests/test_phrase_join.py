from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.operators import generation as G


def join(df, phrases):
    """By the route of tables that are neither small nor broadcast."""
    table = df.sparkSession.createDataFrame(list(phrases.items()), "phrase string, target string")
    return G.map_phrases(df, "t", table, 0, 0)


def longest_first(text, phrases):
    out, at = [], 0
    while at < len(text):
        sizes = range(min(max(map(len, phrases)), len(text) - at), 0, -1)
        hit = next((text[at : at + n] for n in sizes if text[at : at + n] in phrases), None)
        out.append(text[at] if hit is None else phrases[hit])
        at += 1 if hit is None else len(hit)
    return "".join(out)


def most_rows(plan):
    """The most rows that a step of an executed plan has returned."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return most_rows(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return most_rows(plan.plan())
    metrics, below = plan.metrics(), plan.children()
    own = metrics.apply("numOutputRows").value() if metrics.contains("numOutputRows") else 0
    return max([own, *(most_rows(below.apply(i)) for i in range(below.size()))])


def test_steps_have_no_row_for_every_place_of_a_text(spark):
    texts = ["ab-" * 3000, "-b" * 3000, None, "nothing"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    mapped = join(df, {"ab": "1", "b": "22", "abc": "3"})
    assert {r.i: r.t for r in mapped.collect()} == {0: "1-" * 3000, 1: "-22" * 3000, 2: None, 3: "nothing"}
    assert most_rows(mapped._jdf.queryExecution().executedPlan()) < 100


@pytest.mark.parametrize("alphabet", ["ab", "abé漢𝔘\0", "acegiknoprstuß ẞ\n"])
@pytest.mark.parametrize("rows", ["10000", "3"])
def test_random_texts(spark, alphabet, rows):
    """Batches of three rows end within the phrases and within the texts of a group."""
    draw = random.Random(len(alphabet))
    some = lambda sizes: "".join(draw.choices(alphabet, k=draw.choice(sizes)))
    phrases = {some([1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 40]): some([0, 1, 2, 9]) for _ in range(60)}
    phrases |= {alphabet * 100: "often", alphabet * 9000: "in no text"}
    texts = [some([0, 1, 2, 3, 20, 200]) for _ in range(150)] + [None, "", alphabet * 1000] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    df = df.select("i", "t", F.create_map(F.lit("n"), "i").alias("m"), F.struct("i").alias("s"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        mapped = join(df, phrases)
        got = mapped.collect()
        length = mapped.agg(F.sum(F.length("t"))).first()[0]  # a sort below may not go
        some_rows = mapped.where("i < 9").count()
    finally:
        spark.conf.set(key, before)
    assert mapped.columns == df.columns and len(got) == len(texts) and some_rows == 9
    assert all(r.m == {"n": r.i} and r.s.i == r.i for r in got)
    assert {r.i: r.t for r in got} == {i: t and longest_first(t, phrases) for i, t in enumerate(texts)}
    assert length == sum(len(r.t or "") for r in got)


def test_phrases_do_not_reach_over_texts(spark):
    df = spark.createDataFrame([("xab",), ("cab",), ("c",), ("abc",)], "t string").coalesce(1)
    assert sorted(r.t for r in join(df, {"abc": "!", "bca": "?"}).collect()) == ["!", "c", "cab", "xab"]


def test_copies_of_a_text_are_dealt_out(spark):
    from sievemark.operators import phrase_join as P

    texts = ["a hot text"] * 2000 + [f"text {i}" for i in range(300)] + [None, ""] * 300
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    assert [r[P.SHARES] for r in P.shares_of_groups(df, "t").collect()] == [32]
    mapped = join(df, {"hot": "cold", "t": "T"})
    got = {r.i: r.t for r in mapped.collect()}
    assert got == {i: t and longest_first(t, {"hot": "cold", "t": "T"}) for i, t in enumerate(texts)}
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        sizes = mapped.select("i").rdd.glom().map(len).collect()
    finally:
        spark.conf.set(key, before)
    assert sum(sizes) == len(texts) and max(sizes) < 1500


def test_the_filter_knows_every_phrase(spark):
    from sievemark.operators import phrase_join as P

    draw = random.Random(3)
    phrases = sorted({bytes(draw.choices(range(97, 123), k=draw.randint(1, 70))) for _ in range(3000)})
    words = P._filter(phrases)
    heads, wholes = P._hashes(phrases)
    assert P._marked(words, heads).all() and P._marked(words, wholes).all()
    strange = [b"?" + p for p in phrases]
    assert P._marked(words, P._hashes(strange)[1]).mean() < 0.1
    table = spark.createDataFrame([(p.decode(),) for p in phrases], "phrase string")
    both = table.select(P._phrase_hashes(F.col("phrase").cast("binary")).alias("b"))
    hashed = both.select("b.head", F.col("b.whole").alias(P.HASH))
    assert np.array_equal(P._filter_of_table(hashed, len(phrases)), words)


def test_a_table_without_phrases_changes_nothing(spark):
    df = spark.createDataFrame([("a",), (None,)], "t string")
    empty = spark.createDataFrame([("", "x"), (None, "y")], "phrase string, target string")
    assert {r.t for r in G.map_phrases(df, "t", empty, 0, -1).collect()} == {"a", None}
