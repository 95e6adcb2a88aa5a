from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from sievemark.functions.flags import EMAIL, has_obvious_pii
from sievemark.operators import generation as G


class ScriptedRewriter(G.Rewriter):
    """Answers by the attempt: the text says on which attempt it gives in."""

    model_id = "scripted"

    def rewrite(self, messages, source_text, attempt):
        assert [m["role"] for m in messages] == ["system", "user"]
        assert messages[1]["content"].endswith(source_text)
        strict = messages[1]["content"].startswith("你上一版")
        assert strict == (attempt > 0)
        if source_text and attempt == int(source_text):
            return "```json\n" + json.dumps({"non_pii_text": f" safe {attempt} "}) + "\n```"
        return ["", '{"non_pii_text": "x@example.com"}', "no json"][attempt]


def test_rewrite_rounds(spark):
    df = spark.createDataFrame(
        [(1, " 0 "), (2, "2"), (3, "9"), (4, None), (5, "1")], "id bigint, source_text string"
    )
    df = df.withColumn("source_text", F.when(F.col("id") == 4, None).otherwise(F.col("source_text")))
    rows = {r.id: r for r in G.rewrite_until_clean(df, ScriptedRewriter(), 2).collect()}
    got = {i: (r.content, r.generation_status, r.retry_count, r.raw_response) for i, r in rows.items()}
    assert {i: g[:3] for i, g in got.items()} == {
        1: ("safe 0", "ok", 0), 2: ("safe 2", "ok", 2), 3: ("", "failed", 2),
        4: ("", "failed", 2), 5: ("safe 1", "ok", 1),
    }
    assert got[3][3] == "no json" and rows[1].source_text == "0" and rows[4].source_text == ""
    assert rows[2].model_id == "scripted"
    none = G.rewrite_until_clean(df, ScriptedRewriter(), 0)
    assert {r.generation_status for r in none.where("id <> 1").collect()} == {"failed"}
    with pytest.raises(ValueError):
        G.rewrite_until_clean(df, ScriptedRewriter(), -1)


def test_resolved_attempts_agree_with_the_rounds(spark):
    good = '{"non_pii_text": "fine"}'
    rows = [
        (1, 0, good), (1, 1, '{"non_pii_text": "later"}'),
        (2, 0, "?"), (2, 1, '{"non_pii_text": "my Email"}'), (2, 2, good),
        (3, 0, "?"), (3, 1, "[" + good + "]"), (3, 2, '{"non_pii_text": null, "x": "email"}'),
        (4, 0, "?"), (4, 1, "?"), (4, 2, "last"), (4, 3, good),
    ]
    df = spark.createDataFrame(rows, "id bigint, attempt int, raw_response string")
    got = {r.id: tuple(r)[1:] for r in G.resolve_attempts(df, 2).collect()}
    assert got == {
        1: ("fine", "ok", 0, good),
        2: ("fine", "ok", 2, good),
        3: ("None", "ok", 2, '{"non_pii_text": null, "x": "email"}'),
        4: ("", "failed", 2, "last"),
    }
    summary = {r.generation_status: (r.n, r.retries_avg) for r in G.generation_summary(
        G.resolve_attempts(df, 2)).collect()}
    assert summary == {"ok": (3, 1.3333), "failed": (1, 2.0)}


def test_generate_corpus_numbers_rows(spark):
    df = spark.createDataFrame(
        [(30, "0"), (10, "1"), (20, "7"), (40, "0")], "sample_id bigint, content string"
    )
    rows = G.generate_corpus(df, 3, ScriptedRewriter()).orderBy("id").collect()
    assert [(r.id, r.source_text, r.generation_status) for r in rows] == [
        (1, "1", "ok"), (2, "7", "failed"), (3, "0", "ok"),
    ]
    with pytest.raises(ValueError):
        G.generate_corpus(df, 0, ScriptedRewriter())


PHRASES = {"ab": "1", "abc": "2", "b": "3", "c+": "4", "身份": "身分", "bcd": "5"}
TEXTS = ["abcd", "ababc", "xbcdx", "c+c", "身份證", "", None, "nothing", "abcc+bcd"]


def brute_force(text):
    if text is None:
        return None
    out, at = "", 0
    while at < len(text):
        best = max((p for p in PHRASES if text.startswith(p, at)), key=len, default=None)
        out += PHRASES[best] if best else text[at]
        at += len(best) if best else 1
    return out


@pytest.mark.parametrize("literal, shared", [(500, 10_000), (0, 10_000), (0, 0)])
def test_phrase_mapping_routes_agree(spark, literal, shared):
    df = spark.createDataFrame(list(enumerate(TEXTS * 2)), "i int, t string")
    table = spark.createDataFrame(list(PHRASES.items()), "phrase string, target string")
    got = G.map_phrases(df, "t", table, literal, shared).orderBy("i").collect()
    assert [r.t for r in got] == [brute_force(t) for t in TEXTS * 2]


def test_phrase_mapping_special_cases(spark):
    df = spark.createDataFrame([("汉语",), (None,)], "t string")
    assert [r.t for r in G.map_phrases(df, "t", {"汉": "漢", "语": "語"}).collect()] == ["漢語", None]
    assert G.map_phrases(df, "t", {}) is df


def test_accepted_texts_show_no_pii(spark):
    raws = ['{"non_pii_text": "a@b.cc"}', '{"non_pii_text": "ok"}', '{"non_pii_text": 5}',
            '{"non_pii_text": ""}', "{}", None]
    df = spark.createDataFrame([(r,) for r in raws], "raw string")
    rows = G.with_accepted(df, "raw")
    assert [r.candidate for r in rows.collect()] == [None, "ok", "5", None, None, None]
    assert rows.where(has_obvious_pii(F.col("candidate")) & F.col("candidate").isNotNull()).isEmpty()
    assert rows.where(F.col("candidate").rlike(EMAIL)).isEmpty()


def test_faulty_phrase_tables_are_refused_on_every_route(spark):
    df = spark.createDataFrame([("abc",)], "t string")
    for rows, problem in (([("a", None)], "without a target"), ([("a", "x"), ("a", "y")], "repeated")):
        table = spark.createDataFrame(rows, "phrase string, target string")
        for literal, shared in ((10, 10), (0, 10), (0, 0)):
            with pytest.raises(ValueError, match=problem):
                G.map_phrases(df, "t", table, literal, shared)
    with pytest.raises(ValueError):
        G.map_phrases(df, "t", {"a": None})


def test_phrase_routes_agree_on_many_lengths(spark):
    import random

    random.seed(5)
    text = "".join(random.choices("abé漢 ", k=4000))
    phrases = {text[i : i + n]: f"<{n}>" for n in range(1, 1101) for i in [random.randrange(2800)]}
    table = spark.createDataFrame(list(phrases.items()), "phrase string, target string")
    df = spark.createDataFrame([(1, text), (2, text[::-1]), (3, ""), (4, None), (5, text)], "i int, t string")
    results = [
        [r.t for r in G.map_phrases(df, "t", table, 0, shared).orderBy("i").collect()]
        for shared in (10**6, 0)
    ]
    assert results[0] == results[1]
    assert results[0][0] != text and results[0][2:4] == ["", None]


CHAIN = [{"ab": "b", "b": "cc"}, [{"c": "d", "bc": "x"}, {"c": "never", "d": "e"}], {"dd": "ab", "x": ""}]


def longest_first(text, phrases):
    out, at = [], 0
    while at < len(text):
        hit = max((p for p in phrases if text.startswith(p, at)), key=len, default=None)
        out.append(text[at] if hit is None else phrases[hit])
        at += 1 if hit is None else len(hit)
    return "".join(out)


@pytest.mark.parametrize("bounds", [{}, {"literal_phrases": 0}, {"literal_phrases": 0, "broadcast_phrases": 0}])
@pytest.mark.parametrize("as_table", [False, True])
def test_stages_follow_each_other(spark, bounds, as_table):
    draw = random.Random(5)
    texts = ["".join(draw.choices("abcdx", k=draw.randint(0, 12))) for _ in range(60)] + [None, "", "abab"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    stages = list(CHAIN)
    if as_table or "broadcast_phrases" in bounds:
        table = lambda d: spark.createDataFrame(list(d.items()), "phrase string, target string")
        stages = [table(CHAIN[0]), [CHAIN[1][0], table(CHAIN[1][1])], table(CHAIN[2])]
    got = {r.id: r.text for r in G.convert_phrases(df, "text", stages, **bounds).collect()}
    for i, text in enumerate(texts):
        wanted = text
        if text is not None:
            for stage in (CHAIN[0], {**CHAIN[1][1], **CHAIN[1][0]}, CHAIN[2]):
                wanted = longest_first(wanted, stage)
        assert got[i] == wanted
    assert G.convert_phrases(df, "text", []).collect() == df.collect()


def test_repeated_phrases_of_a_stage_are_an_error(spark):
    twice = spark.createDataFrame([("a", "b"), ("a", "c")], "phrase string, target string")
    df = spark.createDataFrame([("a",)], "text string")
    with pytest.raises(ValueError, match="repeated"):
        G.convert_phrases(df, "text", [[{"x": "y"}, twice]])
