"""Messy model answers -> typed records. Expected values come from the fixture list."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from sievemark.functions import answers as A

PLAIN = '{"contains_pii": true, "label": "是", "confidence": 0.91, "reason": "包含身分證資訊"}'
FENCED = '```json\n{"label":"否","confidence":"0.2","reason":"未發現可識別資訊"}\n```'
CUT_OFF = (
    '{\n  "contains_pii": true,\n  "label": "是",\n  "confidence": 0.98,\n'
    '  "reason": "包含身份證號碼'
)


def normalized(spark, *raws):
    df = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    rows = A.with_normalized(df, "raw").orderBy("i").collect()
    return [r.normalized for r in rows]


def parsed(spark, *raws):
    df = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    rows = A.with_parsed_decision(df, "raw").orderBy("i").collect()
    return [r.parsed for r in rows]


def test_ported_normalisation_cases(spark):
    plain, fenced, invalid, cut = normalized(spark, PLAIN, FENCED, "這不是 JSON", CUT_OFF)
    assert (plain.contains_pii, plain.label, plain.confidence) == (True, "是", 0.91)
    assert plain.reason == "包含身分證資訊"
    assert (fenced.contains_pii, fenced.label, fenced.confidence) == (False, "否", 0.2)
    assert (invalid.contains_pii, invalid.label, invalid.confidence) == (None, "無法解析", None)
    assert invalid.reason == "" and invalid.raw_text == "這不是 JSON"
    assert (cut.contains_pii, cut.label, cut.confidence) == (True, "是", 0.98)
    assert cut.reason == "包含身份證號碼"


EDGES = [
    ('{"confidence": NaN, "reason": "x"}', None, 0.0, "x"),
    ('{"confidence": 1.7}', None, 1.0, ""),
    ('{"confidence": -1}', None, 0.0, ""),
    ('{"confidence": true}', None, 1.0, ""),
    ('{"confidence": "true"}', None, None, ""),
    ('{"confidence": "abc"}', None, None, ""),
    ('{"confidence": " 1e-1 "}', None, 0.1, ""),
    ('{"confidence": "1d"}', None, None, ""),
    ('{"confidence": null, "reason": null}', None, None, "None"),
    ('{"confidence": [1]}', None, None, ""),
    ('{"reason": true}', None, None, "True"),
    ('{"reason": "true"}', None, None, "true"),
    ('{"reason": 5}', None, None, "5"),
    ('{"reason": "  "}', None, None, ""),
    ('{"contains_pii": 1}', True, None, ""),
    ('{"contains_pii": 1.0}', True, None, ""),
    ('{"contains_pii": "1.0"}', None, None, ""),
    ('{"contains_pii": 0}', False, None, ""),
    ('{"contains_pii": 2, "label": "no"}', False, None, ""),
    ('{"contains_pii": null, "has_pii": " YES "}', True, None, ""),
    ('{"result": "n", "prediction": "y"}', True, None, ""),
    ('{"a": {"contains_pii": true}}', True, None, ""),
    ('[{"contains_pii": true}]', True, None, ""),
    ('so: {"contains_pii": false} done', False, None, ""),
    ('{"contains_pii": true} {"contains_pii": false}', True, None, ""),
    ('{"contains_pii": false, "contains_pii": true}', True, None, ""),
    ("{'label': '是'}", None, None, ""),
    ('{"label": "是",}', True, None, ""),
    ('{"label":"　是　"}', True, None, ""),
    ('"contains_pii" is probably true', True, None, ""),
    ("contains_pii: FALSE", False, None, ""),
    ('"contains_pii" : 10', True, None, ""),
    ("", None, None, ""),
    ("   ", None, None, ""),
    ("{}", None, None, ""),
    (None, None, None, ""),
]


def test_normalisation_edges(spark):
    for (raw, *expected), record in zip(EDGES, normalized(spark, *[e[0] for e in EDGES])):
        assert [record.contains_pii, record.confidence, record.reason] == expected, raw


def test_strict_object_agrees_with_a_strict_parser(spark):
    raws = [
        '{"label":1}', '{"label":1} tail', '{"label":1}{"x":2}', '{"label":1,}', '{"label":}',
        '{"x":[1,}', '{"label":tru}', '{"label":"a', '{"label":1}]', '{"label":1},"seal":5}',
        '{"label":1},"seal":1} {"b":2}', '{"x":"\\q"}', '{"x":01}', '{"x":+1}', '{"x":.5}',
        '{x:1}', '{"x":1}　', '{"label":"é\\n"}', '{"x":"a\tb"}', '[{"label":1}]', '"s"',
        '12', 'null', '{"label":1}/*c*/', '{"x": {"y": [1, {"z": null}]}, "label": "k"}', '{}',
        '{"label": -Infinity}', '{"label":1e400}', "{'label':1}", '{"body":1}', '{"seal":2}',
    ]
    df = spark.createDataFrame([(r,) for r in raws], "raw string")
    rows = A.with_strict_object(df, F.col("raw"), "o").select(
        "raw", F.col("o").isNotNull().alias("ok")
    )
    for row in rows.collect():
        try:
            expected = isinstance(json.loads(row.raw), dict)
        except ValueError:
            expected = False
        assert row.ok == expected, row.raw


def test_generator_form_refuses_valid_non_objects(spark):
    raws = [
        '{"non_pii_text": "a"}', '```json\n{"non_pii_text": "b"}\n```', '[{"non_pii_text": "c"}]',
        'x {"non_pii_text": "d"} y', '```\n[{"non_pii_text": "e"}]\n```', None, "  ",
        '"{\\"non_pii_text\\": 1}"',
    ]
    df = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    found = A.with_json_object(df, F.col("raw"), "o", generator_form=True)
    text = A.variant_text(F.col("o.non_pii_text")).alias("t")
    got = [r.t for r in found.orderBy("i").select(text).collect()]
    assert got == ["a", "b", None, "d", None, None, None, None]
    loose = A.with_json_object(df, F.col("raw"), "o").orderBy("i").select(text)
    assert [r.t for r in loose.collect()][:5] == ["a", "b", "c", "d", "e"]


def test_record_json_keeps_nulls_and_spacing(spark):
    df = spark.createDataFrame([('{"contains_pii": false, "confidence": 0.4}',)], "raw string")
    out = A.with_normalized(df, "raw").select(A.record_json(F.col("normalized")).alias("j"))
    text = out.first().j
    assert '"contains_pii": false' in text and '"label": "否"' in text
    assert json.loads(text)["raw_text"] == '{"contains_pii": false, "confidence": 0.4}'
    empty = A.with_normalized(df.select(F.lit("無").alias("raw")), "raw")
    value = json.loads(empty.select(A.record_json(F.col("normalized"))).first()[0])
    assert value == {
        "contains_pii": None, "label": "無法解析", "confidence": None, "reason": "",
        "raw_text": "無",
    }


FREE_TEXTS = [
    ('{"contains_pii": true}', True),
    ('{"contains_pii": false}', False),
    ("unknown", False),
    ("eyes", True),
    ("是　", True),
    ("是。", True),
    ("否，", False),
    ("是的，有", True),
    ("答案：否", False),
    ("不含有 PII", False),
    ("含有PII", True),
    ("沒有 pii", False),
    ("有", True),
    ("無", False),
    ("x" * 80 + " yes", None),
    ("x" * 70 + " yes", True),
    ("maybe", None),
    ("", None),
    (None, None),
    ("  YES, no", False),
    ('{"x": 1}', None),
    ('{"x": "no"}', False),
    ('{"contains_pii": null, "raw_text": "是"}', True),
    ('[true]', True),
]


def test_free_text_cascade(spark):
    for (raw, expected), got in zip(FREE_TEXTS, parsed(spark, *[t[0] for t in FREE_TEXTS])):
        assert got is expected, raw


def test_nested_raw_text(spark):
    outer = json.dumps({"contains_pii": None, "label": "無法解析", "raw_text": CUT_OFF}, ensure_ascii=False)
    inner = json.dumps({"raw_text": json.dumps({"raw_text": '{"pii": "y"}'})})
    assert parsed(spark, outer, inner) == [True, True]


def test_error_record_stays_unparseable(spark):
    # 71 characters of fixed text leave 9 for the reason: "model_err", not "... not".
    record = (
        '{"contains_pii": null, "label": "無法解析", "confidence": null, '
        '"reason": "model_error: not found", "raw_text": ""}'
    )
    assert parsed(spark, record) == [None]


def test_contract(spark):
    good = PLAIN
    rows = [
        good,
        '{"contains_pii": true, "label": "否", "confidence": 0.5, "reason": "x"}',
        '{"contains_pii": "true", "label": "是", "confidence": 2, "reason": 5, "more": 1}',
        '{"contains_pii": false, "label": "否", "confidence": 0, "reason": "' + "長" * 21 + '"}',
        "no json",
    ]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, raw string")
    got = [tuple(r.contract) for r in A.with_contract(df, "raw").orderBy("i").collect()]
    T, N = True, False
    assert got == [
        (T, T, T, T, T, T, T, T, T),
        (T, T, T, T, T, T, T, N, T),
        (T, T, N, N, T, N, N, N, N),
        (T, T, T, T, T, T, T, T, N),
        (N, N, N, N, N, N, N, N, N),
    ]


def test_truth_words(spark):
    words = ["是", " YES ", "True", "1", "有", "否", "0", "y", "", None]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in df.select(A.truth_from_text(F.col("w"))).collect()]
    assert got == [True] * 5 + [False] * 5


def test_any_number_of_wraps(spark):
    import json

    def wrapped(core, times):
        for _ in range(times):
            core = json.dumps({"contains_pii": None, "raw_text": core}, ensure_ascii=False)
        return core

    cores = [('{"contains_pii": true}', True), ("no", False), ('{"x": {"a": 1, "a": 2}, "pii": "0"}', False)]
    raws = [wrapped(core, times) for core, _ in cores for times in range(8)]
    assert parsed(spark, *raws) == [said for _, said in cores for _ in range(8)]


def test_repeated_inner_keys_are_accepted(spark):
    raw = '{"contains_pii": true, "confidence": 0.5, "reason": {"a": 1, "a": 2}}'
    (record,) = normalized(spark, raw)
    assert (record.contains_pii, record.confidence) == (True, 0.5)
    assert record.reason == '{"a":2}'
