from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from sievemark.functions import flags, guard, text
from sievemark.operators.pii import pii_flags, pii_regex_flags, pii_spans


def column(spark, values, build):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string").orderBy("i")
    return [r[0] for r in df.select(build(F.col("v"))).collect()]


def test_clean_matches_unicode_strip(spark):
    values = ["  a ", "　b\xa0", "\x1c\t c \x85\n", "", "   ", None, "in　side", "​z"]
    got = column(spark, values, text.clean)
    assert got == ["" if v is None else v.strip() for v in values]


def test_words_and_truncation(spark):
    values = ["a  b　c\nd", " x ", "", None]
    assert column(spark, values, text.words) == [["a", "b", "c", "d"], ["x"], [], []]
    assert column(spark, values, lambda c: text.truncate_tokens(c, 2)) == ["a b", "x", "", ""]
    with pytest.raises(ValueError):
        text.truncate_tokens(F.col("v"), 0)


TEXTS = [
    "write to test.user+1@example.co.uk now",
    "a@b no top level",
    "call 13945671234",
    "call 113945671234",
    "call 12945671234",
    "id 230103198008273629",
    "id 23010319800827362X.",
    "id 2301031980082736291",
    "id 230103800827362",
    "full width １２３４５６７８９０１２３４５",
    "My EMAIL is private",
    "她的住址不明",
    "plain sentence",
    "",
    None,
    "@" * 50,
]


def reference_rules(value):
    return [re.search(r.pattern, value) is not None for r in flags.DEFAULT_RULES]


def test_regex_flags_equal_python_regex(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS) if t], "i int, v string")
    for row in pii_regex_flags(df, "v").collect():
        got = [row[f"has_{r.name}"] for r in flags.DEFAULT_RULES]
        assert got == reference_rules(row.v), row.v


def test_obvious_pii(spark):
    def expected(t):
        if not t:
            return True
        return any(reference_rules(t)) or any(k.lower() in t.lower() for k in flags.KEYWORDS)

    assert column(spark, TEXTS, flags.has_obvious_pii) == [expected(t) for t in TEXTS]
    df = spark.createDataFrame([(t,) for t in TEXTS], "v string")
    rows = pii_flags(df, "v").collect()
    assert [r.obvious_pii for r in rows] == [expected(t) for t in TEXTS]


def test_spans_list_every_hit(spark):
    rows = [
        (1, "a@b.com, c@d.org and 13945671234"),
        (2, "nothing"),
        (3, "10.0.0.1 and x@y.zz"),
        (4, None),
    ]
    df = spark.createDataFrame(rows, "id int, t string")
    rules = [*flags.DEFAULT_RULES, flags.IPV4_RULE]
    got = {tuple(r) for r in pii_spans(df, "id", "t", rules).collect()}
    assert got == {
        (1, "email", 0, "a@b.com"),
        (1, "email", 1, "c@d.org"),
        (1, "mobile_11", 0, "13945671234"),
        (3, "ipv4", 0, "10.0.0.1"),
        (3, "email", 0, "x@y.zz"),
    }


def test_guard_text(spark):
    sample = "Safety: Unsafe\nCategory: PII, Unethical Acts\nRefusal: No"
    df = spark.createDataFrame([(sample,), ("safety:　safe; None none None",), ("",), (None,)], "v string")
    got = [r[0] for r in df.select(guard.parse_guard_text(F.col("v"))).collect()]
    assert (got[0].risk_level, got[0].categories, got[0].refusal) == (
        "Unsafe", ["PII", "Unethical Acts"], "No",
    )
    assert (got[1].risk_level, got[1].categories, got[1].refusal) == ("safe", ["None", "none"], None)
    assert got[2].categories == [] and got[3].categories == [] and got[3].risk_level is None


def test_pii_category(spark):
    rows = [("PII, Unethical Acts", []), ("Violent", ["PII", "Violent"]), ("None", []),
            ("pii", ["Violent"]), (None, []), ("x", [" pii "])]
    df = spark.createDataFrame(rows, "c string, p array<string>")
    got = [r[0] for r in df.select(guard.has_pii_category(F.col("c"), F.col("p"))).collect()]
    assert got == [True, True, False, False, False, True]


def test_array_picks(spark):
    rows = [(["None", "PII", "PII"],), (["Violent", "None"],), ([],), (None,)]
    df = spark.createDataFrame(rows, "a array<string>")
    a = F.col("a")
    got = df.select(
        guard.first_pii_index(a), guard.last_item(a), guard.pick(a, 0), guard.pick(a, 9)
    ).collect()
    assert [tuple(r) for r in got] == [
        (1, "PII", "None", "PII"),
        (None, "None", "Violent", "None"),
        (None, "", "", ""),
        (None, "", "", ""),
    ]


def test_reason_text(spark):
    df = spark.createDataFrame([("Unsafe", "PII", None), ("", "None", "No")], "r string, c string, f string")
    got = [r[0] for r in df.select(guard.reason_text(F.col("r"), F.col("c"), F.col("f"))).collect()]
    assert got == ["risk_level=Unsafe; category=PII", "category=None; refusal=No"]
