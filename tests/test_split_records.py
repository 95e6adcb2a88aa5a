"""Readers that split large CSV and JSON files, against Spark's own and across split sizes."""

from __future__ import annotations

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from sievemark.operators import evalset
from sievemark.sources import readers as R
from sievemark.sources import split_records as X

BYTES = "spark.sql.files.maxPartitionBytes"
SIZES = (700, 5_000, 1 << 20)


@pytest.fixture
def splits(spark):
    """Sets the size of splits; small files are not put together."""
    cost = "spark.sql.files.openCostInBytes"
    kept = {k: spark.conf.get(k, None) for k in (BYTES, cost)}
    spark.conf.set(cost, "1")

    def set_size(size):
        spark.conf.set(BYTES, str(size))

    yield set_size
    for key, value in kept.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def cells(n, seed=1):
    draw = random.Random(seed)
    parts = ["word", 'say "hi"', "a,b", "line\nbreak", "\n", '"', "é北京", "", '""', "x" * 900, "tail\n\n", "'"]
    return [" ".join(draw.choices(parts, k=draw.randint(0, 6))) for _ in range(n)]


def write_csv(path, rows, end="\n"):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["text", "naturalParagraph"])
    writer.writerows(rows)
    path.write_text(out.getvalue(), encoding="utf-8", newline="")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_rows_come_in_file_order_at_any_split_size(spark, splits, tmp_path, end):
    texts = cells(400)
    for number in range(3):
        some = texts[number * 130 : (number + 1) * 130 if number < 2 else None]
        write_csv(tmp_path / f"part-{number}.csv", [(str(i), t) for i, t in enumerate(some)], end)
    usual = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path))
    expected = sorted(map(str, usual.collect()))
    found = {}
    for size in SIZES:
        splits(size)
        df = R.read_texts(spark, str(tmp_path))
        rows = df.orderBy("sample_id").collect()
        assert [r.sample_id for r in rows] == list(range(1, 401))
        assert sorted(str(r)[: str(r).index("sample_id=")] + str(r)[str(r).index("text=") :] for r in rows) == [
            "Row(" + e[4:] for e in expected
        ]
        found[size] = [(r.text, r.naturalParagraph) for r in rows]
        first = evalset.take_first(df, 140, "sample_id").orderBy("sample_id").collect()
        assert [(r.text, r.naturalParagraph) for r in first] == found[size][:140]
    assert found[SIZES[0]] == found[SIZES[1]] == found[SIZES[2]]
    assert [t for t, _ in found[SIZES[0]][:131]] == [*map(str, range(130)), "0"]


def test_one_file_is_read_by_many_tasks(spark, splits, tmp_path):
    write_csv(tmp_path / "one.csv", [(str(i), t) for i, t in enumerate(cells(600))])
    splits(2_000)
    chunks = spark.read.option("lineSep", "\n").text(str(tmp_path))
    assert chunks.rdd.getNumPartitions() > 20
    assert R.read_texts(spark, str(tmp_path)).count() == 600


def test_a_cell_larger_than_splits(spark, splits, tmp_path):
    long = "line\n" * 3_000
    write_csv(tmp_path / "one.csv", [("a", "x"), ("b", long), ("c", "y"), ("d", "z\n")])
    splits(1_000)
    rows = R.read_texts(spark, str(tmp_path)).orderBy("sample_id").collect()
    assert [(r.text, r.naturalParagraph) for r in rows] == [("a", "x"), ("b", long), ("c", "y"), ("d", "z\n")]


def test_blank_lines_open_quotes_ids_and_plain_lines(spark, splits, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('﻿id,naturalParagraph\n1,one\n\n2,"two"\n\n\n3,"never closed\nat all', encoding="utf-8")
    rows = R.read_texts(spark, str(path)).orderBy("sample_id").collect()
    assert [r.naturalParagraph for r in rows] == ["one", "two", "never closed\nat all"]
    assert [r.sample_id for r in rows] == [1, 3, 6]
    path.write_text('sample_id,naturalParagraph\nx,5" disk\ny,plain\n', encoding="utf-8")
    rows = R.read_texts(spark, str(path), multi_line=False).collect()
    assert {(r.sample_id, r.naturalParagraph) for r in rows} == {("x", '5" disk'), ("y", "plain")}
    path.write_text("sample_id,naturalParagraph\n", encoding="utf-8")
    assert R.read_texts(spark, str(path)).collect() == []
    assert R.read_non_pii(spark, str(tmp_path / "missing.csv")) is None


def people(n, seed=3):
    draw = random.Random(seed)
    odd = ["}", "{", "[", "]", '"', "\\", "\\\\", '\\"', "],[", "},{", "é", "\n", "plain text " * 20, '{"name": "no"}']
    return [
        {"name": f"p{i}", "age": i, "naturalParagraph": "".join(draw.choices(odd, k=draw.randint(0, 7))),
         "transactionDetails": {"more": [{"a": "}"}, {}]} if i % 3 else None}
        for i in range(n)
    ]


def as_values(df):
    """The rows, nested JSON by its value."""
    rows = [r.asDict() for r in df.collect()]
    return sorted(str(r | {"transactionDetails": json.loads(r["transactionDetails"] or "0")}) for r in rows)


@pytest.mark.parametrize("layout", [None, 2])
def test_json_arrays_are_split(spark, splits, tmp_path, layout):
    for number in range(2):
        part = people(150, number)
        for p in part:
            p["name"] += f"-{number}"
        text = json.dumps(part, indent=layout, ensure_ascii=number == 0)
        (tmp_path / f"{number}.json").write_text(text + "\n" * number, encoding="utf-8")
    usual = spark.read.schema(R.PEOPLE_SCHEMA).option("multiLine", True).json(str(tmp_path))
    expected = as_values(usual)
    assert len(expected) == 300
    for size in SIZES:
        splits(size)
        assert as_values(R.read_people(spark, str(tmp_path))) == expected
        records = X.split_records(spark, str(tmp_path), X.ArrayObjects())
        names = [r.name for r in records.orderBy("place").select(F.get_json_object(F.regexp_replace("text", r"^[\s,\[]+", ""), "$.name").alias("name")).collect()]
        assert names == [f"p{i}-{number}" for number in range(2) for i in range(150)]


def test_small_arrays(spark, tmp_path):
    for text, names in (("[]", []), ('[ ]\n', []), ('[{"name": "a"}]', ["a"]), ('[{"name":"a"},\n{"name":"b"}\n]\n\n', ["a", "b"]), ('[{}]', [None])):
        path = tmp_path / "p.json"
        path.write_text(text, encoding="utf-8")
        assert [r.name for r in R.read_people(spark, str(path)).orderBy("name").collect()] == names


def test_a_setting_of_the_session_is_put_back(spark, tmp_path):
    write_csv(tmp_path / "one.csv", [("a", "x")])
    R.read_texts(spark, str(tmp_path)).collect()
    assert spark.conf.get(X.MIN_SPLITS, None) is None
