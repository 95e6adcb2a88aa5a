"""Every registered query against its SQL on the given tables."""

from __future__ import annotations

import math
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry_point
from conftest import DATA
from sievemark.plans.oracles import ORACLES
from sievemark.plans.queries import REGISTRY

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def comparable(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(comparable(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_sql():
    assert set(REGISTRY) == set(ORACLES)
    assert set(REGISTRY) <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_equals_sql(spark, duck, name):
    df = entry_point.queries()[name](spark, DATA)
    cursor = duck.execute(entry_point.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    expected = table(names, cursor.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert table(df.columns, df.collect()) == expected


def test_entry(spark):
    rows = entry_point.entry(spark).collect()
    assert rows and {r.model_key for r in rows} == {"email", "obvious", "cascade"}


def test_people_arrays_grow_in_number(spark, tmp_path, monkeypatch):
    from sievemark.plans import queries

    monkeypatch.setattr(queries, "new_scratch_path", lambda *_: str(tmp_path / "people"))
    monkeypatch.setattr(queries, "ARRAY_BYTES", 4096, raising=False)
    rows = entry_point.queries()["people_json"](spark, DATA).collect()
    assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert len(list((tmp_path / "people").glob("part=*"))) > 16


@pytest.mark.parametrize("blocked", ["zstandard", "sievemark.llm", "corpus_pipeline", "tokenizers"])
def test_core_queries_without_the_optional_part(blocked):
    code = (
        f"import sys; sys.modules[{blocked!r}] = None; import __spark_entry__ as e; "
        "from sievemark.plans.queries import REGISTRY; "
        "assert set(e.queries()) == set(REGISTRY) == set(e.oracle_sql()), len(e.queries())"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=entry_point._ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert "left out" in done.stderr
