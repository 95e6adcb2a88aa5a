"""Readers with explicit schemas and early checks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.operators.generation import STATUS_OK
from sievemark.session import materialize, with_computed
from sievemark.sources.split_records import ArrayObjects, CsvLines, PlainLines, split_records

CONTENT = "naturalParagraph"

# Id numbers are read as text: they may end in a letter and have up to 18 digits.
PEOPLE_SCHEMA = (
    "name string, gender string, age int, location string, occupation string, "
    "idCardNumbers string, emailAddress string, phoneNumbers string, symptoms string, "
    "diagnosticOutcome string, medicationDetails string, doctor string, "
    "transactionDetails string, creditScore int, income bigint, naturalParagraph string"
)

# Single exports, and the part files that a written table consists of.
METRICS_FILES = "{*_metrics.json,part-*.json}"

METRICS_SCHEMA = (
    "model_key string, model_id string, provider string, status string, error string, "
    "execution_time_sec double, model_params_b double, prompt_tokens_total bigint, "
    "completion_tokens_total bigint, tpr double, fpr double, tp bigint, tn bigint, fp bigint, "
    "fn bigint, unparseable bigint, overhead_latency_ms_avg double, "
    "overhead_latency_ms_p95 double, cost_usd_total double, cost_usd_avg double, "
    "accuracy double, precision double, recall double, f1 double, total bigint, run_id string"
)


def read_people(spark: SparkSession, path: str) -> DataFrame:
    """Person records from files that each hold a JSON array of objects. One file is read
    by many tasks, however its array is laid out. What is nested becomes compact JSON."""
    records = split_records(spark, path, ArrayObjects())
    person = F.from_json(F.regexp_replace("text", r"^[\s,\[\x{FEFF}]+", ""), PEOPLE_SCHEMA)
    return records.select(person.alias("p")).select("p.*")


def _header(spark: SparkSession, path: str, multi_line: bool) -> list[str]:
    """Column names: the first record of the first file."""
    reader = spark.read.option("header", True).option("escape", '"')
    return reader.option("multiLine", multi_line).csv(path).columns


def _read_csv(
    spark: SparkSession, path: str, names: list[str], id_col: str, multi_line: bool
) -> DataFrame:
    """The columns as text, and an id where the files have none: the row's number in file
    order, from 1, which depends on nothing but the files."""
    # Quotes are doubled inside cells, and cells may hold line breaks.
    records = split_records(spark, path, CsvLines() if multi_line else PlainLines(), header=True)
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    options = {"escape": '"', "multiLine": "true"}
    line = F.regexp_replace("text", "\r$", "")
    cells = with_computed(records, "cells", F.from_csv(line, schema, options))
    own = [] if id_col in names else [(F.col("place") + 1).alias(id_col)]
    return cells.select(*own, "cells.*")


def read_texts(
    spark: SparkSession,
    path: str,
    content_col: str = CONTENT,
    multi_line: bool = True,
    id_col: str = "sample_id",
) -> DataFrame:
    """CSV with a header, all columns as text; the content column must exist. A file
    without ids gets its row numbers as such, so the smallest ids are the first rows.

    Cells may hold line breaks, and still one file is read by many tasks. A quote belongs
    around a whole cell, doubled inside; turn ``multi_line`` off for files whose cells
    have no line breaks and may have stray quotes.
    """
    names = _header(spark, path, multi_line)
    if content_col not in names:
        raise ValueError(f"missing columns {[content_col]}; available: {names}")
    return _read_csv(spark, path, names, id_col, multi_line)


def read_non_pii(
    spark: SparkSession,
    path: str,
    content_col: str = CONTENT,
    multi_line: bool = True,
    id_col: str = "sample_id",
) -> DataFrame | None:
    """Usable non-PII texts with ids; None if the file or its content column is missing.

    With a ``generation_status`` column only successful rows are kept.
    """
    try:
        names = _header(spark, path, multi_line)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    if content_col not in names:
        return None
    df = _read_csv(spark, path, names, id_col, multi_line)
    if "generation_status" in names:
        df = df.where(F.col("generation_status") == STATUS_OK)
    return df.na.drop(subset=[content_col]).select(id_col, content_col)


def read_metrics(
    spark: SparkSession,
    folder: str,
    pattern: str = METRICS_FILES,
    lines: bool = False,
    schema: str = METRICS_SCHEMA,
) -> tuple[DataFrame, DataFrame]:
    """Metrics files of a folder: (metrics with ``_source_file``, unreadable records).

    A file holds one object, possibly indented, or one object per line; which of the two
    is seen from its first line. With ``lines`` all files are taken to be of the second
    kind, and large ones are split. The second table names what was skipped, so
    nothing is lost silently.
    """
    fields = f"{schema}, _broken string"
    reader = spark.read.option("pathGlobFilter", pattern)
    source = F.col("_metadata.file_name").alias("_source_file")
    if lines:
        raw = (
            reader.schema(fields).option("columnNameOfCorruptRecord", "_broken").json(folder)
            .select("*", source)
        )
    else:
        options = {"columnNameOfCorruptRecord": "_broken"}
        files = reader.text(folder, wholetext=True).select("value", source)
        each = F.filter(F.split("value", r"\r?\n"), lambda line: F.trim(line) != "")
        by_line = F.try_parse_json(F.get(each, F.lit(0))).isNotNull()
        records = F.when(by_line, each).otherwise(F.array("value"))
        raw = (
            files.select(F.explode(records).alias("text"), "_source_file")
            .where(F.trim("text") != "")
            .select(F.from_json("text", fields, options).alias("r"), "_source_file")
            .select("r.*", "_source_file")
        )
    # Parsed once and stored: Spark refuses to query the broken records alone.
    parsed = materialize(raw, "metrics")
    good = parsed.where(F.col("_broken").isNull()).drop("_broken")
    bad = parsed.where(F.col("_broken").isNotNull()).select("_source_file", "_broken")
    return good, bad


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """All appended runs of a comparison table, columns merged by name."""
    return spark.read.option("mergeSchema", True).parquet(path)
