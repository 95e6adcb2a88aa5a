"""A training corpus from raw documents: the stages, applied one after the other.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result as Parquet to the shared folder and rereads it as the next stage's input.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm import decontamination, near_dedup, piece_nbest, quality_bands, secret_owners
from sievemark.llm.common import table
from sievemark.session import result_of

# Near-duplicate documents share five-word shingles to 80 percent or more.
NEAR = near_dedup.MinHash(shingle=5, percent=80, bands=40, rows=5)
PIECE_MODEL = "piece_bpe_32k.model"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the compression bands."""
    return quality_bands.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest id."""
    return near_dedup.drop_near_duplicates(docs, spec=NEAR)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live secrets blanked out; ``n_chars`` follows the text."""
    return secret_owners.redact(docs).withColumn(
        "n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
    )


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_chars, n_pieces, ids, n_best, round_trip): the pieces of every text,
    and whether they decode to it."""
    model = public_tokenizers.path(PIECE_MODEL)
    cut = docs.select("doc_id", "n_chars", "text", piece_nbest.n_best_pieces(F.col("text"), model).alias("p"))
    back = piece_nbest.decoded_pieces(F.col("p.ids"), model)
    text = F.translate(F.coalesce("text", F.lit("")), piece_nbest.SPACE, " ")
    return cut.select(
        "doc_id",
        "n_chars",
        "p.n_pieces",
        "p.ids",
        F.size("p.scores").alias("n_best"),
        (back == text).alias("round_trip"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("piece encoding", piece_encoding),
]

# Compression ratios, sketches and piece lattices have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole ``documents`` table. What a stage needs on
    the way goes when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = result_of(spark, partial(stage, spark, docs, sf_dir), f"pipeline-{number}")
    return docs
