"""One registered query per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm import (
    centroid_clusters,
    decontamination,
    language_spans,
    near_dedup,
    piece_nbest,
    quality_bands,
    quality_trees,
    repeated_bytes,
    secret_owners,
    sequence_packing,
    token_files,
    vector_codes,
    warc_writer,
)
from sievemark.llm.common import new_scratch_path, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
WORD_TOKENIZER = "word_bpe_49k.json"
END_ID = 1
PIECE_MODEL = "piece_bpe_32k.model"
BYTE_TOKENIZER = "byte_bpe_50k.json"
SEQUENCE_END_ID = 2


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_quality_bands(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_bands.quality_bands(docs).select("doc_id", "bands.*")


@query
def op2_quality_trees(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_trees.score_quality(docs, table(spark, sf_dir, "labels"))


@query
def op3_token_files(spark, sf_dir):
    tokenizer = public_tokenizers.path(WORD_TOKENIZER)
    spec = token_files.TokenSpec(tokenizer, END_ID, token_files.splits_at_space(tokenizer))
    folder = new_scratch_path(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, spec)
    return token_files.id_digest(token_files.read_tokens(spark, folder))


@query
def op4_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.hits(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


def piece_report(docs: DataFrame) -> DataFrame:
    """Best segmentation, scores of the n best, and whether decoding gives the text."""
    model = public_tokenizers.path(PIECE_MODEL)
    cut = docs.select("doc_id", "text", piece_nbest.n_best_pieces(F.col("text"), model).alias("p"))
    back = piece_nbest.decoded_pieces(F.col("p.ids"), model)
    text = F.coalesce("text", F.lit(""))
    return cut.select(
        "doc_id",
        F.octet_length(text).cast("long").alias("n_bytes"),
        "p.n_pieces",
        "p.n_bytes_spelled",
        F.crc32("p.ids").alias("ids_crc32"),
        F.get("p.scores", F.lit(0)).alias("best_score"),
        F.array_join(F.col("p.scores").cast("array<string>"), ",").alias("scores"),
        F.crc32(F.to_json("p.alternatives").cast("binary")).alias("alternatives_crc32"),
        (back == F.translate(text, piece_nbest.SPACE, " ")).alias("round_trip"),
    )


@query
def op5_piece_nbest(spark, sf_dir):
    return piece_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op6_near_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs)


@query
def op7_repeated_bytes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeated_bytes.remove_repeats(docs).drop("kept")


@query
def op8_language_spans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_spans.identify(docs)


@query
def op9_warc_writer(spark, sf_dir):
    folder = new_scratch_path(spark, "warc")
    warc_writer.write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return warc_writer.read_warc(spark, folder, payloads=False).drop("url", "payload")


@query
def op10_secret_owners(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return secret_owners.report(secret_owners.secret_spans(docs))


@query
def op11_vector_codes(spark, sf_dir):
    return vector_codes.code_report(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


@query
def op12_sequence_packing(spark, sf_dir):
    spec = sequence_packing.Packing(public_tokenizers.path(BYTE_TOKENIZER), SEQUENCE_END_ID)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sequence_packing.pack(docs, spec).drop("ids")


@query
def op13_centroid_clusters(spark, sf_dir):
    return centroid_clusters.cluster_report(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
