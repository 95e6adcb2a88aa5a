"""The registered queries over the whole given tables, and the pipeline."""

from __future__ import annotations

import brute
import duckdb
import pytest
import zstandard

import corpus_pipeline
from conftest import DATA
from sievemark.llm import near_dedup, piece_nbest, quality_bands
from sievemark.llm.oracles import ORACLES
from sievemark.llm.queries import QUERIES


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source").collect()
    return {r.doc_id: r for r in rows}


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "embeddings"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got = QUERIES[name](spark, DATA)
    found = duck.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(found.fetchall(), key=repr)


def test_quality(spark, texts):
    got = QUERIES["op1_quality_bands"](spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        counts = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert counts == brute.quality_counts(texts[r.doc_id].text)


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    scored = QUERIES["op2_quality_trees"](spark, DATA).where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in scored) >= 0.9 * len(scored)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    named = QUERIES["op8_language_spans"](spark, DATA).where("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in named) >= 0.95 * len(named)


def test_exact_queries(spark, texts):
    listed = [(d, r.text) for d, r in texts.items()]
    roots = dict(zip(texts, brute.components(listed), strict=True))
    for r in QUERIES["op6_near_dedup"](spark, DATA).collect():
        assert (r.component_id, r.n_shingles) == (roots[r.doc_id], len(brute.shingles(texts[r.doc_id].text, 3)))
    got = sorted(map(tuple, QUERIES["op7_repeated_bytes"](spark, DATA).collect()))
    assert got == sorted(brute.repeats(listed))
    for r in QUERIES["op10_secret_owners"](spark, DATA).collect():
        kinds = [k for _, k, _, _ in brute.base_secrets(texts[r.doc_id].text)]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in range(3))
    assert QUERIES["op5_piece_nbest"](spark, DATA).where("NOT round_trip").count() == 0


def test_pipeline(spark, texts):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    compressor = zstandard.ZstdCompressor(level=3)
    rules = quality_bands.BandRules()
    good = [
        (d, r.text) for d, r in texts.items()
        if quality_bands.judge((r.text or "").encode(), rules, compressor)[6]
    ]
    near = corpus_pipeline.NEAR
    assert isinstance(near, near_dedup.MinHash) and (near.shingle, near.percent) == (5, 80)
    roots = brute.components(good, near.shingle, near.percent)
    single = [x for x, root in zip(good, roots, strict=True) if x[0] == root]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    clean = [d for d, *_, bad in brute.contamination(single, items) if not bad]
    result = corpus_pipeline.run(spark, DATA).collect()
    assert sorted(r.doc_id for r in result) == sorted(clean)
    assert all(r.round_trip for r in result)
    segmenter = piece_nbest.Segmenter(corpus_pipeline.public_tokenizers.path(corpus_pipeline.PIECE_MODEL), 4)
    for r in result:
        if not brute.base_secrets(texts[r.doc_id].text):
            ids, n_pieces, *_ = segmenter.of(texts[r.doc_id].text.encode())
            assert (bytes(r.ids), r.n_pieces) == (ids, n_pieces)
