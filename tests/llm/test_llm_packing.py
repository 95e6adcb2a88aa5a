"""Sequence packing against a plain version and round trips."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sievemark.llm.queries import QUERIES
from sievemark.llm.sequence_packing import Encoder, Packing, Places, best_two_fit, pack, piece_bounds, sequences

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(BYTES)


def plain_ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def one_by_one(lengths, capacity):
    """Best-two-fit, one sequence after the other, on a list of lengths."""
    left, done = sorted(lengths), []
    while left:
        bin_, gap = [], capacity
        for x in sorted(left, reverse=True):
            if x <= gap:
                bin_.append(x)
                gap -= x
        for x in bin_:
            left.remove(x)
        if gap and len(bin_) > 1:
            space = gap + bin_[-1]
            pairs = [
                (a + b, a, b) for i, a in enumerate(left) for b in left[:i] if a + b <= space
            ]
            if pairs and max(pairs)[0] > bin_[-1]:
                _, a, b = max(pairs)
                left.append(bin_.pop())
                left.remove(a)
                left.remove(b)
                left.sort()
                bin_ += [a, b]
        done.append(tuple(sorted(bin_, reverse=True)))
    return done


def histogram(lengths):
    counts = defaultdict(int)
    for x in lengths:
        counts[x] += 1
    return counts


def planned(lengths, capacity):
    return [
        tuple(x for x, n in chosen.items() for _ in range(n))
        for chosen, times in best_two_fit(histogram(lengths), capacity)
        for _ in range(times)
    ]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=60))
def test_planning_at_once_equals_one_by_one(lengths):
    assert planned(lengths, 24) == one_by_one(lengths, 24)


def test_the_exchange_fills_a_gap():
    assert planned([6, 3, 2, 2], 10) == [(6, 2, 2), (3,)]
    assert planned([10] * 5 + [4, 4], 10) == [(10,)] * 5 + [(4, 4)]
    assert best_two_fit({1: 10**9, 1024: 10**9}, 1024)[0] == ({1024: 1}, 10**9)
    assert best_two_fit({}, 8) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=50))
def test_places_are_gapless(lengths):
    plan = best_two_fit(histogram(lengths), 16)
    places, seen, taken = Places(plan), defaultdict(int), defaultdict(list)
    for x in lengths:
        sequence, offset = places.of(np.array([x]), np.array([seen[x]]))
        seen[x] += 1
        taken[int(sequence[0])].append((int(offset[0]), x))
    assert len(taken) == places.sequences
    for some in taken.values():
        end = 0
        for offset, x in sorted(some):
            assert offset == end
            end += x
        assert end <= 16


def test_bounds_of_pieces():
    assert piece_bounds(5, 8) == [(0, 5)]
    assert piece_bounds(8, 8) == [(0, 8)]
    assert piece_bounds(20, 8) == [(0, 4), (4, 12), (12, 20)]
    assert piece_bounds(16, 8) == [(0, 8), (8, 16)]


TEXTS = [
    "Plain words, and marks; don't we'll I'd.  Two  spaces\n\nand lines.\n Next\tTab \r\n",
    "'s 't 'tis O'Neil's they'Re rock'n'roll ''s '' s",
    "über façade naïve ñandú — dash, “quotes” … 北京 и русский ελ 12.5€ x²y³ 1a2b a1 ｆｕｌｌ",
    "a b　c​d\x85e\x1cf\x1d g \x0b h\x0c",
    "<|endoftext|> inside <|endoftext|>words and <|other|>",
    " leading", "trailing ", "   ", "\n", "", "_under_score__ __ a_b", "1,000.00 3rd 4 5  6", "é́ ế ́ x́ ,́ a,́",
    "🙂🙂 ok🙂. 🙂\n🙂 a🙂,b", "tab\tword ,word , word .word\n.word\n\n .word",
]


def test_units_give_the_ids_of_whole_texts():
    draw = random.Random(1)
    glued = ["".join(draw.choices([*"aé1,'.\n\t  —s北t_ ", "ll", "’"], k=40)) for _ in range(2500)]
    encoder = Encoder(BYTES)
    assert encoder.by_unit
    for found, text in zip(encoder.ids(TEXTS + glued), TEXTS + glued, strict=True):
        assert found.tolist() == plain_ids(text), text
    words = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not words.by_unit
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for found, text in zip(words.ids(TEXTS), TEXTS, strict=True):
        assert found.tolist() == whole.encode(text, add_special_tokens=False).ids


def test_remembered_units_are_forgotten(monkeypatch):
    monkeypatch.setattr("sievemark.llm.sequence_packing.KNOWN_UNITS", 5)
    monkeypatch.setattr("sievemark.llm.sequence_packing.LONGEST_KNOWN", 6)
    encoder = Encoder(BYTES)
    for _ in range(3):
        for text in TEXTS:
            assert next(encoder.ids([text])).tolist() == plain_ids(text)


def check_packing(rows, texts, spec):
    """Pieces are the documents', sequences gapless and within the capacity."""
    documents, filled = defaultdict(list), defaultdict(list)
    for r in rows:
        documents[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        filled[r.sequence_id].append((r.offset, r.length))
    expected = defaultdict(list)
    for doc, text in texts:
        ids = [*plain_ids(text), spec.end_id]
        for n, (a, b) in enumerate(piece_bounds(len(ids), spec.capacity)):
            expected[doc].append((n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert {k: sorted(v) for k, v in documents.items()} == {k: sorted(v) for k, v in expected.items()}
    for some in filled.values():
        end = 0
        for offset, length in sorted(some):
            assert offset == end
            end += length
        assert end <= spec.capacity
    return filled


def test_packing_of_awkward_documents(spark):
    texts = [(1, None), (1, None), (2, ""), (3, "word " * 500), (4, "word " * 63), (None, "no id"), (5, "x")]
    texts += [(10 + i, t) for i, t in enumerate(TEXTS)] + [(100 + i, "same text of some words") for i in range(300)]
    rows = [(d, t, 1, "x", 2, 3, b"y") for d, t in texts]
    schema = "doc_id bigint, text string, part int, ids string, length int, nth int, base binary"
    df = spark.createDataFrame(rows, schema).repartition(7)
    spec = Packing(BYTES, 2, 64)
    packed = pack(df, spec)
    found = packed.collect()
    filled = check_packing(found, texts, spec)
    lengths = [r.length for r in found]
    assert len(filled) == len(one_by_one(lengths, 64))
    joined = {r.sequence_id: r for r in sequences(packed).collect()}
    for r in found:
        whole = joined[r.sequence_id]
        assert whole.ids[4 * r.offset : 4 * (r.offset + r.length)] == r.ids
        assert r.offset in whole.starts
        assert len(whole.ids) == 4 * whole.length
    assert pack(df.limit(0), spec).collect() == []


def test_query_packs_the_whole_table(spark):
    from conftest import DATA

    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op12_sequence_packing"](spark, DATA).collect()
    filled = check_packing(found, docs, Packing(BYTES, 2))
    assert len(filled) <= 1.01 * (sum(r.length for r in found) / 1024) + 1


@pytest.mark.parametrize("kind", ["Whitespace", "ByteLevel"])
def test_only_plain_byte_level_cutting_is_used(tmp_path, kind):
    import json

    with open(BYTES, encoding="utf-8") as file:
        config = json.load(file)
    config["pre_tokenizer"] = {"type": kind} | ({"add_prefix_space": True, "trim_offsets": True, "use_regex": True} if kind == "ByteLevel" else {})
    changed = tmp_path / "changed.json"
    changed.write_text(json.dumps(config), encoding="utf-8")
    encoder, whole = Encoder(str(changed)), Tokenizer.from_file(str(changed))
    assert not encoder.by_unit
    for found, text in zip(encoder.ids(TEXTS), TEXTS, strict=True):
        assert found.tolist() == whole.encode(text, add_special_tokens=False).ids
