"""Packing of tokenised documents into sequences of a fixed number of tokens.

1. Every text is encoded and ended by an end id. Documents longer than a sequence are cut
   into pieces of full length; what is left over is their first piece. Pieces are written
   with their ids, the partition that made them and their number among the pieces of
   equal length there.
2. Only lengths matter to the packing, and there are no more than a sequence has tokens.
   Best-two-fit works on their histogram: a sequence takes the longest piece that fits
   until none does; then the shortest piece in it is exchanged for two unpacked ones
   whose lengths fill the gap it leaves best, if they fill it better. As long as no length
   runs out the next sequence would be filled alike, so equal sequences are planned at
   once. The plan is what filling one sequence after the other gives, and its size
   depends on the length of a sequence, not on the number of documents.
3. Pieces of one length are numbered through by prefix sums over the partitions; a piece's
   number tells its sequence and its place there. No group of equal lengths is collected.

No token of the byte-level tokenizer goes from a letter or digit to a mark or white space,
or from a mark to a space before a word, or over a single line end, so texts are cut there
and frequent units are remembered. ``Encoder`` uses this for tokenizers with that way of cutting and gives
whole texts to others, and to all where an added token stands in the text.

Cases: a null text counts as empty, an empty text has the end id alone; very long texts
give as many pieces as they need; rows that repeat an id or a text are documents of
their own; null ids are kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievemark.llm.common import blobs, bound_batches, byte_letters, materialize, process_wide

LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
WORD = f"0-9{LETTER}"
MARK = r"!-/:-@\[-`{-~"
BREAK = rf"(?:(?<=[{WORD}])(?=[{MARK}\s])|(?<=[!-~])(?= [!-~{WORD}])|(?<=\S\n)(?=[!-~{WORD}]))"
UNIT = re.compile(rf" ?[{WORD}]+(?=[{MARK}\s]|\Z)|.+?(?:{BREAK}|\Z)", re.DOTALL)
LETTERS = re.compile(rf" ?[{LETTER}]+")
KNOWN_UNITS = 400_000
LONGEST_KNOWN = 64
TEXTS_AT_ONCE = 256


@dataclass(frozen=True)
class Packing:
    """Tokenizer file (on every executor), id that ends a document, tokens of a sequence."""

    tokenizer: str
    end_id: int
    capacity: int = 1024


def cuts_like_bytes(config: dict) -> bool:
    """Whether a tokenizer's description has plain byte-level cutting and no other step."""
    cutting = config.get("pre_tokenizer") or {}
    plain = cutting.get("type") == "ByteLevel" and cutting.get("use_regex", True)
    return plain and not cutting.get("add_prefix_space") and not config.get("normalizer")


class UnitIds(dict):
    """Packed ids of units, remembered; what was used since the last turn stays at hand."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.byte_letters = byte_letters()
        self.old: dict[str, bytes] = {}

    def __missing__(self, unit: str) -> bytes:
        packed = self.old.get(unit)
        if packed is None:
            if LETTERS.fullmatch(unit):
                # Cut no further: the tokenizer's model takes it, written in its letters.
                written = unit.encode().decode("latin-1").translate(self.byte_letters)
                ids = [token.id for token in self.model.tokenize(written)]
            else:
                ids = self.tokenizer.encode(unit, add_special_tokens=False).ids
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(unit) <= LONGEST_KNOWN:
            self[unit] = packed
        return packed

    def turn(self) -> None:
        if len(self) > KNOWN_UNITS:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Texts to arrays of ids."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as file:
            self.by_unit = cuts_like_bytes(json.load(file))
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added else None
        self.known = UnitIds(self.tokenizer)

    def of(self, text: str) -> np.ndarray:
        """The ids of a text; in one go where an added token stands in it."""
        if not self.by_unit or (self.added and self.added.search(text)):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return np.frombuffer(b"".join(map(self.known.__getitem__, UNIT.findall(text))), "<u4")

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        yield from map(self.of, texts)
        self.known.turn()


def piece_bounds(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a document; the first one may be shorter."""
    head = total % capacity or min(total, capacity)
    return [(0, head)] + [(at, at + capacity) for at in range(head, total, capacity)]


PIECES_TYPE = (
    "doc_id {id}, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary, part int, nth bigint"
)


def pieces(docs: DataFrame, spec: Packing, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents: place in the document, ids (little-endian, 32 bits)
    and their checksum; ``nth`` numbers those of equal length within a partition."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = process_wide(("packing", spec.tokenizer), lambda: Encoder(spec.tokenizer))
        part, seen, end = TaskContext.get().partitionId(), Counter(), np.array([spec.end_id], "<u4")
        for batch in source:
            for first in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(first, TEXTS_AT_ONCE)
                texts = [(b or b"").decode("utf-8", "replace") for b in blobs(some.column("text"))]
                rows, found = [], []
                for row, ids in enumerate(encoder.ids(texts)):
                    ids = np.concatenate([ids, end])
                    for piece, (start, stop) in enumerate(piece_bounds(len(ids), spec.capacity)):
                        data = ids[start:stop].tobytes()
                        rows.append(row)
                        found.append((piece, start, stop - start, zlib.crc32(data), data, part, seen[stop - start]))
                        seen[stop - start] += 1
                names = ["piece", "start", "length", "ids_crc32", "ids", "part", "nth"]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
                columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
                taken = some.column("doc_id").take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([taken, *columns], names=["doc_id", *names])

    read = bound_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(batches, PIECES_TYPE.format(id=read.schema["doc_id"].dataType.simpleString()))


def closest_pair(counts: np.ndarray, space: int) -> tuple[int, int] | None:
    """Two unpacked lengths, the longer first, that fill the space best; of equally good
    ones those with the longest piece."""
    here = np.flatnonzero(counts)
    longer = here[here < space]
    place = np.searchsorted(here, np.minimum(space - longer, longer), side="right") - 1
    twice = (place >= 0) & (here[place] == longer) & (counts[longer] < 2)
    place = place - twice
    longer, place = longer[place >= 0], place[place >= 0]
    if not len(longer):
        return None
    filled = longer + here[place]
    best = len(filled) - 1 - int(filled[::-1].argmax())
    return int(longer[best]), int(here[place[best]])


def one_sequence(counts: np.ndarray, capacity: int) -> tuple[Counter, Counter]:
    """The lengths of the next sequence, and those that have to be there for the choice."""
    left, gap = counts.copy(), capacity
    chosen: Counter = Counter()
    while True:
        fits = np.flatnonzero(left[: gap + 1])
        if not len(fits):
            break
        length = int(fits[-1])
        n = min(int(left[length]), gap // length)
        chosen[length] += n
        left[length] -= n
        gap -= n * length
    needed = Counter(chosen)
    if gap and chosen.total() > 1:
        shortest = min(chosen)
        pair = closest_pair(left, gap + shortest)
        if pair and sum(pair) > shortest:
            needed.update(pair)
            chosen.update(pair)
            chosen[shortest] -= 1
    return +chosen, needed


def best_two_fit(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(number of pieces by length, sequences filled like that), in order of filling."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    plan = []
    while counts.any():
        chosen, needed = one_sequence(counts, capacity)
        times = 1 + min((int(counts[x]) - needed[x]) // n for x, n in chosen.items())
        for length, n in chosen.items():
            counts[length] -= n * times
        plan.append((dict(sorted(chosen.items(), reverse=True)), times))
    return plan


class Places:
    """Sequence and offset of a piece, by its length and its number among equal ones."""

    def __init__(self, plan: list[tuple[dict[int, int], int]]) -> None:
        rows, taken, sequences = [], Counter(), 0
        for chosen, times in plan:
            offset = 0
            for length, n in chosen.items():
                rows.append((length, taken[length], n, sequences, offset))
                taken[length] += n * times
                offset += n * length
            sequences += times
        self.sequences = sequences
        columns = np.array(sorted(rows), np.int64).reshape(-1, 5).T
        self.length, self.first, self.each, self.sequence, self.offset = columns
        self.starts = {int(x): int(i) for x, i in zip(*np.unique(self.length, return_index=True), strict=True)}
        self.ends = {int(x): int(i) for x, i in zip(*np.unique(self.length, return_counts=True), strict=True)}

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for one in np.unique(length):
            at = np.flatnonzero(length == one)
            low = self.starts[int(one)]
            first = self.first[low : low + self.ends[int(one)]]
            row = low + np.searchsorted(first, number[at], side="right") - 1
            turn, place = np.divmod(number[at] - self.first[row], self.each[row])
            sequence[at] = self.sequence[row] + turn
            offset[at] = self.offset[row] + place * one
        return sequence, offset


def pack(docs: DataFrame, spec: Packing, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset) of every piece.
    Sequences are numbered from 0; the pieces of one fill it from offset 0 without gaps."""
    stored = materialize(pieces(docs, spec, id_col, text_col), "pack-pieces")
    parts = materialize(stored.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    # One row per length, of which there are no more than a sequence has tokens.
    histogram = {r.length: r.n for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(best_two_fit(histogram, spec.capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    @F.pandas_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        sequence, offset = places.of(length.to_numpy(), number.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    numbered = stored.join(bases, ["part", "length"]).withColumn("place", place("length", F.col("base") + F.col("nth")))
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "ids", "place.*")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids, starts): the ids of every sequence, and the offsets at
    which its pieces start. A sequence is bounded by its capacity."""
    joined = F.aggregate("found", F.lit(b""), lambda all_, one: F.concat(all_, one["ids"]))
    ordered = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return (
        packed.groupBy("sequence_id")
        .agg(ordered.alias("found"), F.sum("length").alias("length"))
        .select("sequence_id", "length", joined.alias("ids"), F.col("found.offset").alias("starts"))
    )
