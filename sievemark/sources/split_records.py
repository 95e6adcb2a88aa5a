"""Records of large text files, read by many tasks, numbered in file order.

A CSV cell may hold line breaks, and a JSON array has no lines at all, so Spark's own
readers give each such file to one task. Here a file is read as short chunks up to a
separator (a line end; a closing brace), which Spark's text source deals out by byte
ranges. Whether a chunk ends a record depends on all that stands before it in the file:
whether a quoted text is open there, and how many braces.

1. Every split is summarised for both cases, starting inside a quoted text or not: what
   the state is behind it, and how many records end in it. No text is shuffled.
2. The summaries, one row per split, are put together in file order on the driver, which
   has planned the very same splits. This gives each split its state at the start and the
   number of records before it.
3. With its state known, every split yields its records and their numbers. A record that
   goes over the end of a split comes in parts, which are joined by record number.

The result does not depend on where the splits lie, and its numbers are stable: files in
the order of their paths, records in the order of the file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.session import materialize

ESCAPED = re.compile(r"\\.", re.DOTALL)
MIN_SPLITS = "spark.sql.files.minPartitionNum"
RECORDS_AT_ONCE = 2048


@dataclass(frozen=True)
class CsvLines:
    """Lines; one ends a record unless a quoted cell is open behind it. Quotes stand
    around whole cells and are doubled inside, as in RFC 4180."""

    separator: str = "\n"
    ends_with_separator: bool = False
    has_trailer: bool = False

    def marks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(whether quotes are odd, change of depth started outside and inside quotes)."""
        odd = pc.count_substring(chunks, '"').to_numpy(zero_copy_only=False) & 1
        return odd.astype(np.int64), np.zeros((2, len(odd)), np.int64)


@dataclass(frozen=True)
class PlainLines(CsvLines):
    """Lines, each of them a record, whatever quotes it holds."""

    def marks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(len(chunks), np.int64), np.zeros((2, len(chunks)), np.int64)


@dataclass(frozen=True)
class ArrayObjects:
    """Chunks up to a closing brace; one ends an object of the file's one JSON array if no
    text and no other brace is open behind it. Behind the last brace is the end of the
    array."""

    separator: str = "}"
    ends_with_separator: bool = True
    has_trailer: bool = True

    def marks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd, depth = np.zeros(len(chunks), np.int64), np.zeros((2, len(chunks)), np.int64)
        for i, chunk in enumerate(chunks.to_pylist()):
            texts = (ESCAPED.sub("", chunk) if "\\" in chunk else chunk).split('"')
            odd[i] = (len(texts) - 1) & 1
            # Braces count outside of quotes: in every second part. So does the one that
            # the chunk was cut at.
            depth[0, i] = sum(t.count("{") for t in texts[0::2]) - (odd[i] == 0)
            depth[1, i] = sum(t.count("{") for t in texts[1::2]) - (odd[i] == 1)
        return odd, depth


Cutter = CsvLines | ArrayObjects


@dataclass
class State:
    """Whether a text is open, and how many braces."""

    quoted: int = 0
    depth: int = 0

    def over(self, odd: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(quoted, depth) behind every chunk; the state moves behind the last one."""
        behind = (self.quoted + np.cumsum(odd)) & 1
        before = np.concatenate([[self.quoted], behind[:-1]])
        deep = self.depth + np.cumsum(depth[before, np.arange(len(odd))])
        if len(odd):
            self.quoted, self.depth = int(behind[-1]), int(deep[-1])
        return behind, deep


class Summary:
    """State and ended records of a split for one state at its start. The depth there is
    not known: records end where the depth is lowest, if that is none at all."""

    def __init__(self, quoted: int) -> None:
        self.state = State(quoted)
        self.lowest, self.times = 1 << 60, 0

    def add(self, odd: np.ndarray, depth: np.ndarray) -> None:
        quoted, deep = self.state.over(odd, depth)
        ends = deep[quoted == 0]
        if len(ends):
            low = int(ends.min())
            times = int((ends == low).sum())
            if low < self.lowest:
                self.lowest, self.times = low, times
            elif low == self.lowest:
                self.times += times

    def numbers(self) -> list[int]:
        return [self.state.quoted, self.state.depth, self.lowest, self.times]


SUMMARY_TYPE = "file string, at bigint, whole array<bigint>, short array<bigint>"
RECORD_TYPE = "file string, record bigint, at bigint, text string, complete boolean"


def by_split(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The parts of a batch that belong to one split each, in their order."""
    names = batch.column("file").dictionary_encode()
    number, at = names.indices.to_numpy(zero_copy_only=False), batch.column("at").to_numpy()
    edges = np.flatnonzero((np.diff(number) != 0) | (np.diff(at) != 0)) + 1
    for low, high in zip([0, *edges], [*edges, batch.num_rows], strict=True):
        if high > low:
            part = batch.slice(low, high - low)
            yield (names.dictionary[int(number[low])].as_py(), int(at[low])), part


def summaries(chunks: DataFrame, cutter: Cutter) -> DataFrame:
    """One row per split; ``short`` leaves out its last chunk."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, found, short = None, [], []

        def done() -> pa.RecordBatch:
            whole = [n for s in found for n in s.numbers()]
            return pa.RecordBatch.from_pylist(
                [{"file": split[0], "at": split[1], "whole": whole, "short": short}],
                schema=pa.schema(
                    [("file", pa.string()), ("at", pa.int64())]
                    + [(n, pa.list_(pa.int64())) for n in ("whole", "short")]
                ),
            )

        for batch in source:
            for key, part in by_split(batch):
                if key != split:
                    if split:
                        yield done()
                    split, found = key, [Summary(0), Summary(1)]
                odd, depth = cutter.marks(part.column("text"))
                for s in found:
                    s.add(odd[:-1], depth[:, :-1])
                short = [n for s in found for n in s.numbers()]
                for s in found:
                    s.add(odd[-1:], depth[:, -1:])
        if split:
            yield done()

    return chunks.mapInArrow(batches, SUMMARY_TYPE)


def starts(rows: list, cutter: Cutter, header: bool) -> list[tuple]:
    """(file, at, quoted, depth, first, base, last) of every split, from its summary:
    the state at its start, records before it in the file, rows before the file, and
    whether the file ends with it."""
    found, base = [], 0
    rows = sorted(rows, key=lambda r: (r.file, r.at))
    for i, row in enumerate(rows):
        if i == 0 or rows[i - 1].file != row.file:
            quoted = depth = first = 0
        last = i + 1 == len(rows) or rows[i + 1].file != row.file
        numbers = row.short if last and cutter.has_trailer else row.whole
        after, change, lowest, times = numbers[4 * quoted : 4 * quoted + 4]
        found.append((row.file, row.at, quoted, depth, first, base, last))
        first += times if depth + lowest == 0 else 0
        quoted, depth = after, depth + change
        if last:  # what is still open there is a record as well
            base += first + (quoted != 0 or depth != 0) - header
    return found


STARTS_TYPE = "file string, at bigint, quoted int, depth bigint, first bigint, base bigint, last boolean"


def cut_records(chunks: DataFrame, cutter: Cutter) -> DataFrame:
    """(file, record, at, text, complete) from chunks that know the state of their split."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, state, number, last = None, State(), 0, False
        held: list[str] = []  # the chunks of the record that is not at its end yet
        clean = True  # whether that record began in this split
        rows: list[tuple] = []

        def finished() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*rows, strict=True)]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["file", "record", "at", "text", "complete"],
            )

        def leave() -> None:
            if last and cutter.has_trailer and held:
                held.pop()
            if held:
                text = cutter.separator.join(held)
                rows.append((split[0], number, split[1], text, clean and last))

        for batch in source:
            for key, part in by_split(batch):
                if key != split:
                    if split:
                        leave()
                    split, held = key, []
                    quoted, depth, number, last = (
                        part.column(c)[0].as_py() for c in ("quoted", "depth", "first", "last")
                    )
                    state = State(quoted, depth)
                    clean = not quoted and not depth
                quoted, deep = state.over(*cutter.marks(part.column("text")))
                ends = (quoted == 0) & (deep == 0)
                for chunk, end in zip(part.column("text").to_pylist(), ends.tolist(), strict=True):
                    held.append(chunk)
                    if end:
                        rows.append((*split[:1], number, split[1], cutter.separator.join(held), clean))
                        number, held, clean = number + 1, [], True
                        if len(rows) >= RECORDS_AT_ONCE:
                            yield finished()
        if split:
            leave()
        if rows:
            yield finished()

    return chunks.mapInArrow(batches, RECORD_TYPE)


@contextmanager
def same_splits(spark: SparkSession) -> Iterator[None]:
    """The splits of a file depend on the number of cores, which may change on a cluster;
    inside the block they do not."""
    if spark.conf.get(MIN_SPLITS, None) is not None:
        yield
        return
    spark.conf.set(MIN_SPLITS, str(max(1, spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.unset(MIN_SPLITS)


def split_records(spark: SparkSession, path: str, cutter: Cutter, header: bool = False) -> DataFrame:
    """(file, place, text) of every record of the files at ``path``, stored.

    ``place`` numbers the records of all files from 0 in file order. With ``header`` the
    first record of each file is left out. Empty lines are left out as well but keep
    their numbers. The file is read twice; a file that changes in between, or a compressed
    one that cannot be split, is no special case but for an error and a single task.
    """
    chunks = (
        spark.read.option("lineSep", cutter.separator)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("at"),
            F.col("value").alias("text"),
        )
    )
    with same_splits(spark):
        found = starts(summaries(chunks, cutter).collect(), cutter, header)
        # One row per split, as many as the driver has planned.
        at_start = F.broadcast(spark.createDataFrame(found, STARTS_TYPE))
        known = chunks.join(at_start, ["file", "at"], "left").withColumn(
            "first", F.coalesce("first", F.raise_error(F.lit("the files have changed while being read")).cast("long"))
        )
        stored = materialize(cut_records(known.drop("base"), cutter), "records")
    whole = stored.where("complete").select("file", "record", "text")
    parts = F.array_sort(F.collect_list(F.struct("at", "text")))
    joined = (
        stored.where("NOT complete")
        .groupBy("file", "record")
        .agg(F.array_join(F.transform(parts, lambda p: p["text"]), cutter.separator).alias("text"))
    )
    bases = spark.createDataFrame(
        sorted({(file, base) for file, _, _, _, _, base, _ in found}), "file string, base bigint"
    )
    text = F.concat("text", F.lit(cutter.separator)) if cutter.ends_with_separator else F.col("text")
    # One row per file of the split table: it is as bounded as that one.
    return (
        whole.unionByName(joined)
        .where((F.col("record") >= int(header)) & ~F.col("text").isin("", "\r"))
        .join(F.broadcast(bases), "file")
        .select("file", (F.col("base") + F.col("record") - int(header)).alias("place"), text.alias("text"))
    )
