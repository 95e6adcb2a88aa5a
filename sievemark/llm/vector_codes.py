"""Vectors as codes: every part of a vector is replaced by the index of a codebook entry.

A vector is cut into equal consecutive parts; each part position has a codebook that is
refined by rounds of assigning and averaging, in exact integers.

1. A part lies in a cell of a coarse grid (components divided by the cell width, rounded
   down). Cells of a slice of rows are hashed and made distinct.
2. For the box of a cell every entry has a smallest and a largest distance. An entry whose
   smallest distance exceeds another's largest is dominated across the box: it is nearest
   to no point of it, nor tied. The entries left are remembered by cell.
3. Only these are measured exactly for the parts in that cell, ties to the lower index.

Tasks return sums and counts by codebook entry, Spark adds them up; no row is shuffled.
Cells are remembered per worker process and codebook, up to ``CELLS``; a cell that was
forgotten is worked out again.

Cases: vectors that are null or hold null or non-finite components are left out, as are
those whose length is no positive multiple of the parts or differs from that of the
smallest id left; with fewer vectors than entries the codebooks are smaller; rows that
repeat an id are vectors of their own (ties of the start go by components), a null id
starts last; a null label is a label of its own; an empty table gives an empty result;
other columns are not read. Scaled components, errors and sums beyond 64 bits are an
error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.common import materialize, process_wide
from sievemark.llm.vectors import TOTALS_TYPE, Totals, exact, floored, grid, least_in_row, means, squared, whole

CELLS = 200_000
ROWS_AT_ONCE = 4096
# A label with more than this share of the rows is hot; there can only be as many.
HOT_SHARE = 1000

Codebook = list[list[int]]


@dataclass(frozen=True)
class Codes:
    """Parts of a vector, entries of a codebook, rounds, scale of the components and
    width of a grid cell in scaled units."""

    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096
    cell: int = 512


def mixed(cells: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every row (wrapping arithmetic)."""
    total = np.full(len(cells), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(cells.shape[1]):
        total = (total ^ cells[:, k].astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        total ^= total >> np.uint64(32)
    return total


def distinct_cells(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the distinct cells, number of each row's cell), by hash; should two cells
    share one, by their coordinates."""
    _, first, inverse = np.unique(mixed(cells), return_index=True, return_inverse=True)
    if not np.array_equal(cells[first][inverse], cells):
        _, first, inverse = np.unique(cells, axis=0, return_index=True, return_inverse=True)
    return first, inverse.ravel()


class CellMemo:
    """Entries not dominated across a cell, remembered by cell; one codebook."""

    def __init__(self, codebook: Codebook, width: int) -> None:
        self.codebook = np.array(codebook, object)
        self.width = width
        self.known: dict[bytes, np.ndarray] = {}
        self.asked = self.missed = self.measured = 0

    def masks(self, cells: np.ndarray) -> np.ndarray:
        """(cell, entry): whether the entry may be nearest to a point of the cell."""
        keys = [row.tobytes() for row in cells]
        new = [i for i, key in enumerate(keys) if key not in self.known]
        self.asked += len(keys)
        self.missed += len(new)
        if len(self.known) + len(new) > CELLS:
            self.known.clear()
            new = list(range(len(keys)))
        if new:
            low, codebook = exact(cells[new].astype(object) * self.width, self.codebook)
            low = low[:, None, :]
            high = low + (self.width - 1)
            below, above = low - codebook, codebook - high
            outside = np.maximum(np.maximum(below, above), 0)
            farthest = np.maximum(abs(below), abs(above))
            least, most = (outside * outside).sum(axis=2), (farthest * farthest).sum(axis=2)
            found = (least <= most.min(axis=1)[:, None]).astype(bool)
            self.known.update(zip((keys[i] for i in new), found, strict=True))
        return np.stack([self.known[key] for key in keys])

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every row, ties to the lower entry."""
        cells = np.ascontiguousarray(points // self.width)
        first, inverse = distinct_cells(cells)
        rows, entries = np.nonzero(self.masks(cells[first])[inverse])
        self.measured += len(rows)
        points, codebook = exact(points, self.codebook)
        return least_in_row(rows, entries, squared(points[rows], codebook[entries]), len(points))


def memos(codebooks: list[Codebook], spec: Codes) -> list[CellMemo]:
    """The memos of these codebooks; a worker process keeps those of its last ones."""
    kept = process_wide(("vector-codes",), dict)
    name = codebook_digest(codebooks), spec.cell
    if kept.get("name") != name:
        kept.update(name=name, memos=[CellMemo(c, spec.cell) for c in codebooks])
    return kept["memos"]


def codebook_digest(codebooks: list[Codebook]) -> str:
    numbers = (str(x) for codebook in codebooks for entry in codebook for x in entry)
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def coded_parts(batch: pa.RecordBatch, found: list[CellMemo], spec: Codes) -> Iterator[tuple]:
    """(rows of the batch, part matrix, entries, distances) by slice and part position."""
    for first in range(0, batch.num_rows, ROWS_AT_ONCE):
        part = batch.slice(first, ROWS_AT_ONCE)
        points = grid(part.column("point"), part.num_rows)
        wide = points.shape[1] // spec.parts
        blocks = [points[:, k * wide : (k + 1) * wide] for k in range(spec.parts)]
        yield part, blocks, [memo.nearest(block) for memo, block in zip(found, blocks, strict=True)]


def totals(stored: DataFrame, codebooks: list[Codebook], spec: Codes) -> DataFrame:
    """Sums and counts by part position and entry; slot is part * entries + entry."""
    entries = len(codebooks[0])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, summed = memos(codebooks, spec), Totals(spec.parts * entries, len(codebooks[0][0]))
        for batch in source:
            for _, blocks, coded in coded_parts(batch, found, spec):
                for k, (block, (entry, _)) in enumerate(zip(blocks, coded, strict=True)):
                    summed.add(k * entries + entry, exact(block)[0])
        yield summed.batch()

    return stored.select("point").mapInArrow(batches, TOTALS_TYPE)


def encoded(stored: DataFrame, codebooks: list[Codebook], spec: Codes) -> DataFrame:
    """(id, label, code, error): indexes of two hex digits in part order, and the squared
    distances of all parts summed."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = memos(codebooks, spec)
        for batch in source:
            for part, _, coded in coded_parts(batch, found, spec):
                indexes = np.stack([entry for entry, _ in coded], axis=1).astype(np.uint8)
                digits = indexes.tobytes().hex()
                wide = 2 * spec.parts
                error = sum(distance.astype(object) for _, distance in coded)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        part.column("label"),
                        pa.array([digits[i : i + wide] for i in range(0, len(digits), wide)], pa.string()),
                        pa.array(error.tolist(), pa.int64()),
                    ],
                    names=["id", "label", "code", "error"],
                )

    kinds = {f.name: f.dataType.simpleString() for f in stored.schema}
    return stored.mapInArrow(batches, f"id {kinds['id']}, label {kinds['label']}, code string, error bigint")


def decoded(codes: DataFrame, codebooks: list[Codebook], code_col: str = "code") -> DataFrame:
    """``codes`` with the column ``point``: the scaled vector that the code stands for."""
    books = F.array(*[F.array(*[F.array(*[F.lit(x).cast("long") for x in e]) for e in b]) for b in codebooks])
    index = lambda k: F.conv(F.substring(F.col(code_col), 2 * k + 1, 2), 16, 10).cast("int")
    parts = [F.get(F.get(books, F.lit(k)), index(k)) for k in range(len(codebooks))]
    return codes.withColumn("point", F.concat(*parts))


def compress_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    spec: Codes = Codes(),
) -> tuple[DataFrame, list[Codebook]]:
    """((id, label, code, error) of every vector, final codebooks). Codebooks are
    ``parts`` x ``entries`` at most; nothing else passes through the driver."""
    if spec.entries > 256:
        raise ValueError("a code has two hex digits per part: 256 entries at most")
    vector = F.col(vector_col)
    good = vectors.where(whole(vector) & (F.size(vector) > 0) & (F.size(vector) % spec.parts == 0))
    points = good.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), floored(vector, spec.scale).alias("point")
    )
    order = [F.asc_nulls_last("id"), F.col("point")]
    head = points.orderBy(*order).limit(1).collect()
    if not head:
        kinds = {f.name: f.dataType.simpleString() for f in points.schema}
        empty = f"id {kinds['id']}, label {kinds['label']}, code string, error bigint"
        return vectors.sparkSession.createDataFrame([], empty), []
    length = len(head[0].point)
    stored = materialize(points.where(F.size("point") == length), "code-points")
    heads = [list(r.point) for r in stored.orderBy(*order).limit(spec.entries).collect()]
    wide = length // spec.parts
    codebooks = [[h[k * wide : (k + 1) * wide] for h in heads] for k in range(spec.parts)]
    for _ in range(spec.rounds):
        flat = means(totals(stored, codebooks, spec), [e for book in codebooks for e in book])
        codebooks = [flat[k * len(heads) : (k + 1) * len(heads)] for k in range(spec.parts)]
    return encoded(stored, codebooks, spec), codebooks


def with_label_error(rows: DataFrame) -> DataFrame:
    """``rows`` (label, error, ...) with the errors summed over equal labels.

    Labels are summed with partial aggregation. Those that hold more than a thousandth of
    the rows, fewer than a thousand whatever the table, are broadcast, so no task gets a
    hot label; all others meet their sums in a shuffle join. Nulls are a label."""
    sums = materialize(
        rows.groupBy("label").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"),
        ),
        "label-errors",
    )
    total = sums.agg(F.sum("n")).first()[0] or 0
    sums = sums.withColumnRenamed("label", "of_label")
    hot = F.broadcast(sums.where(F.col("n") * HOT_SHARE > total).select("of_label", F.col("label_error").alias("hot_error")))
    cold = sums.where(F.col("n") * HOT_SHARE <= total).select("of_label", "label_error")
    same = F.col("label").eqNullSafe(F.col("of_label"))
    first = rows.join(hot, same, "left").drop("of_label")
    done = first.where("hot_error IS NOT NULL").withColumnRenamed("hot_error", "label_error")
    rest = first.where("hot_error IS NULL").drop("hot_error").join(cold, same).drop("of_label")
    return done.unionByName(rest)


def code_report(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    spec: Codes = Codes(),
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector."""
    found, codebooks = compress_vectors(vectors, id_col, vector_col, label_col, spec)
    rows = with_label_error(materialize(found, "codes"))
    return rows.select(
        F.col("id").alias("vec_id"),
        "code",
        "error",
        "label_error",
        F.lit(codebook_digest(codebooks)).alias("codebooks_sha256"),
    )
