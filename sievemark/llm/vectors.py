"""Vectors as exact integers: what the two vector operators share.

Components are scaled and floored in the JVM. Workers compute on 64-bit integers where
no square or sum can leave their range and on Python integers elsewhere, so distances and
means are exact at any magnitude. A scaled component or a distance that is no 64-bit
integer is an error, not a wrong number.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG = 2.0**63


def whole(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def floored(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as long integers."""

    def one(x: Column) -> Column:
        scaled = x.cast("double") * F.lit(float(scale))
        far = F.raise_error(F.lit("a scaled vector component is no 64-bit integer"))
        return F.when(F.abs(scaled) < LONG, F.floor(scaled)).otherwise(far.cast("long"))

    return F.transform(vector, one)


def grid(column: pa.Array, rows: int) -> np.ndarray:
    """A column of equally long integer lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def exact(*matrices: np.ndarray) -> list[np.ndarray]:
    """The matrices in a type in which squared distances between their rows are exact,
    with room for a factor of 64."""
    most = max((int(abs(m).max()) if m.size else 0) for m in matrices)
    lowest = min((int(m.min()) if m.size else 0) for m in matrices)
    most = max(most, -lowest)  # the smallest 64-bit integer has no absolute value
    width = max(m.shape[-1] for m in matrices)
    kind = np.int64 if 64 * width * (2 * most) ** 2 < 2**63 else object
    return [m.astype(kind) for m in matrices]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between rows (broadcast), in the type of the rows."""
    gap = a - b
    return (gap * gap).sum(axis=-1)


def least_in_row(rows: np.ndarray, entries: np.ndarray, distance: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry, distance) of the nearest of each row's entries, ties to the lower entry.
    ``rows`` ascend and hold each of 0..n-1, entries ascend within a row."""
    best = np.minimum.reduceat(distance, np.searchsorted(rows, np.arange(n)))
    hits = np.flatnonzero(distance == best[rows])[::-1]
    chosen = np.empty(n, np.int64)
    chosen[rows[hits]] = entries[hits]
    return chosen, best


class Totals:
    """Component sums and counts by group, kept as Python or 64-bit integers."""

    def __init__(self, groups: int, width: int) -> None:
        self.counts = np.zeros(groups, np.int64)
        self.sums = np.zeros((groups, width), object)

    def add(self, group: np.ndarray, rows: np.ndarray) -> None:
        self.counts += np.bincount(group, minlength=len(self.counts))
        if rows.dtype == object:
            np.add.at(self.sums, group, rows)
            return
        for g in np.unique(group):
            self.sums[g] += rows[group == g].sum(axis=0).astype(object)

    def batch(self) -> pa.RecordBatch:
        """(slot, place, n, total) of the groups that have rows; slot is the group."""
        used = np.flatnonzero(self.counts)
        width = self.sums.shape[1]
        totals = [Decimal(int(v)) for v in self.sums[used].ravel()]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(used, width), pa.int64()),
                pa.array(np.tile(np.arange(width), len(used)), pa.int64()),
                pa.array(np.repeat(self.counts[used], width), pa.int64()),
                pa.array(totals, pa.decimal128(38, 0)),
            ],
            names=["slot", "place", "n", "total"],
        )


TOTALS_TYPE = "slot bigint, place bigint, n bigint, total decimal(38,0)"


def means(partial: DataFrame, before: list[list[int]]) -> list[list[int]]:
    """The floored means by slot; a slot without rows keeps what it had. The sums of all
    tasks are added up in Spark; what comes back is one number per slot and place."""
    after = [list(m) for m in before]
    summed = partial.groupBy("slot", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    for r in summed.collect():
        after[r.slot][r.place] = int(r.total) // r.n
    return after
