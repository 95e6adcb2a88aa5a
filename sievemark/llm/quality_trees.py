"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed in Arrow batches on the executors. The trees are
fitted on a sample of labelled rows that is bounded by a parameter (the rows whose ids
have the smallest hashes): every feature is cut into quantile bins, each level of a tree
comes from histograms of gradients and hessians. The finished trees are flattened into
arrays, one row per tree in heap order, and a batch of documents walks all trees at once.

Cases: a null text counts as empty and has a score; a label that is null is no label; of
several labels of an id the smallest counts; without labelled rows every score is 0.5;
with labels of one kind the score is close to that label; repeated rows get equal scores;
a null id is never held out; an empty table gives an empty result; only the columns
named are read, so clashing names of others do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.llm.common import blobs

FEATURES = (
    "log_bytes", "log_words", "mean_word", "std_word", "longest_word", "distinct_words",
    "top_word", "repeated_neighbour", "distinct_pairs", "upper", "digits", "symbols",
    "exclaims", "commas", "stops", "pipes", "punctuation", "high_bytes", "controls",
    "spaces", "log_lines", "mean_line", "distinct_lines", "unended_lines", "deflated",
    "byte_entropy", "short_words", "title_words", "marked_words",
)
MARK_AT_END = re.compile(rb"[^\w.,;:?\x80-\xff]$")


@dataclass(frozen=True)
class BoostSpec:
    """Bound of the labelled rows fitted on, and the shape of the model."""

    most_rows: int = 20_000
    trees: int = 80
    depth: int = 4
    bins: int = 48
    rate: float = 0.15
    ridge: float = 1.0
    least_weight: float = 2.0


def byte_class(chars: bytes) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[list(chars)] = True
    return mask


UPPER = byte_class(bytes(range(65, 91)))
DIGITS = byte_class(b"0123456789")
SYMBOLS = byte_class(b"#*$%&|<>{}[]=+~^\\/@_")
PUNCTUATION = byte_class(bytes(b for b in range(33, 127) if not chr(b).isalnum()))
SPACES = byte_class(b" \t\n\r\x0b\x0c")


def statistics(data: bytes) -> list[float]:
    """The features of one text, in the order of ``FEATURES``."""
    size = len(data)
    words = data.split()
    if not words:
        return [np.log1p(size)] + [0.0] * (len(FEATURES) - 1)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.float64, len(words))
    distinct = dict.fromkeys(words)
    numbers = dict(zip(distinct, range(len(distinct)), strict=True))
    codes = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    n = len(words)
    pairs = codes[:-1] * len(distinct) + codes[1:]
    lines = [x for x in data.split(b"\n") if x.strip()]
    ended = sum(x.rstrip()[-1:] in b".?!:;" for x in lines)
    share = counts[counts > 0] / size
    times = np.bincount(codes)  # of every distinct word, in the order of ``distinct``
    title = np.fromiter(map(bytes.istitle, distinct), bool, len(distinct))
    marked = np.fromiter((MARK_AT_END.search(w) is not None for w in distinct), bool, len(distinct))
    return [
        np.log1p(size),
        np.log1p(n),
        lengths.mean(),
        lengths.std(),
        lengths.max(),
        len(distinct) / n,
        times.max() / n,
        float((codes[1:] == codes[:-1]).mean()) if n > 1 else 0.0,
        len(np.unique(pairs)) / (n - 1) if n > 1 else 1.0,
        counts[UPPER].sum() / size,
        counts[DIGITS].sum() / size,
        counts[SYMBOLS].sum() / size,
        counts[ord("!")] / size,
        counts[ord(",")] / size,
        counts[ord(".")] / size,
        counts[ord("|")] / size,
        counts[PUNCTUATION].sum() / size,
        counts[128:].sum() / size,
        (counts[:32].sum() - counts[9:14].sum()) / size,
        counts[SPACES].sum() / size,
        np.log1p(len(lines)),
        size / len(lines),
        len(set(lines)) / len(lines),
        1 - ended / len(lines),
        len(zlib.compress(data, 1)) / size,
        float(-(share * np.log2(share)).sum()),
        float((lengths <= 2).mean()),
        times[title].sum() / n,
        times[marked].sum() / n,
    ]


def features_of(texts: pa.Array) -> np.ndarray:
    rows = [statistics(t or b"") for t in blobs(texts)]
    return np.array(rows, np.float64).reshape(len(rows), len(FEATURES))


@dataclass(frozen=True)
class FlatTrees:
    """Trees in heap order: node k has the children 2k + 1 and 2k + 2. ``feature`` and
    ``limit`` have a row per tree; a row of ``leaf`` holds the values of its leaves."""

    base: float
    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every row of features; all trees step together."""
        raw = np.full(len(x), self.base)
        if len(self.feature):
            tree = np.arange(len(self.feature))
            row = np.arange(len(x))[:, None]
            node = np.zeros((len(x), len(tree)), np.int64)
            while node.size and node.flat[0] < self.feature.shape[1]:
                right = x[row, self.feature[tree, node]] > self.limit[tree, node]
                node = 2 * node + 1 + right
            raw = raw + self.leaf[tree, node - self.feature.shape[1]].sum(axis=1)
        return 1 / (1 + np.exp(-raw))


def best_splits(
    binned: np.ndarray, node: np.ndarray, nodes: int, g: np.ndarray, h: np.ndarray, spec: BoostSpec
) -> tuple[np.ndarray, np.ndarray]:
    """Feature and bin of the best split of each of ``nodes`` nodes; a node that no split
    improves sends everything left (the last bin)."""
    gains = np.zeros(nodes)
    feature, cut = np.zeros(nodes, np.int64), np.full(nodes, spec.bins - 1, np.int64)
    for f in range(binned.shape[1]):
        cell = node * spec.bins + binned[:, f]
        shape = (nodes, spec.bins)
        sum_g = np.bincount(cell, g, nodes * spec.bins).reshape(shape).cumsum(axis=1)
        sum_h = np.bincount(cell, h, nodes * spec.bins).reshape(shape).cumsum(axis=1)
        all_g, all_h = sum_g[:, -1:], sum_h[:, -1:]
        rest_g, rest_h = all_g - sum_g, all_h - sum_h
        gain = (
            sum_g**2 / (sum_h + spec.ridge)
            + rest_g**2 / (rest_h + spec.ridge)
            - all_g**2 / (all_h + spec.ridge)
        )
        gain[(sum_h < spec.least_weight) | (rest_h < spec.least_weight)] = 0
        at = gain.argmax(axis=1)
        top = gain[np.arange(nodes), at]
        better = top > gains + 1e-9
        gains[better], feature[better], cut[better] = top[better], f, at[better]
    return feature, cut


def fit(x: np.ndarray, y: np.ndarray, spec: BoostSpec = BoostSpec()) -> FlatTrees:
    """Boosted trees for the probability of ``y == 1``."""
    inner, leaves = 2**spec.depth - 1, 2**spec.depth
    empty = FlatTrees(0.0, np.empty((0, inner), np.int64), np.empty((0, inner)), np.empty((0, leaves)))
    if not len(y):
        return empty
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return FlatTrees(base, empty.feature, empty.limit, empty.leaf)
    levels = np.linspace(0, 1, spec.bins + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, f], levels)) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    raw = np.full(len(y), base)
    features, limits, values = [], [], []
    for _ in range(spec.trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(spec.depth):
            first, width = 2**level - 1, 2**level
            chosen, cut = best_splits(binned, node, width, g, h, spec)
            feature[first : first + width] = chosen
            limit[first : first + width] = [
                edges[f][c] if c < len(edges[f]) else np.inf for f, c in zip(chosen, cut, strict=True)
            ]
            node = 2 * node + (binned[np.arange(len(y)), chosen[node]] > cut[node])
        sum_g, sum_h = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        value = -spec.rate * sum_g / (sum_h + spec.ridge)
        raw += value[node]
        features.append(feature)
        limits.append(limit)
        values.append(value)
    return FlatTrees(base, np.array(features), np.array(limits), np.array(values))


def held_out(id_col: str, parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id as text leaves ``part`` on division by ``parts``."""
    mod = F.crc32(F.col(id_col).cast("string").cast("binary")) % parts
    return F.coalesce(mod == part, F.lit(False))


def training_rows(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, spec: BoostSpec
) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``spec.most_rows`` labelled rows."""
    order = F.xxhash64("id")
    chosen = (
        labels.where(~held_out(id_col) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label_col).cast("double").alias("label"))
        .orderBy(order, "id")
        .limit(spec.most_rows)
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(chosen), "id")  # bounded by the limit

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features_of(batch.column("text"))
            kinds = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(list(x), kinds)],
                names=["id", "label", "x"],
            )

    kind = dict(rows.dtypes)["id"]
    found = rows.select("id", "label", "text").mapInArrow(measure, f"id {kind}, label double, x array<double>")
    kept = found.orderBy(order, "id", "x").limit(spec.most_rows).collect()
    x = np.array([r.x for r in kept], np.float64).reshape(len(kept), len(FEATURES))
    return x, np.array([r.label for r in kept], np.float64)


def quality_score(text: Column, model: FlatTrees) -> Column:
    """Probability of label 1 of every whole text."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(features_of(texts)), pa.float64())

    return score.asNondeterministic()(text)  # so that no filter repeats it


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.7,
    spec: BoostSpec = BoostSpec(),
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, by trees fitted on the rows
    that are not held out."""
    model = fit(*training_rows(docs, labels, id_col, text_col, label_col, spec), spec)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        held_out(id_col).alias("held_out"),
        quality_score(F.col(text_col), model).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
