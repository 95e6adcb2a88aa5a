"""Quality rules: compression bands.

Text that zstandard shrinks far more than prose is repetitive, text that it hardly
shrinks is noise. Short texts compress worse than long ones, so every length has its
own pair of limits; fixed chunks are judged as well, because a long clean text hides
a repetitive stretch in its whole-text ratio. Chunks cover every byte of a text of at
least one chunk: where they do not fill it, one more ends at its end and overlaps the
one before.

Cases: a null text counts as empty; an empty text has no words and fails the base
rule; repeated rows get equal verdicts; an empty table gives an empty result; columns
of the input other than the text are never looked at. One text is handled at a time,
so memory follows the longest text of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.llm.common import blobs

# (shortest length in bytes, least ratio, greatest ratio) of compressed to plain size.
# Prose has 0.5-1 below 512 bytes and settles near 0.4; encoded or random bytes stay
# above 0.7 at any length, repeated lines fall below 0.2.
BANDS = (
    (0, 0.0, 9.9),
    (128, 0.40, 1.05),
    (256, 0.38, 0.90),
    (512, 0.34, 0.82),
    (1024, 0.28, 0.75),
    (4096, 0.24, 0.72),
    (16384, 0.20, 0.70),
)
CHUNK = 2048
CHUNK_BAND = (0.22, 0.78)

RESULT = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, base_failed boolean, kept boolean, ratio double, "
    "n_chunks bigint, n_chunks_out bigint"
)
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class BandRules:
    """Limits of the base rule and of the compression bands."""

    bands: tuple[tuple[int, float, float], ...] = BANDS
    chunk_bytes: int = CHUNK
    chunk_band: tuple[float, float] = CHUNK_BAND
    most_chunks_out: float = 0.3
    level: int = 3
    least_words: int = 20
    window: int = 8
    most_repeated_percent: int = 30


def repeated_words(words: list[bytes], width: int) -> int:
    """Words inside some ``width``-word window that occurs twice or more.

    Windows get exact numbers by pairing the numbers of shorter windows; once all
    windows of a length differ, so do all longer ones.
    """
    if len(words) <= width:
        return 0
    distinct_words = dict.fromkeys(words)
    number = dict(zip(distinct_words, range(len(distinct_words)), strict=True))
    labels = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    counts = np.bincount(labels)
    span = 1
    while span < width:
        shift = min(span, width - span)
        pairs = labels[: len(labels) - shift] * (labels.max() + 1) + labels[shift:]
        distinct, labels, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(distinct) == len(pairs):
            return 0
        span += shift
    starts = np.flatnonzero(counts[labels] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    edges[starts] += 1
    np.subtract.at(edges, starts + width, 1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def judge(data: bytes, rules: BandRules, compressor: zstandard.ZstdCompressor) -> tuple:
    """The result columns of one text."""
    text = data.decode("utf-8", "replace")
    words = data.split()  # ASCII white space only, as for str it would be Unicode's
    seen: set[str] = set()
    dup_lines = 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            dup_lines += line in seen
            seen.add(line)
    n_repeat = repeated_words(words, rules.window)
    n_words = len(words)
    failed = n_words < rules.least_words or 100 * n_repeat > rules.most_repeated_percent * n_words
    ratio = len(compressor.compress(data)) / len(data) if data else 0.0
    low, high = next(b[1:] for b in reversed(rules.bands) if len(data) >= b[0])
    size = rules.chunk_bytes
    starts = [*range(0, len(data) - size + 1, size)]
    if starts and len(data) % size:
        starts.append(len(data) - size)  # the rest, as a whole chunk
    shares = [len(compressor.compress(data[i : i + size])) / size for i in starts]
    out = sum(not rules.chunk_band[0] <= x <= rules.chunk_band[1] for x in shares)
    kept = not failed and low <= ratio <= high and out <= rules.most_chunks_out * len(shares)
    return (
        n_words,
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        dup_lines,
        n_repeat,
        failed,
        kept,
        ratio,
        len(shares),
        out,
    )


def band_verdict(text: Column, rules: BandRules = BandRules()) -> Column:
    """Struct column with the counts, the ratios and the verdict of every whole text."""

    @F.arrow_udf(RESULT)
    def verdict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compressor = zstandard.ZstdCompressor(level=rules.level)
        for batch in batches:
            rows = [judge(x or b"", rules, compressor) for x in blobs(batch)]
            columns = list(zip(*rows, strict=True)) or [()] * len(TYPES)
            yield pa.StructArray.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, TYPES.values(), strict=True)],
                names=list(TYPES),
            )

    return verdict.asNondeterministic()(text)  # so that no filter repeats it


TYPES = {
    name: {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[kind]
    for name, kind in (part.split() for part in RESULT.split(", "))
}


def quality_bands(
    docs: DataFrame, text_col: str = "text", rules: BandRules = BandRules(), name: str = "bands"
) -> DataFrame:
    """``docs`` with the struct column ``name`` (an existing one is replaced)."""
    return docs.withColumn(name, band_verdict(F.col(text_col), rules))


def keep_good(docs: DataFrame, text_col: str = "text", rules: BandRules = BandRules()) -> DataFrame:
    """The rows of ``docs`` whose text passes, with unchanged columns."""
    name = "_bands"
    while name in docs.columns:
        name += "_"
    return quality_bands(docs, text_col, rules, name).where(F.col(name).kept).drop(name)
