"""Replace the phrases of a table of any size: the phrases travel to the texts by shuffle.

Texts are dealt into groups by their hash. One pass looks for places where a phrase may
lie and lists per group the hashes of these phrases, each once, however often it occurs.
They are joined with the table, and what the join finds goes in front of the texts of
its group, where it is compared byte by byte. Everything works on UTF-8, in which the
longest of several phrases at one place is the same as in characters.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemark.session import bound_text_batches

# Groups of texts. A phrase is listed once per group, so no phrase is a hot key of the join.
GROUPS = 1 << 14
# A group of more texts than this, and than four times the usual, is dealt out in shares.
SHARE = 64
# Binary digits of a slot in the filter: 64 slots a phrase, 8 KB to 64 MB. Beyond that it lets
# more places pass, which the join then drops.
LEAST_DIGITS, MOST_DIGITS = 16, 29
# Places of a text that are looked at together, and pairs listed before repeated ones go.
PLACES = 1 << 16
PAIRS = 1 << 20

GROUP, SHARES, PHRASE, TARGET, HASH = "__group", "__shares", "__phrase", "__target", "__hash"


# --- hashes -------------------------------------------------------------------


def _mixed(numbers: np.ndarray) -> np.ndarray:
    numbers = (numbers ^ (numbers >> 30)) * 0xBF58476D1CE4E5B9
    numbers = (numbers ^ (numbers >> 27)) * 0x94D049BB133111EB
    return numbers ^ (numbers >> 31)


_SEEDS = _mixed(np.arange(1, 321, dtype=np.uint64) * 0x9E3779B97F4A7C15)
BYTES, FACTORS = _SEEDS[:256], _SEEDS[256:] | 1


def _blocks(data: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(width, hashes of the ``width`` bytes from each place on): widths 1, 2, 4 ... up to
    ``longest``, each made of the one before."""
    hashes, width = BYTES[data], 1
    while len(hashes):
        yield width, hashes
        if 2 * width > longest:
            return
        hashes = hashes[:-width] * FACTORS[width.bit_length()] + hashes[width:]
        width *= 2


def _whole(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of phrases by their first and last block, which cover them together."""
    return _mixed(hashes[first] * FACTORS[0] + hashes[last] + sizes)


def _width(size: int) -> int:
    """The largest block that a phrase of ``size`` bytes has."""
    return 1 << (size.bit_length() - 1)


def _hashes(phrases: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the first blocks, of the whole phrases)."""
    sizes = np.fromiter(map(len, phrases), np.int64, len(phrases))
    starts = np.cumsum(sizes) - sizes
    widths = np.fromiter((_width(len(p)) for p in phrases), np.int64, len(phrases))
    heads, wholes = np.zeros(len(phrases), np.uint64), np.zeros(len(phrases), np.uint64)
    data = np.frombuffer(b"".join(phrases), np.uint8)
    for width, hashes in _blocks(data, int(sizes.max(initial=0))):
        here = np.flatnonzero(widths == width)
        first, size = starts[here], sizes[here]
        heads[here] = hashes[first]
        wholes[here] = _whole(hashes, first, first + size - width, size.astype(np.uint64))
    return heads, wholes


# --- the filter: a bit for every first block and every phrase ------------------


def _digits(phrases: int) -> int:
    return min(MOST_DIGITS, max(LEAST_DIGITS, (64 * phrases).bit_length()))


def _marked(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slots = hashes >> np.uint64(64 - (64 * len(words) - 1).bit_length())
    return ((words[(slots >> 6).view(np.int64)] >> (slots & 63)) & 1).view(np.int64) != 0


def _filter(phrases: Sequence[bytes]) -> np.ndarray:
    digits = _digits(len(phrases))
    words = np.zeros(1 << (digits - 6), np.uint64)
    slots = np.concatenate(_hashes(phrases)) >> np.uint64(64 - digits)
    np.bitwise_or.at(words, (slots >> 6).view(np.int64), np.uint64(1) << (slots & 63))
    return words


@F.pandas_udf(T.StructType().add("head", T.LongType()).add("whole", T.LongType()))
def _phrase_hashes(phrases: pd.Series) -> pd.DataFrame:
    heads, wholes = _hashes(list(phrases))
    return pd.DataFrame({"head": heads.view(np.int64), "whole": wholes.view(np.int64)})


def _filter_of_table(hashed: DataFrame, phrases: int) -> np.ndarray:
    """The same from the table: summed up by the executors, at most 8 million words come."""
    digits = _digits(phrases)
    slots = hashed.select(F.explode(F.array("head", HASH)).alias("hash")).select(
        F.shiftrightunsigned("hash", 64 - digits).alias("slot")
    )
    word = F.shiftright("slot", 6).alias("word")
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    marks = slots.groupBy(word).agg(F.bit_or(bit).alias("bits")).toArrow()
    words = np.zeros(1 << (digits - 6), np.uint64)
    words[marks["word"].to_numpy()] = marks["bits"].to_numpy().view(np.uint64)
    return words


# --- texts ----------------------------------------------------------------------


def _found(
    texts: Sequence[bytes | None], sizes: Sequence[int], words: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, places, sizes, hashes) of what may be a phrase, for one stretch of the joined
    texts after the other. None is missed; a few are none."""
    lengths = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    sizes = [s for s in sizes if s <= lengths.max(initial=0)]
    if not sizes:
        return
    ends, longest = np.cumsum(lengths), max(sizes)
    data = np.frombuffer(b"".join(t for t in texts if t), np.uint8)
    step = max(PLACES, 2 * longest)
    by_width: dict[int, list[int]] = {}
    for size in sizes:
        by_width.setdefault(_width(size), []).append(size)
    for start in range(0, len(data), step):
        piece = data[start : start + step + longest - 1]
        hits = []
        for width, hashes in _blocks(piece, longest):
            if width not in by_width:
                continue
            heads = np.flatnonzero(_marked(words, hashes[:step]))
            for size in by_width[width] if len(heads) else ():
                at = heads[: np.searchsorted(heads, len(piece) - size, side="right")]
                whole = _whole(hashes, at, at + (size - width), np.uint64(size))
                likely = _marked(words, whole)
                at, whole = at[likely] + start, whole[likely]
                row = np.searchsorted(ends, at, side="right")
                inside = at + size <= ends[row]
                at = at[inside]
                hits.append((row[inside], at, np.full(len(at), size), whole[inside]))
        if hits:
            yield tuple(map(np.concatenate, zip(*hits)))


def _once(groups: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, groups))
    groups, hashes = groups[order], hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = (groups[1:] != groups[:-1]) | (hashes[1:] != hashes[:-1])
    return groups[new], hashes[new]


def _replaced(texts: Sequence[bytes | None], known: dict[bytes, bytes]) -> list[bytes | None]:
    """Left to right, the longest phrase first; what no phrase touches stays as it is."""
    out = list(texts)
    if not known:
        return out
    ends = np.cumsum([len(t) if t else 0 for t in texts]).tolist()
    data = b"".join(t for t in texts if t)
    now, parts, copied = -1, [], 0  # copied: the place up to which all is done
    for rows, places, sizes, _ in _found(texts, sorted({*map(len, known)}), _filter(list(known))):
        order = np.lexsort((-sizes, places))
        for row, at, size in zip(rows[order].tolist(), places[order].tolist(), sizes[order].tolist()):
            if at < copied or (target := known.get(data[at : at + size])) is None:
                continue
            if row != now:
                if parts:
                    out[now] = b"".join(parts) + data[copied : ends[now]]
                now, parts, copied = row, [], ends[row] - len(texts[row])
            parts += [data[copied:at], target]
            copied = at + size
    if parts:
        out[now] = b"".join(parts) + data[copied : ends[now]]
    return out


@F.pandas_udf(T.BinaryType())
def _replaced_by_group(
    batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]],
) -> Iterator[pd.Series]:
    """Rows come by groups, a group's phrases before its texts. The phrases of the last group
    are kept for its texts in the next batch."""
    last, kept = None, {}
    for groups, phrases, targets, texts in batches:
        given = phrases.notna()
        if groups.iloc[0] != last:
            kept = {}
        known = {**kept, **dict(zip(phrases[given], targets[given]))}
        yield pd.Series(_replaced(list(texts), known), dtype="object")
        if groups.iloc[-1] != last:
            last, kept = groups.iloc[-1], {}
        given &= groups == last
        kept.update(zip(phrases[given], targets[given]))


# The order of its rows matters to it, so nothing may be moved past it or its sort removed.
_replaced_by_group = _replaced_by_group.asNondeterministic()


def phrases_of_groups(df: DataFrame, col: str, mapping: DataFrame) -> DataFrame:
    """(group, phrase, target) of the phrases in each group of texts, perhaps a few more."""
    binary = [F.col(c).cast("binary").alias(n) for c, n in (("phrase", PHRASE), ("target", TARGET))]
    hashed = mapping.select(*binary).withColumn("both", _phrase_hashes(PHRASE))
    hashed = hashed.select("both.head", F.col("both.whole").alias(HASH), PHRASE, TARGET)
    counts = mapping.groupBy(F.octet_length("phrase").alias("size")).count().collect()
    sizes = sorted(r["size"] for r in counts)
    words = _filter_of_table(hashed, sum(r["count"] for r in counts))
    shared = df.sparkSession.sparkContext.broadcast(words)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def listed(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            group, found = _once(*map(np.concatenate, zip(*parts)))
            return pa.RecordBatch.from_arrays([pa.array(group), pa.array(found.view(np.int64))], [GROUP, HASH])

        for batch in batches:
            groups, parts = batch.column(0).to_numpy(), []
            for rows, _, _, found in _found(batch.column(1).to_pylist(), sizes, shared.value):
                parts.append(_once(groups[rows], found))
                if sum(len(p[0]) for p in parts) > PAIRS:
                    yield listed(parts)
                    parts = []
            if parts:
                yield listed(parts)

    texts = bound_text_batches(df).select(group_of(col), F.col(col).cast("binary"))
    found = texts.mapInArrow(pairs, f"{GROUP} long, {HASH} long").distinct()
    return found.join(hashed.hint("merge"), HASH).select(GROUP, PHRASE, TARGET)


def group_of(col: str) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(GROUPS)).alias(GROUP)


def shares_of_groups(df: DataFrame, col: str) -> DataFrame:
    """(group, shares) of the groups that hold far more texts than others, as they do where a
    text comes very often. Each share gets the phrases of its group."""
    counts = df.where(F.length(col) > 0).groupBy(group_of(col)).count()
    usual = F.avg("count").over(Window.partitionBy(F.lit(0)))  # of a row per group
    shares = F.ceil(F.col("count") / F.greatest(4 * usual, F.lit(SHARE))).alias(SHARES)
    return F.broadcast(counts.select(GROUP, shares).where(F.col(SHARES) > 1))


def replace_phrases(df: DataFrame, col: str, mapping: DataFrame) -> DataFrame:
    """``df``, the phrases of ``mapping`` (phrase, target) replaced in ``col``. The table is
    joined by hash and never collected; texts are shuffled once."""
    spread = shares_of_groups(df, col)
    shares, row = F.coalesce(SHARES, F.lit(1)), F.monotonically_increasing_id()
    # Rows without text look up nothing, so they need not lie together.
    share = F.when(F.length(col) > 0, F.col(GROUP) + F.pmod(row, shares) * GROUPS)
    share = share.otherwise(F.pmod(row, F.lit(GROUPS)))
    nothing = F.lit(None).cast("binary")
    texts = (
        df.withColumn(GROUP, group_of(col))
        .join(spread, GROUP, "left")
        .withColumns({GROUP: share, PHRASE: nothing, TARGET: nothing})
        .drop(SHARES)
    )
    listed = (
        phrases_of_groups(df, col, mapping)
        .join(spread, GROUP, "left")
        .withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)))
        .select((F.col(GROUP) + F.col("share") * GROUPS).alias(GROUP), PHRASE, TARGET)
    )
    both = texts.unionByName(listed, allowMissingColumns=True)
    ordered = both.repartition(GROUP).sortWithinPartitions(GROUP, F.col(PHRASE).isNull())
    replaced = _replaced_by_group(GROUP, PHRASE, TARGET, F.col(col).cast("binary"))
    done = ordered.withColumn(col, replaced.cast("string")).where(F.col(PHRASE).isNull())
    return done.drop(GROUP, PHRASE, TARGET)
