"""Removal of repeated byte strings by distributed, sparse prefix doubling.

A byte goes if some 50-byte string over it also starts in a document with a smaller id.
Sorting every position of the corpus at every offset is not needed for that:

1. Whole copies. Texts are grouped by digest; all but the one with the smallest id go.
2. Ranks at 25 bytes, on anchors. In every run of 26 consecutive positions the one whose
   25-byte rank (a hash) is smallest is an anchor, so each 50-byte string has one and
   equal strings have the same. Spark brings equal ranks together in packed blocks;
   anchors whose rank is unique to one document drop out.
3. Ranks at 75 bytes. The rank triple at q - 25, q and q + 25 stands for all 50-byte
   strings around an anchor q. Spark groups equal triples; an anchor whose triple
   occurs in a smaller document is past the threshold: all 75 bytes go.
4. Ranks at 38 bytes. Where anchors of one rank have different surroundings (the edges
   of a repeat, or a few common words), the 38 bytes from an anchor on and those up to
   its end are rank pairs at offset 13; every 50 bytes around the anchor hold the one or
   the other. Sides that no other document has drop out.
5. Ranks at 50 bytes. For the sides left, the pairs of ranks at p and p + 25 of the
   positions p around them are grouped; a pair that a smaller document has marks its
   50 bytes.

What is left of one position is 96 bits of rank and its place, packed in blocks by the
spread of its rank. Equal ranks are compared inside an Arrow batch first and only those of
its smallest document go on, so a frequent string brings one document a batch together.
Everything between the rounds is written to the shared folder and removed, with the shuffle
files it came from, once the next round has been written.

Cases: a null text counts as empty; a text below 50 bytes keeps all bytes; rows that
repeat an id never remove each other's bytes; a null id counts as the largest; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.common import blobs, bound_batches, materialize
from sievemark.session import new_scratch_path, owned_scratch, result_of, shuffles_removed, small_text_batches

HALF = 25
LENGTH = 2 * HALF
SHIFT = 13  # half of HALF: strings that start more than 12 before an anchor hold its left side
BLOCK_BYTES = 32 << 20  # of text for one bucket of packed ranks
MOST_BUCKETS = 200  # unless the texts ask for more: what is packed gets small
LAST_ID = 2**63 - 1
RANK_BITS = np.uint64(24)  # low bits dropped from the ranks of the first round
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (wrapping arithmetic)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * FACTOR)


def powers(*exponents: int) -> dict[int, np.uint64]:
    return {e: np.uint64(pow(int(FACTOR), e, 2**64)) for e in exponents}


POWER = powers(1, 2, 4, 8)


def ranks(data: bytes) -> np.ndarray:
    """Rank of the 25 bytes from every position on, by doubling: 2, 4, 8, 16, 24, 25."""
    one = BYTE_VALUES[np.frombuffer(data, np.uint8)]
    if len(one) < HALF:
        return one[:0]
    two = one[:-1] * POWER[1] + one[1:]
    four = two[:-2] * POWER[2] + two[2:]
    eight = four[:-4] * POWER[4] + four[4:]
    sixteen = eight[:-8] * POWER[8] + eight[8:]
    most = sixteen[:-8] * POWER[8] + eight[16:]
    return mixed(most[:-1] * POWER[1] + one[24:])


def sliding(values: np.ndarray, pick: np.ufunc) -> np.ndarray:
    """Smallest or largest of every 26 neighbours."""
    for step in (1, 2, 4, 8, 10):
        values = pick(values[:-step], values[step:])
    return values


def anchors(rank: np.ndarray) -> np.ndarray:
    """Positions that are smallest in some run of 26."""
    if len(rank) <= HALF:
        return np.empty(0, np.int64)
    least = sliding(rank, np.minimum)
    padded = np.concatenate([np.zeros(HALF, np.uint64), least, np.zeros(HALF, np.uint64)])
    return np.flatnonzero(sliding(padded, np.maximum) == rank)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin in sorted arrays, and their end."""
    new = np.ones(len(keys[0]) + 1, bool)
    if len(keys[0]):
        new[1:-1] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new) if len(keys[0]) else np.zeros(1, np.int64)


def packed_ranks(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, known, ranks, owners, refs): the distinct shortened anchor ranks of each
    document of a batch, dealt by rank; owners number the refs. Of a rank that documents of
    a batch share, one entry goes on to meet the others and all are ``known`` to share it."""
    ends = np.arange(1, buckets, dtype=np.uint64) * np.uint64(2**64 // buckets)

    def pack(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if not batch.num_rows:
                continue
            refs = batch.column("ref").to_numpy()
            found, owner = [], []
            for k, text in enumerate(blobs(batch.column("text"))):
                rank = ranks(text or b"")
                some = np.unique(rank[anchors(rank)] >> RANK_BITS)
                found.append(some)
                owner.append(np.full(len(some), k, np.int32))
            all_ranks, owners = np.concatenate(found), np.concatenate(owner)
            # Anchors have the smallest ranks of their neighbourhood; spread evenly, buckets
            # get equal shares.
            spread = mixed(all_ranks)
            order = np.argsort(spread, kind="stable")
            spread, all_ranks, owners = spread[order], all_ranks[order], owners[order]
            starts = runs(spread)
            sizes = np.diff(starts)
            several = np.repeat(sizes > 1, sizes)
            rows = []
            for known, of in ((True, np.flatnonzero(several)), (False, starts[:-1])):
                rank, number = all_ranks[of], owners[of]
                cuts = np.concatenate([[0], np.searchsorted(spread[of], ends), [len(rank)]])
                for b in np.flatnonzero(np.diff(cuts)):
                    part = slice(cuts[b], cuts[b + 1])
                    present, numbers = np.unique(number[part], return_inverse=True)
                    wide = rank[part].astype("<u8").view(np.uint8).reshape(-1, 8)
                    rows.append(
                        (int(b), known, wide[:, :5].tobytes(), numbers.astype("<u4").tobytes(), refs[present].tobytes())
                    )
            names = ("bucket", "known", "ranks", "owners", "refs")
            kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names)
            )

    return docs.mapInArrow(pack, "bucket int, known boolean, ranks binary, owners binary, refs binary")


FOUND_TYPE = "part int, refs binary, sizes binary, found binary"


def by_part(ref: np.ndarray, values: np.ndarray, parts: int) -> pa.Table:
    """(part, refs, sizes, found): values packed by document, documents dealt by ref."""
    part = (ref.view(np.uint64) % np.uint64(parts)).astype(np.int32)
    order = np.lexsort((ref, part))
    part, ref, values = part[order], ref[order], values[order]
    cuts, starts = runs(part), runs(ref, part)
    rows = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        inside = starts[np.searchsorted(starts, a) : np.searchsorted(starts, b) + 1]
        rows.append(
            (int(part[a]), ref[inside[:-1]].tobytes(), np.diff(inside).astype("<u4").tobytes(), values[a:b].tobytes())
        )
    columns = list(zip(*rows, strict=True)) or [()] * 4
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    names = ("part", "refs", "sizes", "found")
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})


def by_document(found: DataFrame, dtype: str) -> DataFrame:
    """(ref, found): all packed values of a document in one row."""

    def gather(table: pa.Table) -> pa.Table:
        refs, sizes, values = (
            np.frombuffer(b"".join(table.column(n).to_pylist()), kind)
            for n, kind in (("refs", np.int64), ("sizes", "<u4"), ("found", dtype))
        )
        ref = np.repeat(refs, sizes)
        order = np.argsort(ref, kind="stable")
        ref, values = ref[order], values[order]
        starts = runs(ref)
        pieces = [values[a:b].tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        return pa.table({"ref": pa.array(ref[starts[:-1]], pa.int64()), "found": pa.array(pieces, pa.binary())})

    return found.groupBy("part").applyInArrow(gather, "ref bigint, found binary")


def shared_ranks(docs: DataFrame, buckets: int) -> DataFrame:
    """(ref, found): packed shortened ranks that a document shares with another one."""

    def share(table: pa.Table) -> pa.Table:
        parts, owners, sure = [], [], []
        for known, packed, numbers, refs in zip(
            *(table.column(n).to_pylist() for n in ("known", "ranks", "owners", "refs")), strict=True
        ):
            wide = np.zeros((len(packed) // 5, 8), np.uint8)
            wide[:, :5] = np.frombuffer(packed, np.uint8).reshape(-1, 5)
            parts.append(wide.reshape(-1).view("<u8"))
            owners.append(np.frombuffer(refs, np.int64)[np.frombuffer(numbers, "<u4")])
            sure.append(np.full(len(wide), known))
        rank, ref, sure = np.concatenate(parts), np.concatenate(owners), np.concatenate(sure)
        open_rank, open_ref = rank[~sure], ref[~sure]
        order = np.argsort(open_rank, kind="stable")
        open_rank, open_ref = open_rank[order], open_ref[order]
        sizes = np.diff(runs(open_rank))
        shared = np.repeat(sizes > 1, sizes)
        rank, ref = np.concatenate([rank[sure], open_rank[shared]]), np.concatenate([ref[sure], open_ref[shared]])
        return by_part(ref, rank, buckets)

    packed = packed_ranks(docs, buckets)
    return by_document(packed.groupBy("bucket").applyInArrow(share, FOUND_TYPE), "<u8")


Keys = tuple[np.ndarray, np.ndarray, np.ndarray]  # two halves of a folded rank, a value for it


def folded(*of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks folded into 64 and 32 bits; two that differ in one rank differ in the former."""
    one, two = of[0], of[0]
    for k, rank in enumerate(of[1:]):
        one, two = one + rank * np.uint64(2 * k + 3), (two * FACTOR) ^ mixed(rank + FACTOR)
    return mixed(one), (mixed(two) >> np.uint64(32)).astype(np.uint32)


def met(
    rows: DataFrame, columns: list[str], keys: Callable[..., Keys], buckets: int, *, others: bool
) -> DataFrame:
    """(ref, found): what meets equal keys in other documents, packed unsigned 32-bit values.

    ``keys`` makes them of the text and the ``columns`` of a row. With ``others`` the values
    whose key another document has are returned; else all of them, doubled, plus 1 where a
    smaller document has the key. Keys are compared inside a batch first. Of each key the
    entries of one document (with ``others`` up to two) go on, so what comes together for a
    frequent key grows with the number of batches, not of documents.
    """
    kinds = (pa.int32(), pa.bool_(), *[pa.binary()] * 6)
    names = ("bucket", "known", "ones", "twos", "found", "sizes", "refs", "docs")

    def ends(one: np.ndarray, two: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order by key; in it the smallest and the largest document of every entry's key."""
        order = np.lexsort((two, one))
        starts = runs(one[order], two[order])
        sizes, doc = np.diff(starts), doc[order]
        low, high = (np.repeat(pick.reduceat(doc, starts[:-1]), sizes) for pick in (np.minimum, np.maximum))
        return order, low, high

    def pack(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if not batch.num_rows:
                continue
            refs, docs = batch.column("ref").to_numpy(), batch.column("doc").to_numpy()
            given = (batch.column(n).to_pylist() for n in columns)
            made = [keys(*row) for row in zip(blobs(batch.column("text")), *given, strict=True)]
            owner = np.repeat(np.arange(len(made)), [len(m[0]) for m in made])
            one, two, value = (np.concatenate(c) for c in zip(*made, strict=True))
            order, low, high = ends(one, two, docs[owner])
            one, two, value, owner = one[order], two[order], value[order], owner[order]
            doc = docs[owner]
            if others:
                known, sent = low < high, (low == high) | (doc == low) | (doc == high)
            else:
                known, sent = doc > low, doc == low
                value = 2 * value + known.astype(np.uint32)
            rows = []
            if known.any():  # nothing is left to be found out
                some = np.flatnonzero(known)
                some = some[np.argsort(owner[some], kind="stable")]
                cuts = runs(owner[some])
                present = owner[some][cuts[:-1]]
                rows.append(
                    (int(refs[present[0]] % buckets), True, b"", b"", value[some].tobytes(),
                     np.diff(cuts).astype("<u4").tobytes(), refs[present].tobytes(), b"")
                )
            bucket = ((one[sent] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            some = np.flatnonzero(sent)[np.lexsort((value[sent], owner[sent], bucket))]
            one, two, value, owner, bucket = one[some], two[some], value[some], owner[some], np.sort(bucket)
            cuts = runs(bucket)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                inside = runs(owner[a:b])
                present = owner[a:b][inside[:-1]]
                rows.append(
                    (int(bucket[a]), False, one[a:b].tobytes(), two[a:b].tobytes(), value[a:b].tobytes(),
                     np.diff(inside).astype("<u4").tobytes(), refs[present].tobytes(), docs[present].tobytes())
                )
            made_of = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(made_of, kinds, strict=True)], names=list(names)
            )

    def meet(table: pa.Table) -> pa.Table:
        def read(rows: pa.Table, name: str, kind: str) -> np.ndarray:
            return np.frombuffer(b"".join(rows.column(name).to_pylist()), kind)

        sure, rest = (table.filter(c) for c in (table.column("known"), pc.invert(table.column("known"))))
        sizes = read(rest, "sizes", "<u4")
        doc, ref = (np.repeat(read(rest, n, "<i8"), sizes) for n in ("docs", "refs"))
        order, low, high = ends(read(rest, "ones", "<u8"), read(rest, "twos", "<u4"), doc)
        doc, ref, value = doc[order], ref[order], read(rest, "found", "<u4")[order]
        if others:
            ref, value = ref[low < high], value[low < high]
        else:
            value = value + (doc > low).astype(np.uint32)
        ref = np.concatenate([np.repeat(read(sure, "refs", "<i8"), read(sure, "sizes", "<u4")), ref])
        return by_part(ref, np.concatenate([read(sure, "found", "<u4"), value]), buckets)

    schema = ", ".join(f"{n} {k}" for n, k in zip(names, ("int", "boolean", *["binary"] * 6), strict=True))
    packed = rows.select("ref", "doc", "text", *columns).mapInArrow(pack, schema)
    return by_document(packed.groupBy("bucket").applyInArrow(meet, FOUND_TYPE), "<u4")


def side(rank: np.ndarray, at: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Ranks at the positions ``at`` where a whole one fits; else of what there is."""
    inside = (at >= 0) & (at < size)
    return np.where(inside, rank[np.clip(at, 0, size - 1)], start)


def cut_off(data: bytes, size: int) -> np.uint64:
    """A stand-in rank for fewer than 25 bytes at an end of a text."""
    head = hashlib.blake2b(data, digest_size=8, salt=size.to_bytes(2, "little")).digest()
    return np.frombuffer(head, "<u8")[0]


def surroundings(text: bytes, shared: bytes) -> Keys:
    """Of the shared anchors the rank triple and their place."""
    rank = ranks(text)
    place = anchors(rank)
    place = place[np.isin(rank[place] >> RANK_BITS, np.frombuffer(shared, "<u8"))]
    here, size = rank[place], len(rank)
    # At an end of the text the bytes that are left make up the rank.
    left, right = np.zeros(len(place), np.uint64), np.zeros(len(place), np.uint64)
    for k in np.flatnonzero(place < HALF).tolist():
        left[k] = cut_off(text[: place[k]], int(place[k]))
    for k in np.flatnonzero(len(text) - place - HALF < HALF).tolist():
        n = len(text) - int(place[k]) - HALF
        right[k] = cut_off(text[len(text) - n :], HALF + n)
    left = side(rank, place - HALF, left, size)
    right = side(rank, place + HALF, right, size)
    return *folded(here, left, right), place.astype(np.uint32)


def sides(text: bytes, found: bytes) -> Keys:
    """Of the anchors that no smaller document has with their surroundings, the rank pairs
    of the 38 bytes up to their end and from them on. The value is twice the place, plus 1
    for those up to the end."""
    rank, found = ranks(text), np.frombuffer(found, "<u4")
    q = (found[found % 2 == 0] // 2).astype(np.int64)
    before, behind = q[q >= SHIFT], q[q + SHIFT < len(rank)]
    lefts = folded(rank[before - SHIFT], rank[before], np.ones(len(before), np.uint64))
    rights = folded(rank[behind], rank[behind + SHIFT], np.zeros(len(behind), np.uint64))
    value = np.concatenate([2 * before + 1, 2 * behind]).astype(np.uint32)
    return np.concatenate([lefts[0], rights[0]]), np.concatenate([lefts[1], rights[1]]), value


def windows(text: bytes, found: bytes) -> Keys:
    """The rank pairs of all positions whose 50 bytes hold one of the given sides, and the
    positions."""
    rank, found = ranks(text), np.unique(np.frombuffer(found, "<u4")).astype(np.int64)
    before, behind = found[found % 2 == 1] // 2, found[found % 2 == 0] // 2
    marks = np.zeros(len(text) + 1, np.int64)
    np.add.at(marks, np.maximum(np.concatenate([before - HALF, behind - SHIFT + 1]), 0), 1)
    np.subtract.at(marks, np.concatenate([before - SHIFT + 1, behind + 1]), 1)
    p = np.flatnonzero(np.cumsum(marks))
    p = p[p <= len(text) - LENGTH]
    return *folded(rank[p], rank[p + HALF]), p.astype(np.uint32)


REDUCED_TYPE = "ref bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string"


def reduced(texts: DataFrame) -> DataFrame:
    """(ref, n_removed, n_spans, kept, kept_sha256) of texts with the packed values ``wide``
    (of anchors whose 75 bytes go) and ``near`` (of starts of 50 bytes that go): odd ones."""

    def going(found: bytes | None) -> np.ndarray:
        values = np.frombuffer(found or b"", "<u4")
        return (values[values % 2 == 1] // 2).astype(np.int64)

    def apply(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = []
            found = zip(
                batch.column("ref").to_pylist(), blobs(batch.column("text")),
                batch.column("wide").to_pylist(), batch.column("near").to_pylist(), strict=True,
            )
            for ref, text, wide, near in found:
                q, p = going(wide), going(near)
                marks = np.zeros(len(text) + 1, np.int64)
                np.add.at(marks, np.concatenate([np.maximum(q - HALF, 0), p]), 1)
                np.subtract.at(marks, np.concatenate([np.minimum(q + LENGTH, len(text)), p + LENGTH]), 1)
                gone = np.cumsum(marks[:-1]) > 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                rows.append((ref, int(gone.sum()), spans, kept, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["ref", "n_removed", "n_spans", "kept", "kept_sha256"],
            )

    return texts.mapInArrow(apply, REDUCED_TYPE)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; ``kept`` is
    null where nothing was removed."""
    with shuffles_removed(docs.sparkSession), small_text_batches(docs.sparkSession):
        return _remove_repeats(docs, id_col, text_col)


def _remove_repeats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    payload = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    source = bound_batches(docs).select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc"),
        payload.alias("text"),
        F.sha2(payload, 256).alias("sha"),
    ).withColumn("ref", F.xxhash64("doc", "sha"))
    rows = materialize(
        source.select("doc_id", "doc", "ref", "sha", F.octet_length("text").cast("long").alias("n_bytes")),
        "repeat-rows",
    )
    large = F.col("n_bytes") >= LENGTH
    firsts = rows.where(large).groupBy("sha").agg(F.min("doc").alias("first"))
    rows = materialize(
        rows.where(large).join(firsts, "sha").withColumn("copy", F.col("doc") > F.col("first")).drop("first")
        .unionByName(rows.where(~large).withColumn("copy", F.lit(False))),
        "repeat-classes",
    )
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(min(parts, MOST_BUCKETS), total // BLOCK_BYTES)
    done = new_scratch_path(spark, "repeat-reduced")

    # Round 1: ranks at 25 bytes.
    some = source.where(F.octet_length("text") >= LENGTH)

    def sharing() -> DataFrame:
        shared = materialize(shared_ranks(some.select("ref", "text"), buckets), "repeat-shared")
        wanted = rows.where(~F.col("copy")).select("ref").distinct().join(shared, "ref")
        return some.select("ref", "doc", "text").join(wanted, "ref").dropDuplicates(["ref"])

    def with_found(found: DataFrame) -> DataFrame:
        return texts.select("ref", "doc", "text").join(found, "ref")

    def reducing() -> DataFrame:
        marks = around.withColumnRenamed("found", "wide").join(near.withColumnRenamed("found", "near"), "ref", "left")
        return reduced(texts.select("ref", "text").join(marks, "ref"))

    with owned_scratch(spark, "repeat-rounds"):
        texts = result_of(spark, sharing, "repeat-texts")
        # Round 2: ranks at 75 bytes.
        around = result_of(
            spark, lambda: met(texts, ["found"], surroundings, buckets, others=False), "repeat-around"
        )
        # Round 3: ranks at 38 bytes, where a document is the first with the surroundings.
        open_sides = result_of(
            spark, lambda: met(with_found(around), ["found"], sides, buckets, others=True), "repeat-open"
        )
        # Round 4: ranks at 50 bytes.
        near = result_of(
            spark, lambda: met(with_found(open_sides), ["found"], windows, buckets, others=False), "repeat-near"
        )
        reducing().write.parquet(done)
    cut = spark.read.schema(REDUCED_TYPE).parquet(done)
    nothing = hashlib.sha256(b"").hexdigest()
    none = F.lit(0).cast("long")
    copies = rows.where("copy").select(
        "doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
        F.lit(nothing).alias("kept_sha256"), F.lit(b"").alias("kept"),
    )
    others = rows.where("NOT copy").join(cut, "ref", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"),
        F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "kept",
    )
    return copies.unionByName(others)
