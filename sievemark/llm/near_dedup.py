"""Near-duplicate detection with one-permutation MinHash.

1. Every text becomes the set of its distinct word shingles (64-bit hashes). One
   permutation splits the hash range into bins and keeps the smallest hash of each; an
   empty bin takes the value of a non-empty one drawn by a hash of its own number
   (optimal densification). Groups of bins are hashed into bands.
2. Texts with equal sets form one class, of which one member goes on.
3. Classes that share a band form a bucket. A bucket contributes a star, not all pairs:
   one member, its hub, is compared with every other one, on the full sets. The hub is
   the member that shares most bands with others, so it lies amid its copies.
4. Links make components. Where the spokes of a bucket are still in several, they are
   dealt into blocks of bounded size and blocks are compared with each other, so a large
   bucket is spread over tasks. A block holds members of one large component or of many
   small ones; two blocks of the same component are not compared. A pair is tested in
   the first band it shares, and not if its members have met in one component by then.
   So no link between spokes is lost, no pair is listed, and a bucket gives no more rows
   than it has components.
5. These links join the components of step 4. The number of steps does not depend on the
   data, except for the logarithm of the longest chain of links.

Full sets are compared exactly; the candidate search misses a pair at the threshold with
a probability of (1 - 0.85^6)^40, about 6e-9, if bins were independent. Texts of fewer
shingles than bins have densified bins, which are not; their pairs are missed more often.
Any length of text is taken whole.

Cases: null and wordless texts have the empty set and are linked with nothing; a text of
fewer words than a shingle has its whole word sequence as its only shingle; rows that
repeat an id are judged by their own text and keep that id; a null id has no component
(null) and is kept; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.common import UPPER, blobs, bound_batches, free_name, materialize
from sievemark.llm.components import connected_components

FOLD = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
CACHE_WORDS = 100_000
PAIRS_AT_ONCE = 256
# A block holds so many shingles; a member counts for some even if it is short.
BLOCK_SHINGLES = 1_500_000
MEMBER_SHINGLES = 500
ROWS_AT_ONCE = 256


@dataclass(frozen=True)
class MinHash:
    """Shingle length, link threshold (in percent of the union) and band layout."""

    shingle: int = 3
    percent: int = 85
    bands: int = 40
    rows: int = 6

    @property
    def bins(self) -> int:
        return self.bands * self.rows


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (wrapping arithmetic)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Shingles:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.hashes = WordHashes()
        self.factors = mixed(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)

    def of_words(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.empty(0, np.uint64)
        if len(self.hashes) > CACHE_WORDS:
            self.hashes.clear()
        codes = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(words))
        total = np.full(len(words) - width + 1, width, np.uint64)
        for k in range(width):
            total += codes[k : len(words) - width + 1 + k] * self.factors[k]
        return np.unique(mixed(total))

    def of(self, text: bytes) -> np.ndarray:
        return self.of_words(text.translate(FOLD).split())


class Sketch:
    """Band hashes of a shingle set."""

    def __init__(self, spec: MinHash) -> None:
        self.spec = spec
        bins = np.arange(spec.bins, dtype=np.uint64)
        self.draws = [self.draw(bins, t) for t in range(32)]
        self.factors = mixed(np.arange(7, 7 + spec.rows, dtype=np.uint64)) | np.uint64(1)
        self.salt = mixed(np.arange(1, spec.bands + 1, dtype=np.uint64))

    def draw(self, bins: np.ndarray, attempt: int) -> np.ndarray:
        return (mixed(bins * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt + 1)) % np.uint64(self.spec.bins)).astype(np.int64)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """Smallest hash of every bin, densified; ``hashes`` are sorted and not empty."""
        bins = ((hashes >> np.uint64(32)) * np.uint64(self.spec.bins) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(bins, prepend=-1))
        values = np.zeros(self.spec.bins, np.uint64)
        full = np.zeros(self.spec.bins, bool)
        values[bins[first]] = hashes[first]
        full[bins[first]] = True
        empty = np.flatnonzero(~full)
        attempt = 0
        while len(empty):
            if attempt == len(self.draws):
                self.draws.append(self.draw(np.arange(self.spec.bins, dtype=np.uint64), attempt))
            source = self.draws[attempt][empty]
            hit = full[source]
            values[empty[hit]] = values[source[hit]]
            empty = empty[~hit]
            attempt += 1
        return values

    def bands(self, hashes: np.ndarray) -> np.ndarray:
        grid = self.signature(hashes).reshape(self.spec.bands, self.spec.rows)
        return mixed((grid * self.factors).sum(axis=1, dtype=np.uint64) + self.salt).view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str, spec: MinHash) -> DataFrame:
    """(row, doc_id, text_key, n_shingles, set_key, bands) of every row."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, sketch = Shingles(spec.shingle), Sketch(spec)
        for batch in source:
            counts, keys, bands = [], [], []
            for text in blobs(batch.column("text")):
                hashes = shingles.of(text or b"")
                counts.append(len(hashes))
                keys.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                bands.append(sketch.bands(hashes) if len(hashes) else [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array(counts, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["row", "doc_id", "text_key", "n_shingles", "set_key", "bands"],
            )

    rows = bound_batches(docs).select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(text_col).alias("text_key"),
        F.col(text_col).alias("text"),
    )
    return rows.mapInArrow(
        batches,
        "row bigint, doc_id bigint, text_key bigint, n_shingles bigint, set_key binary, bands array<bigint>",
    )


def needed_texts(docs: DataFrame, id_col: str, text_col: str, classes: DataFrame, spec: MinHash) -> DataFrame:
    """(node, packed): the case-folded words of the classes given, compressed."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, compressor = Shingles(spec.shingle), zstandard.ZstdCompressor(level=3)
        for batch in source:
            nodes, packed = [], []
            keys = batch.column("set_key").to_pylist()
            found = zip(batch.column("node").to_pylist(), keys, blobs(batch.column("text")), strict=True)
            for node, key, text in found:
                words = (text or b"").translate(FOLD).split()
                if xxhash.xxh3_128_digest(shingles.of_words(words).tobytes()) == key:
                    nodes.append(node)
                    packed.append(compressor.compress(b" ".join(words)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(packed, pa.binary())], names=["node", "packed"]
            )

    texts = docs.select(F.col(id_col).cast("long").alias("label"), F.col(text_col).alias("text"))
    found = texts.join(classes.select("label", "set_key", "node"), "label").select("node", "set_key", "text")
    return found.mapInArrow(batches, "node bigint, packed binary").dropDuplicates(["node"])


def measured(pairs: DataFrame, texts: DataFrame, spec: MinHash) -> DataFrame:
    """(a, b, distance, linked): the pairs with the Jaccard distance of their full sets."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, plain = Shingles(spec.shingle), zstandard.ZstdDecompressor()
        last, hub = None, np.empty(0, np.uint64)
        for batch in source:
            distance, linked = [], []
            for first in range(0, batch.num_rows, PAIRS_AT_ONCE):
                part = batch.slice(first, PAIRS_AT_ONCE)
                for one, other in zip(part.column("of_a").to_pylist(), part.column("of_b").to_pylist(), strict=True):
                    if one != last:
                        last, hub = one, shingles.of(plain.decompress(one))
                    spoke = shingles.of(plain.decompress(other))
                    common = len(np.intersect1d(hub, spoke, assume_unique=True))
                    either = len(hub) + len(spoke) - common
                    distance.append(1 - common / either)
                    linked.append(100 * common >= spec.percent * either)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(distance, pa.float64()), pa.array(linked, pa.bool_())],
                names=["a", "b", "distance", "linked"],
            )

    of_a = texts.select(F.col("node").alias("a"), F.col("packed").alias("of_a"))
    of_b = texts.select(F.col("node").alias("b"), F.col("packed").alias("of_b"))
    both = pairs.select("a", "b").join(of_b, "b").join(of_a, "a").select("a", "b", "of_a", "of_b")
    return both.mapInArrow(batches, "a bigint, b bigint, distance double, linked boolean")


def ordered(one: str, n_one: str, other: str, n_other: str, spec: MinHash):
    """Select list and condition of a pair; sets of too different sizes cannot pass."""
    small, large = F.least(n_one, n_other), F.greatest(n_one, n_other)
    near = (F.col(one) != F.col(other)) & (100 * small >= spec.percent * large)
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")], near


def star_links(classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, spec: MinHash) -> tuple[DataFrame, ...]:
    """(members, texts, links): the buckets with their hubs, the words of their members,
    and the links between hubs and members."""
    banded = classes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = materialize(banded.join(sizes, "bucket"), "near-shared")
    weight = shared.groupBy("node").agg(F.sum("size").alias("weight"))
    amid = F.struct("weight", (-F.col("node")).alias("minus"), "n_shingles")
    hubs = (
        shared.join(weight, "node")
        .groupBy("bucket")
        .agg(F.max(amid).alias("hub"))
        .select("bucket", (-F.col("hub.minus")).alias("hub"), F.col("hub.n_shingles").alias("n_hub"))
    )
    members = materialize(shared.drop("size").join(hubs, "bucket"), "near-members")
    pair, near = ordered("hub", "n_hub", "node", "n_shingles", spec)
    pairs = materialize(members.where(near).select(*pair).distinct(), "near-pairs")
    needed = members.select("node").distinct()
    texts = materialize(
        needed_texts(docs, id_col, text_col, classes.join(needed, "node", "left_semi"), spec), "near-texts"
    )
    stars = materialize(measured(pairs, texts, spec), "near-stars")
    return members, texts, stars.where("linked").select("a", "b")


def open_blocks(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, xo, xp, yo, yp, side, node, root): the spokes of buckets that hold several
    components, once for every pair of blocks (owner and part of each) they belong to."""
    placed = (
        members.where("node <> hub")
        .select("bucket", "node", "n_shingles")
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    weight = F.sum(F.col("n_shingles") + MEMBER_SHINGLES).alias("weight")
    groups = placed.groupBy("bucket", "root").agg(weight)
    several = groups.groupBy("bucket").agg(F.count(F.lit(1)).alias("roots")).where("roots > 1").select("bucket")
    # Large components have blocks of their own, owned by their root; the others share.
    owner = F.when(F.col("weight") * 2 > BLOCK_SHINGLES, F.col("root")).otherwise(F.lit(-1))
    owned = materialize(groups.join(several, "bucket").withColumn("owner", owner), "near-groups")
    parts = F.ceil(F.sum("weight") / BLOCK_SHINGLES)
    sizes = materialize(owned.groupBy("bucket", "owner").agg(parts.alias("parts")), "near-blocks")
    blocks = sizes.select("bucket", "owner", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    x = blocks.select("bucket", F.col("owner").alias("xo"), F.col("part").alias("xp"))
    y = blocks.select("bucket", F.col("owner").alias("yo"), F.col("part").alias("yp"))
    one, other = F.struct("xo", "xp"), F.struct("yo", "yp")
    same_root = (F.col("xo") == F.col("yo")) & (F.col("xo") >= 0)
    pairs = x.join(y, "bucket").where((one <= other) & ~same_root)
    sides = pairs.select("*", F.col("xo").alias("owner"), F.col("xp").alias("part"), F.lit(1).alias("side")).union(
        pairs.where(one != other).select("*", F.col("yo").alias("owner"), F.col("yp").alias("part"), F.lit(2).alias("side"))
    )
    dealt = (
        placed.join(owned.select("bucket", "root", "owner"), ["bucket", "root"])
        .join(sizes, ["bucket", "owner"])
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    )
    return dealt.join(sides, ["bucket", "owner", "part"]).select(*BLOCK_KEY, "side", "node", "root")


BLOCK_KEY = ("bucket", "xo", "xp", "yo", "yp")


class BlockPair:
    """Members of two blocks of a bucket, or of one, compared on their full sets."""

    def __init__(self, spec: MinHash) -> None:
        self.spec = spec
        self.shingles, self.plain = Shingles(spec.shingle), zstandard.ZstdDecompressor()

    def candidates(self, bucket: int, rows: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """(x, y): whether a pair may be linked and is to be tested in this bucket."""
        size, root, bands = rows["n_shingles"], rows["root"], rows["bands"]
        band = int(np.flatnonzero(bands[x[0]] == bucket)[0])
        mask = np.empty((len(x), len(y)), bool)
        for first in range(0, len(x), ROWS_AT_ONCE):
            some = x[first : first + ROWS_AT_ONCE, None]
            small, large = np.minimum(size[some], size[y]), np.maximum(size[some], size[y])
            open_ = (root[some] != root[y]) & (100 * small >= self.spec.percent * large)
            for earlier in range(band):
                open_ &= bands[some, earlier] != bands[y, earlier]
            mask[first : first + ROWS_AT_ONCE] = open_
        return np.triu(mask, 1) if x is y else mask

    def links(self, bucket: int, rows: dict[str, np.ndarray], packed: list[bytes]) -> list[tuple[int, int]]:
        """Links between roots that connect all roots that pairs of these members connect."""
        x = np.flatnonzero(rows["side"] == 1)
        y = np.flatnonzero(rows["side"] == 2) if (rows["side"] == 2).any() else x
        if not len(x):
            return []
        mask = self.candidates(bucket, rows, x, y)
        used = np.unique(np.concatenate([x[mask.any(axis=1)], y[mask.any(axis=0)]]))
        if not len(used):
            return []
        sets = {int(i): self.shingles.of(self.plain.decompress(packed[i])) for i in used}
        _, column = np.unique(np.concatenate(list(sets.values())), return_inverse=True)
        ends = np.cumsum([len(s) for s in sets.values()])
        columns = dict(zip(sets, np.split(column, ends[:-1]), strict=True))
        marked = np.zeros(int(column.max()) + 1, np.int32)
        size, label, found = rows["n_shingles"], rows["root"].copy(), []
        for at in np.flatnonzero(mask.any(axis=1)):
            one = int(x[at])
            others = y[mask[at]]
            others = others[label[others] != label[one]]
            if not len(others):
                continue
            marked[columns[one]] = 1
            entries = [columns[int(o)] for o in others]
            starts = np.cumsum([0, *map(len, entries[:-1])])
            common = np.add.reduceat(marked[np.concatenate(entries)], starts).astype(np.int64)
            marked[columns[one]] = 0
            either = size[one] + size[others] - common
            for other in others[100 * common >= self.spec.percent * either]:
                if label[other] != label[one]:
                    found.append((int(label[one]), int(label[other])))
                    label[label == label[other]] = label[one]
        return found


def block_links(blocks: DataFrame, classes: DataFrame, texts: DataFrame, spec: MinHash) -> DataFrame:
    """(a, b): the links between roots that the pairs of blocks show."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, key, held = BlockPair(spec), None, []

        def found() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held)
            rows = {c: whole.column(c).to_numpy() for c in ("side", "root", "n_shingles")}
            flat = pa.concat_arrays([b.column("bands").flatten() for b in held])
            rows["bands"] = flat.to_numpy().reshape(whole.num_rows, spec.bands)
            links = pair.links(key[0], rows, whole.column("packed").to_pylist())
            ends = [pa.array([link[i] for link in links], pa.int64()) for i in (0, 1)]
            return pa.RecordBatch.from_arrays(ends, names=["a", "b"])

        for batch in source:
            keys = np.stack([batch.column(c).to_numpy() for c in BLOCK_KEY], axis=1)
            edges = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
            for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)], strict=True):
                if high > low:
                    if held and key != tuple(keys[low].tolist()):
                        yield found()
                        held = []
                    key = tuple(keys[low].tolist())
                    held.append(batch.slice(low, high - low))
        if held:
            yield found()

    payload = texts.join(classes.select("node", "n_shingles", "bands"), "node")
    rows = blocks.join(payload, "node").select(*BLOCK_KEY, "side", "root", "n_shingles", "bands", "packed")
    # Groups are bounded by two blocks, so a task holds no more than that.
    dealt = rows.repartition(*BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY)
    return dealt.mapInArrow(batches, "a bigint, b bigint")


def linked_roots(classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, spec: MinHash) -> DataFrame:
    """(node, root) of the classes that are linked with another one."""
    members, texts, links = star_links(classes, docs, id_col, text_col, spec)
    roots = connected_components(links)
    blocks = materialize(open_blocks(members, roots), "near-open")
    more = connected_components(block_links(blocks, classes, texts, spec))
    upper = more.select(F.col("node").alias("root"), F.col("root").alias("top"))
    below = roots.join(upper, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    # Roots of a component of one class have not been nodes of a star link.
    single = more.join(roots.select("node"), "node", "left_anti").select("node", "root")
    return below.unionByName(single)


def judged_rows(docs: DataFrame, id_col: str, text_col: str, spec: MinHash) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept) of every row of ``docs``."""
    rows = materialize(sketches(docs, id_col, text_col, spec), "near-sketches")
    classes = materialize(
        rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("set_key")
        .agg(
            F.min("row").alias("node"),
            F.min("doc_id").alias("label"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"),
        ),
        "near-classes",
    )
    roots = linked_roots(classes, docs, id_col, text_col, spec)
    placed = (
        classes.select("set_key", "node", "label")
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    names = placed.groupBy("root").agg(F.min("label").alias("component_id"))
    of_set = placed.join(names, "root").select("set_key", "component_id")
    linked = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").join(of_set, "set_key")
    alone = rows.where("n_shingles = 0 OR doc_id IS NULL").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "text_key", "n_shingles", "component_id"]
    return (
        linked.select(*columns)
        .unionByName(alone.select(*columns))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: MinHash = MinHash()
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    return judged_rows(docs, id_col, text_col, spec).drop("text_key")


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: MinHash = MinHash()
) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id. Rows of
    one id with different texts are judged by their own text."""
    found = judged_rows(docs, id_col, text_col, spec)
    id_, key = free_name(docs, "_gone"), free_name(docs, "_key")
    gone = found.where("NOT kept").select(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).distinct()
    same = (docs[id_col] == gone[id_]) & (F.xxhash64(docs[text_col]) == gone[key])
    return docs.join(gone, same, "left_anti")
