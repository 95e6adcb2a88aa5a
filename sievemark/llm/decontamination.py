"""Benchmark decontamination with DataFrame functions only.

The windows of all benchmark items (``width`` consecutive words; a shorter item is one
window) are hashed into a table whose size is checked: a small one is broadcast as a
hash set, a larger one is joined by shuffle. Every document is read once: its words
become an array, the hashes of its windows are generated from it and probe the set,
and a probe that hits is verified by comparing the words themselves. The word arrays
never leave the scan; only hits and one marker row per document are shuffled.

Cases: a null or wordless text has no words and is clean; a null or wordless item has
no windows; an empty benchmark leaves every document clean; repeated document rows are
judged one by one, repeated item ids count once; a null id is kept as it is. Columns of
the input other than the id and the text are not read, except by ``remove_documents``
and ``remove_spans``, which return them unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.llm.common import fold_case, free_name
from sievemark.session import materialize

WIDTH = 10
# Fixed by the task: what makes up a word once A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# A window costs about 200 bytes in a broadcast hash table: at most some 100 MB.
BROADCAST_WINDOWS = 500_000


def words_of(text: Column, word: str = WORD) -> Column:
    return F.regexp_extract_all(
        fold_case(F.coalesce(text, F.lit(""))), F.lit(word), F.lit(0)
    )


def window_starts(words: Column, length: int) -> Column:
    """1-based starts of the windows of ``length`` words."""
    last = F.size(words) - length + 1
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(
        F.array().cast("array<int>")
    )


def window_text(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def window_hash(words: Column, start: Column, length: int) -> Column:
    """Hash of ``length`` words from ``start`` on. Element by element, since inside a
    lambda a slice would copy the whole array for every window."""
    return F.xxhash64(*[F.get(words, start + (k - 1)) for k in range(length)])


def window_probes(words: Column, length: int) -> Column:
    """A (start, size, hash) struct for every window of ``length`` words."""
    return F.transform(
        window_starts(words, length),
        lambda i: F.struct(
            i.alias("start"), F.lit(length).alias("size"), window_hash(words, i, length).alias("hash")
        ),
    )


def benchmark_windows(items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(item_id, length, phrase): the distinct windows of every item."""
    words = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words"))
    length = F.least(F.lit(width), F.size("words"))
    last = F.size("words") - length + 1
    return (
        words.where(F.size("words") > 0)
        .select("item_id", "words", length.alias("length"), F.explode(F.sequence(F.lit(1), last)).alias("start"))
        .select("item_id", "length", window_text(F.col("words"), F.col("start"), F.col("length")).alias("phrase"))
        .distinct()
    )


def hits(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WIDTH,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """One row per document row: ``doc_id``, ``n_words``, ``covered`` (array of
    [from, to) word ranges that lie in occurrences, merged), ``n_hit``, ``n_items``,
    ``items_sha256``, ``contaminated``, ``text_key`` (hash of the text)."""
    windows = materialize(
        benchmark_windows(items, item_col, item_text_col, width), "benchmark-windows"
    )
    # Windows that the same items share form one class, so that a hit is one row
    # however many items have the window.
    phrases = windows.groupBy("length", "phrase").agg(
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")
    )
    phrases = materialize(
        phrases.withColumn("class", F.sha2(F.to_json("items"), 256)), "benchmark-phrases"
    )
    lengths = [r.length for r in phrases.select("length").distinct().orderBy("length").collect()]
    words_again = F.split("phrase", " ")
    key = F.lit(None).cast("long")
    for n in lengths:
        key = F.when(F.col("length") == n, window_hash(words_again, F.lit(1), n)).otherwise(key)
    keyed = phrases.select(key.alias("key"), "phrase", "class")
    small = keyed.limit(broadcast_windows + 1).count() <= broadcast_windows
    keyed = F.broadcast(keyed) if small else keyed

    words = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text_col).alias("text_key"),
        words_of(F.col(text_col)).alias("words"),
    )
    marker = F.array(
        F.struct(F.lit(1).alias("start"), F.lit(0).alias("size"), F.lit(None).cast("long").alias("hash"))
    )
    probes = [window_probes(F.col("words"), n) for n in lengths]
    scanned = words.select(
        "row", "doc_id", "text_key", "words", F.explode(F.concat(marker, *probes)).alias("w")
    ).select("row", "doc_id", "text_key", "words", "w.*")
    same = window_text(F.col("words"), F.col("start"), F.col("size")) == keyed["phrase"]
    met = (
        scanned.join(
            keyed,
            # Only the hash is a join key; as an argument of coalesce the words are
            # compared for probes that hit, and not built for all the others.
            (scanned["hash"] == keyed["key"]) & F.coalesce(same, F.lit(False)),
            "left",
        )
        .where((F.col("size") == 0) | F.col("class").isNotNull())
        .select(
            "row",
            "doc_id",
            F.when(F.col("size") == 0, F.size("words")).alias("n_words"),
            F.when(F.col("size") == 0, F.col("text_key")).alias("text_key"),
            F.when(F.col("size") > 0, F.struct(F.col("start").alias("from"), (F.col("start") + F.col("size")).alias("to"))).alias("range"),
            "class",
        )
    )
    # All rows of a document come from one task, so nothing but its own hits meets here.
    found = met.groupBy("row", "doc_id").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.max("text_key").alias("text_key"),
        F.collect_set("range").alias("ranges"),
        F.collect_set("class").alias("classes"),
    )
    found = materialize(found.withColumn("covered", merged(F.col("ranges"))).drop("ranges"), "benchmark-hits")
    items_of = (
        found.where(F.size("classes") > 0)
        .select("row", F.explode("classes").alias("class"))
        .join(phrases.select("class", "items").dropDuplicates(["class"]), "class")
        .groupBy("row")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        .select("row", F.size("items").cast("long").alias("n"), F.sha2(F.array_join("items", ","), 256).alias("sha"))
    )
    n_hit = F.aggregate(
        "covered", F.lit(0).cast("long"), lambda total, r: total + (r["to"] - r["from"]).cast("long")
    )
    clean = found.where(F.size("classes") == 0).select(
        "doc_id", "n_words", "covered", F.lit(0).cast("long").alias("n_items"),
        F.sha2(F.lit("").cast("binary"), 256).alias("items_sha256"), "text_key",
    )
    marked = found.join(items_of, "row").select(
        "doc_id", "n_words", "covered", F.col("n").alias("n_items"), F.col("sha").alias("items_sha256"), "text_key"
    )
    return clean.unionByName(marked).select(
        "doc_id", "n_words", "covered", n_hit.alias("n_hit"), "n_items", "items_sha256",
        (F.size("covered") > 0).alias("contaminated"), "text_key",
    )


def merged(ranges: Column) -> Column:
    """Sorted, disjoint [from, to) ranges that cover the same words."""
    empty = F.array().cast("array<struct<from:int,to:int>>")

    def add(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["from"].alias("from"), F.greatest(last["to"], r["to"]).alias("to"))
        touches = (F.size(done) > 0) & (r["from"] <= F.when(F.size(done) > 0, last["to"]))
        return F.when(
            touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))
        ).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(F.array_sort(ranges), empty, add)


def remove_documents(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """``docs`` without the rows whose text is contaminated; rows of one id with other
    texts stay."""
    found = hits(docs, items, id_col=id_col, text_col=text_col, **options)
    id_, key = free_name(docs, "_bad"), free_name(docs, "_key")
    bad = found.where("contaminated").select(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).distinct()
    same = docs[id_col].eqNullSafe(bad[id_]) & (F.xxhash64(docs[text_col]) == bad[key])
    return docs.join(bad, same, "left_anti")


def remove_spans(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """``docs`` with the covered words cut out of the text, each with the separators
    that follow it. Ids must be unique and not null."""
    found = hits(docs, items, id_col=id_col, text_col=text_col, **options)
    id_, cuts_ = free_name(docs, "_id"), free_name(docs, "_cuts")
    cuts = found.where("contaminated").select(F.col("doc_id").alias(id_), F.col("covered").alias(cuts_))
    # A word of the text as it stands may have upper-case letters.
    inside = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    outside = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    text = F.col(text_col)
    head = F.regexp_extract(text, f"^{outside}*", 0)
    parts = F.regexp_extract_all(text, F.lit(f"{inside}+{outside}*"), F.lit(0))
    ends = F.concat(
        F.transform(cuts_, lambda r: F.struct(r["from"].alias("from"), r["to"].alias("to"))),
        F.array(F.struct((F.size(parts) + 1).alias("from"), (F.size(parts) + 1).alias("to"))),
    )
    kept = F.aggregate(
        ends,
        F.struct(head.alias("text"), F.lit(1).alias("next")),
        lambda done, r: F.struct(
            F.concat(
                done["text"], F.array_join(F.slice(parts, done["next"], r["from"] - done["next"]), "")
            ).alias("text"),
            r["to"].alias("next"),
        ),
    )["text"]
    joined = docs.join(cuts, docs[id_col] == cuts[id_], "left")
    return joined.withColumn(
        text_col, F.when(F.col(cuts_).isNotNull(), kept).otherwise(text)
    ).select(*docs.columns)
