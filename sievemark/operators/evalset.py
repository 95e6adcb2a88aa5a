"""Build a labelled evaluation set from positive and non-PII texts.

Row order carries no meaning in Spark, so every table has an id. Random choices
use a seeded hash of that id and therefore repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.functions.text import text_hash
from sievemark.operators.ranks import TOP_K_ROWS, take_smallest
from sievemark.session import require_columns

# The safe sentences that replace a text, and the shuffle seed.
SAFE_TEMPLATES = (
    "匿名化文本：這是一段一般流程說明，僅描述系統狀態與服務步驟。",
    "匿名化文本：本段為客服處理紀錄摘要，不含任何個人識別資訊。",
    "匿名化文本：這是產品使用回饋，內容僅有功能與體驗描述。",
    "匿名化文本：此段為營運報表文字，僅含統計結果與一般描述。",
)
SHUFFLE_SEED = 42

# sample_id = 3 * source id + kind, or "source id:kind" for ids that are text; unique
# across the three kinds of row.
KIND_POSITIVE, KIND_NEGATIVE, KIND_REDACTED = 0, 1, 2
WHOLE_NUMBERS = ("tinyint", "smallint", "int", "bigint")


def take_first(df: DataFrame, n: int, order_col: str) -> DataFrame:
    """The n rows with the smallest id."""
    return take_smallest(df, n, order_col, order_col)


def seeded_key(key: str, seed: int) -> Column:
    """60-bit hash of seed and key: a repeatable random order."""
    return text_hash(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 15)


def sample_n(df: DataFrame, n: int, key: str, seed: int = SHUFFLE_SEED) -> DataFrame:
    """A random n rows, or all rows if there are no more than n."""
    return take_smallest(df, n, seeded_key(key, seed), key)


def shuffle(
    df: DataFrame, key: str, seed: int = SHUFFLE_SEED, at_most: int | None = None
) -> DataFrame:
    """Rows in a repeatable random order: a range-partitioned sort, which samples its
    input first. A table known to have few rows (``at_most``) is sorted in one task
    instead, sparing that extra pass."""
    order = [seeded_key(key, seed), F.col(key)]
    if at_most is not None and at_most <= TOP_K_ROWS:
        return df.repartition(1).sortWithinPartitions(*order)
    return df.orderBy(*order)


def label(df: DataFrame, truth: bool, kind: str) -> DataFrame:
    return df.withColumn("ground_truth", F.lit(truth)).withColumn("sample_type", F.lit(kind))


def redact(col: Column) -> Column:
    """One of the fixed safe sentences, chosen by the hash of the text."""
    templates = F.array(*[F.lit(t) for t in SAFE_TEMPLATES])
    choice = F.pmod(text_hash(F.coalesce(col, F.lit(""))), F.lit(len(SAFE_TEMPLATES)))
    return F.element_at(templates, (choice + 1).cast("int"))


def text_ids(id_col: str, *tables: DataFrame | None) -> bool:
    """Whether some table's ids are other than whole numbers."""
    return any(dict(t.dtypes)[id_col] not in WHOLE_NUMBERS for t in tables if t is not None)


def _samples(df: DataFrame, id_col: str, content_col: str, kind: int, textual: bool) -> DataFrame:
    if textual:
        sample_id = F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(kind)))
    else:
        sample_id = F.col(id_col).cast("bigint") * 3 + kind
    return df.select(
        sample_id.alias("sample_id"), F.col(content_col).cast("string").alias("content")
    )


def redacted_samples(
    positives: DataFrame, n: int, id_col: str, content_col: str, textual: bool | None = None
) -> DataFrame:
    """Redacted copies of the first n positives."""
    if textual is None:
        textual = text_ids(id_col, positives)
    copies = take_first(positives, n, id_col).withColumn(content_col, redact(F.col(content_col)))
    return _samples(copies, id_col, content_col, KIND_REDACTED, textual)


def top_up(
    negatives: DataFrame,
    positives: DataFrame,
    n: int,
    id_col: str,
    content_col: str,
    have: int | None = None,
) -> DataFrame:
    """Negatives plus redacted positives up to n rows.

    Still short of n when there are too few positives. ``negatives`` must hold at
    most n rows; ``have`` is their number where it is known, else they are counted.
    """
    needed = n - (negatives.count() if have is None else have)
    textual = text_ids(id_col, negatives, positives)
    result = _samples(negatives, id_col, content_col, KIND_NEGATIVE, textual)
    if needed <= 0:
        return result
    return result.unionByName(redacted_samples(positives, needed, id_col, content_col, textual))


def build_eval_set(
    source: DataFrame,
    n: int,
    include_negative: bool = True,
    non_pii: DataFrame | None = None,
    id_col: str = "sample_id",
    content_col: str = "content",
    seed: int = SHUFFLE_SEED,
) -> DataFrame:
    """First n positives with as many negatives: (sample_id, content, ground_truth, sample_type).

    Negatives come from ``non_pii`` (random n, topped up when short) or, without
    such a table, are redacted copies of the positives. Positives alone keep their
    order; a mixed set is shuffled. Ids may be whole numbers or text.

    Each text table is read twice, once for its ids and once for the chosen texts. A
    table that is costly to compute should be narrow: (id, text) of stored rows.
    """
    if n <= 0:
        raise ValueError("the number of samples must be positive")
    require_columns(source, id_col, content_col)
    first = take_first(source, n, id_col)
    usable = None
    if non_pii is not None and content_col in non_pii.columns:
        require_columns(non_pii, id_col)
        usable = non_pii.na.drop(subset=[content_col])
    textual = text_ids(id_col, source, usable if include_negative else None)
    kept = _samples(first, id_col, content_col, KIND_POSITIVE, textual)
    positives = label(kept, True, "positive")
    if not include_negative:
        return positives.orderBy("sample_id")
    if usable is not None:
        have = usable.limit(n).count()  # stops as soon as n rows are seen
        chosen = sample_n(usable, n, id_col, seed)
        negatives = top_up(chosen, source, n, id_col, content_col, have)
    else:
        negatives = redacted_samples(source, n, id_col, content_col, textual)
    mixed = positives.unionByName(label(negatives, False, "negative"))
    return shuffle(mixed, "sample_id", seed, at_most=2 * n)
