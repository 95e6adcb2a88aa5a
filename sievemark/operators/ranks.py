"""Exact order statistics that never bring a whole group into one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer,
and a ranking window sorts a whole group in one task. Both are fine up to about a
million rows. Beyond that the functions here close in on the wanted rank with
bucket counts (combined on the map side, bounded output) until the bracket holds
few rows, and only those are sorted. The result is exact in every case.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemark.session import materialize, small_or_materialized

SINGLE_TASK_ROWS = 1_000_000
BUCKETS = 4096
SKETCH_ACCURACY = 10_000


def join_groups(
    rows: DataFrame, groups: DataFrame, by: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Attach per-group columns; null group keys match each other.

    Without group columns ``groups`` is a handful of rows and travels as literals.
    """
    if not by:
        literal = groups.agg(F.collect_list(F.struct(*groups.columns))).scalar()
        return rows.select("*", F.explode(literal).alias("__g")).select(*rows.columns, "__g.*")
    renamed = groups.select(
        *[F.col(n).alias(f"__g_{n}") for n in by],
        *[c for c in groups.columns if c not in by],
    )
    condition = F.lit(True)
    for name in by:
        condition = condition & rows[name].eqNullSafe(renamed[f"__g_{name}"])
    return rows.join(renamed, condition, how).drop(*[f"__g_{n}" for n in by])


def _bucket(value: Column, low: Column, high: Column) -> Column:
    """0 below the bracket, 1..BUCKETS inside (both ends included), BUCKETS+1 above."""
    share = F.try_divide((value - low).cast("double"), (high - low).cast("double"))
    inside = F.coalesce(F.floor(share * BUCKETS).cast("int") + 1, F.lit(BUCKETS))
    return (
        F.when(value < low, 0)
        .when(value > high, BUCKETS + 1)
        .otherwise(F.least(F.lit(BUCKETS), inside))
    )


def _close_in(
    rows: DataFrame, targets: DataFrame, by: Sequence[str], limit: int, max_rounds: int = 12
) -> DataFrame:
    """Shrink each target's bracket until it holds at most ``limit`` rows.

    ``targets`` has (by..., target, rank, low, high): the 0-based rank sought and a
    guess for its value range. Returns (by..., target, rank, low, high, below): the
    wanted row lies among the rows of [low, high], ``below`` rows lie under ``low``.
    """
    keys = [*by, "target"]
    running = Window.partitionBy(*keys).orderBy("bucket")
    for _ in range(max_rounds):
        counts = (
            join_groups(rows, targets, by)
            .withColumn("bucket", _bucket(F.col("value"), F.col("low"), F.col("high")))
            .groupBy(*keys, "rank", "bucket")
            .agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        )
        # At most BUCKETS + 2 rows per target, so this window stays small.
        found = (
            counts.withColumn("below", F.sum("n").over(running) - F.col("n"))
            .where(
                (F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("n"))
            )
            .drop("bucket")
        )
        targets = small_or_materialized(found, "rank-brackets")
        wide = (F.col("n") > limit) & (F.col("low") < F.col("high"))
        if targets.where(wide).isEmpty():
            break
    return targets.drop("n")


def _values_at(rows: DataFrame, targets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Exact value at each target's rank: (by..., target, value)."""
    keys = [*by, "target"]
    running = Window.partitionBy(*keys).orderBy("value")
    return (
        join_groups(rows, targets, by)
        .where(F.col("value").between(F.col("low"), F.col("high")))
        .groupBy(*keys, "rank", "below", "value")
        .agg(F.count("*").alias("n"))
        .withColumn("end", F.col("below") + F.sum("n").over(running))
        .where((F.col("rank") < F.col("end")) & (F.col("rank") >= F.col("end") - F.col("n")))
        .select(*keys, "value")
    )


def exact_percentile(
    df: DataFrame,
    value: str,
    q: float,
    by: Sequence[str] = (),
    out: str = "percentile",
    single_task_rows: int = SINGLE_TASK_ROWS,
) -> DataFrame:
    """Percentile with linear interpolation per group: (by..., out).

    Nulls and NaN are ignored. Counts the groups first (one job); only when one is larger
    than ``single_task_rows`` does the bucketed route run. Give it a stored table:
    the input is read once per step.
    """
    rows = df.select(*by, F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("value")).where(
        F.col("value").isNotNull()
    )
    eps = 2.0 / SKETCH_ACCURACY
    bracket = F.percentile_approx("value", [max(0.0, q - eps), min(1.0, q + eps)], SKETCH_ACCURACY)
    if largest_group(rows, by) <= single_task_rows:
        return rows.groupBy(*by).agg(F.percentile("value", q).alias(out))

    position = (F.col("n") - 1) * q
    groups = small_or_materialized(
        rows.groupBy(*by).agg(F.count("*").alias("n"), bracket.alias("bracket")), "rank-groups"
    )
    targets = groups.select(
        *by,
        F.posexplode(
            F.array(F.floor(position).cast("bigint"), F.ceil(position).cast("bigint"))
        ).alias("target", "rank"),
        F.col("bracket")[0].alias("low"),
        F.col("bracket")[1].alias("high"),
    )
    found = _values_at(rows, _close_in(rows, targets, by, single_task_rows), by)
    pair = found.groupBy(*by).agg(
        F.max(F.when(F.col("target") == 0, F.col("value"))).alias("lower"),
        F.max(F.when(F.col("target") == 1, F.col("value"))).alias("upper"),
    )
    # Same order of operations as the built-in, so both routes agree to the last bit.
    above, below = F.ceil(position) - position, position - F.floor(position)
    between = above * F.col("lower") + below * F.col("upper")
    exact = F.when(F.col("lower") == F.col("upper"), F.col("lower")).otherwise(
        F.when(below == 0, F.col("lower")).otherwise(between)
    )
    return join_groups(pair, groups.select(*by, "n"), by).select(*by, exact.alias(out))


def largest_group(df: DataFrame, by: Sequence[str] = ()) -> int:
    """Rows of the largest group; a one-row result whatever the table size."""
    return df.groupBy(*by).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]


# A plain top-k sends n rows of every input partition to one task; above this n the
# table is counted first to see whether that is affordable.
TOP_K_ROWS = 1_000


def take_smallest(
    df: DataFrame,
    n: int,
    order: str | Column,
    unique: str,
    top_k_rows: int = TOP_K_ROWS,
    single_task_rows: int = SINGLE_TASK_ROWS,
) -> DataFrame:
    """The ``n`` rows with the smallest ``order`` value, ties broken by ``unique``.

    Only the narrow ordering columns are ranked; the cut-off then filters the table,
    so wide rows (texts) are never shuffled. Small ``n`` and small tables use Spark's
    top-k for the cut-off, larger ones a range-partitioned sort. Any orderable type will
    do, nulls come last. If ``unique`` repeats, any of the equal rows at the cut-off
    fill up to exactly ``n``.
    """
    if n <= 0:
        raise ValueError("n must be positive")
    order_col = F.col(order) if isinstance(order, str) else order
    key = F.struct(
        order_col.isNull().alias("no_value"),
        order_col.alias("value"),
        F.col(unique).isNull().alias("no_tie"),
        F.col(unique).alias("tie"),
    )
    narrow = df.select(key.alias("key"))
    left = n
    if n > top_k_rows:
        total = narrow.count()
        if total <= n:
            return df
        if total > single_task_rows:
            narrow, left = _partition_of(narrow, n)
    # The last key taken and how many rows that have it are taken.
    top = narrow.orderBy("key").limit(left).groupBy("key").agg(F.count("*").alias("n"))
    last = top.orderBy(F.desc("key")).limit(1).collect()
    if not last:
        return df
    cut, taken = last[0]["key"], last[0]["n"]
    kind = narrow.schema["key"].dataType
    literal = F.struct(
        *[F.lit(cut[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields]
    )
    # Said once more for the plain column, this can be pushed to the scan.
    near = order_col <= F.lit(cut["value"]) if cut["value"] is not None else F.lit(True)
    if df.where(near & (key == literal)).count() <= taken:
        return df.where(near & (key <= literal))
    return df.where(near & (key < literal)).union(df.where(near & (key == literal)).limit(taken))


def _in_ranges(df: DataFrame, *order: str) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """``df`` range-partitioned and stored, with its partition number in ``__part``;
    and (partition, rows before it, rows), one entry per partition."""
    parts = materialize(
        df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges"
    )
    counts = parts.groupBy("__part").count().orderBy("__part").collect()
    before, listed = 0, []
    for part, rows in counts:
        listed.append((part, before, rows))
        before += rows
    return parts, listed


def _partition_of(narrow: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The partition of the sorted keys that holds the n-th, and its place in there."""
    parts, listed = _in_ranges(narrow, "key")
    part, before, _ = next(x for x in listed if x[1] + x[2] >= n)
    return parts.where(F.col("__part") == part).select("key"), n - before


def number_rows(df: DataFrame, order: str, out: str, start: int = 1) -> DataFrame:
    """Consecutive row numbers in the order of a unique column of any orderable type.

    The table is range-partitioned; row number = rows of earlier partitions + place in
    the partition. One small row per partition passes the driver, whatever the size.
    """
    parts, listed = _in_ranges(df, order)
    offsets = df.sparkSession.createDataFrame(
        [x[:2] for x in listed], "__part int, __before bigint"
    )
    inside = Window.partitionBy("__part").orderBy(order)
    return (
        parts.join(F.broadcast(offsets), "__part")  # one row per partition
        .withColumn(out, F.col("__before") + F.row_number().over(inside) + (start - 1))
        .drop("__part", "__before")
    )
