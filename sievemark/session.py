"""Session helpers: shared scratch space, materialised tables, checked small tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Upper bound on the rows of a table that may pass through the driver or be
# turned into a literal relation (run dimensions, per-group metrics, ...).
SMALL_TABLE_ROWS = 10_000
SMALL_TABLE_BYTES = 8 << 20

# Arrow batches of whole texts end at this size. A Python worker holds a batch several times
# over, as strings and with what is made of them. Bounds that this library has not set stay.
TEXT_BATCH_BYTES = 4 << 20
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_DEFAULTS = ("67108864b", str(16 << 20))  # Spark's, and that of the training-data operators

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Folders of the owners that are open, innermost last.
_owned: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediates, taken from ``spark.checkpoint.dir``.

    Only a single-process master (``local``, ``local[n]``) may fall back to a folder of
    its own, which goes when the process ends; wherever executors are processes of their
    own they have to see the same path, so an unset folder is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="sievemark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_scratch_path(spark: SparkSession, name: str) -> str:
    parent = _owned[-1] if _owned else scratch_dir(spark)
    return f"{parent.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def owned_scratch(spark: SparkSession, name: str = "run") -> Iterator[str]:
    """A folder for everything written to scratch inside the block, removed at its end.

    Results have to be written elsewhere, or collected, before the block ends.
    """
    folder = new_scratch_path(spark, name)
    _owned.append(folder)
    try:
        yield folder
    finally:
        _owned.remove(folder)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.delete(path, True)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and unlike an RDD checkpoint the
    result still prunes columns and pushes filters.
    """
    path = new_scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def result_of(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, written and read back. Everything else that it has written to
    scratch is removed."""
    path = new_scratch_path(spark, name)
    with owned_scratch(spark, f"{name}-work"):
        df = make()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside the block, the shuffle files of a query go when it has ended. Without that
    they stay until the driver happens to collect garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


@contextmanager
def small_text_batches(spark: SparkSession) -> Iterator[None]:
    """Inside the block, Arrow batches end at ``TEXT_BATCH_BYTES``. For work that ends in it."""
    before = spark.conf.get(BATCH_KEY)
    if before in BATCH_DEFAULTS:
        spark.conf.set(BATCH_KEY, str(TEXT_BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(BATCH_KEY, before)


def small_or_materialized(df: DataFrame, name: str = "small") -> DataFrame:
    """Pin a table expected to be small (a dimension, one row per group, ...).

    Its size is checked first: up to ``SMALL_TABLE_ROWS`` rows and ``SMALL_TABLE_BYTES``
    bytes it becomes a literal table marked for broadcast, so the large side of a join is not shuffled on a
    possibly hot key. A larger table is written out and joined by shuffle; nothing is
    dropped either way.
    """
    rows = df.limit(SMALL_TABLE_ROWS + 1).collect()
    few = len(rows) <= SMALL_TABLE_ROWS
    if few and sum(len(str(tuple(r))) for r in rows) <= SMALL_TABLE_BYTES:
        return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
    return materialize(df, name)


def bound_text_batches(df: DataFrame) -> DataFrame:
    """``df``, its session with small Arrow batches, so that what a Python worker holds does
    not grow with the partitions."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_KEY) in BATCH_DEFAULTS:
        conf.set(BATCH_KEY, str(TEXT_BATCH_BYTES))
    return df


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; available: {df.columns}")


def with_computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that is computed once, whatever later filters ask of it.

    A filter on a plain derived column is pushed down by copying the expression into
    the filter, several times over. A one-element generator is not unfolded that way,
    while filters and projections on all other columns still pass through it.
    """
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(value)).alias(name))
