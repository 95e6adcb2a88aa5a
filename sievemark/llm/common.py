"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import json
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from types import ModuleType
from typing import TypeVar

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.session import materialize, new_scratch_path

__all__ = ["blobs", "fold_case", "materialize", "new_scratch_path", "table", "write_file"]

T = TypeVar("T")

# Arrow batches of long texts end at this size: Spark's own bound of 64 MB is held several
# times over by a Python worker. A session that has set another bound keeps it.
BATCH_BYTES = 4 << 20
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_DEFAULT = "67108864b"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bound_batches(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def bound_batches(df: DataFrame) -> DataFrame:
    """``df``, its session with Arrow batches bounded by bytes."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_KEY) == BATCH_DEFAULT:
        conf.set(BATCH_KEY, str(BATCH_BYTES))
    return df


def fold_case(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def blobs(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return column.cast(pa.large_binary() if wide else pa.binary()).to_pylist()


def byte_letters() -> dict[int, int]:
    """The characters that byte-level tokenizers write for bytes, as a translation table:
    printable ones stand for themselves, the others follow from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


@contextmanager
def no_collection() -> Iterator[None]:
    """Python's search for cycles is off inside the block. It would go over large caches
    again and again; code that makes no cycles needs none."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def process_wide(key: tuple, make: Callable[[], T]) -> T:
    """A value kept for the life of a Python worker process, which serves many tasks.

    Functions are shipped to the workers with their modules, so a global of a module
    would last one task only.
    """
    store = sys.modules.setdefault("_sievemark_process", ModuleType("_sievemark_process"))
    if key not in store.__dict__:
        store.__dict__[key] = make()
    return store.__dict__[key]


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def qualified(spark: SparkSession, folder: str) -> str:
    """The full URI of a folder, as Spark understands its path: one without a scheme lies
    in the cluster's default file system, not on the disk of whoever opens it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uri = system.makeQualified(path).toString()
    file_system(uri)  # a store that workers cannot open is an error here, not in a task
    return uri


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder that all executors share, from its full URI."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    scheme, _, rest = uri.partition("://")
    # What Hadoop's connector calls s3a or s3n is s3.
    return pafs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else uri)


def is_local(system: pafs.FileSystem) -> bool:
    return isinstance(system, pafs.LocalFileSystem)


def write_file(uri: str, data: bytes) -> None:
    """Write a whole small file under a temporary name, then move it into place."""
    system, path = file_system(uri)
    temporary = f"{path}.tmp"
    with system.open_output_stream(temporary) as out:
        out.write(data)
    system.move(temporary, path)


def write_manifest(uri: str, content: dict) -> None:
    write_file(uri, json.dumps(content, sort_keys=True).encode())
