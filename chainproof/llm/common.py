"""What the training-data operators share: numbered rows, slices of batches, hashes, names."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainproof.sources.work import new_path, work_dir, written  # noqa: F401


def numbered_rows(docs: DataFrame, name: str = "rows") -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, and the name of that column, which ``docs`` did not have.
    The numbers are written with the rows, so every later read has the same ones."""
    number = "_row"
    while number.lower() in {c.lower() for c in docs.columns}:
        number += "_"
    return written(docs.withColumn(number, F.monotonically_increasing_id()), name), number


#: Rows of an Arrow batch that holds whole texts.
BATCH = 500


def short_batches(spark: SparkSession) -> None:
    """Has Spark hand texts to Python ``BATCH`` rows at a time or less. A batch stands in the memory of the
    JVM and of the worker at once, beside the heap, and texts are a hundred times as long as usual values."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, str(BATCH))


@cache
def _steady_heap() -> None:
    """Has the C library map each piece of a megabyte or more by itself for good. Else it takes them from its
    heap once it has seen large ones come and go, and a few small pieces then pin all of that."""
    if mallopt := getattr(ctypes.CDLL(None), "mallopt", None):
        mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD


def give_back() -> None:
    """Returns memory that Arrow and the C library keep for later to the system. Workers are used again
    for other stages, and share an executor's memory with the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def sliced(batches: Iterator[pa.RecordBatch], column: int | str, most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows with about ``most`` bytes of text in ``column``, or one row, so that
    what a task holds as Python objects does not depend on how long the texts are. Gives memory back
    at the end."""
    _steady_heap()
    try:
        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64) + 16
            run = (np.cumsum(sizes) - sizes) // most
            cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    yield batch.slice(a, b - a)
    finally:
        give_back()


_FIRST, _SECOND = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number turned into another that looks random, one to one."""
    x = (x ^ (x >> np.uint64(33))) * _FIRST
    x = (x ^ (x >> np.uint64(33))) * _SECOND
    return x ^ (x >> np.uint64(33))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
