"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.storage import discard, shared_dir, written

__all__ = ["WS", "discard", "id_crc", "mapped", "packed_search", "partitions", "released", "shared_dir", "slices", "small_batches", "table", "text_of", "text_slices", "written"]

#: The six ASCII white-space characters, as a Java and Python regex.
WS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_crc(id_col: str | Column = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def packed_search(packed: Column, n: int, width: int, key: Column) -> Column:
    """Number of the n sorted keys of `width` bytes in the literal `packed` that are <= key, by binary search in the JVM."""
    steps = [1 << i for i in range(max(n, 1).bit_length() - 1, -1, -1)]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda i, s: F.when((i + s <= n) & (F.substring(packed, (i + s - 1) * width + 1, F.lit(width)) <= key), i + s).otherwise(i),
    )


#: Bytes of an Arrow batch on its way to a Python worker, and the setting that bounds it.
BATCH, BATCH_SETTING = 4_000_000, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that go to Python workers by BATCH, in this session and unless it has a bound of its own.

    Without it 10,000 rows go at once, which neither the worker nor the executor's direct memory gives back in full. A
    longer text makes a batch of its own.
    """
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH))


def mapped(df: DataFrame, run: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """mapInArrow in small batches, with a worker that gives its memory back."""
    small_batches(df.sparkSession)
    return df.mapInArrow(released(run), schema)


def give_back() -> None:
    """Return what this process has freed to the system: Arrow's pool and, where the C library can, its heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_slices(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """Stretches of an array of about `most` bytes of text; an empty array has none."""
    upto = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0)).astype(np.int64))
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most)) + 1
        yield texts.slice(at, end - at)
        at = end


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Stretches of a batch of about `most` bytes of text in the given column."""
    at = 0
    for part in text_slices(batch.column(column), most):
        yield batch.slice(at, len(part))
        at += len(part)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` for mapInArrow, or over the arrays of an arrow_udf, whose worker gives its memory back when a task ends.

    Spark uses Python workers again, for other stages too, and idle ones count against the executor's memory.
    """

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.enable()
            gc.collect()
            give_back()

    return task
