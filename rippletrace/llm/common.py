"""Session helpers shared by the operators: partition counts, shared tables, Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rippletrace.runtime import discard, shared_dir, stored

__all__ = ["chunked", "discard", "joined", "partitions", "released", "session", "shared_dir", "stored", "texts", "typed"]

#: Rows an Arrow batch may hold on its way to a Python worker. Whole texts travel
#: in these batches, so the default of 10 000 rows would not bound memory.
ARROW_ROWS = 1024


def session(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of this session, unless the user has set a size already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(ARROW_ROWS))
    return spark


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions of this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def typed(df: DataFrame, name: str, kind: str) -> Column:
    """A column as ``kind``; untouched if it has that type, so that equal plans stay equal."""
    return F.col(name) if df.schema[name].dataType.simpleString() == kind else F.col(name).cast(kind).alias(name)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def chunked(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Regroup batches so that each holds about ``limit`` bytes of a text column, or one longer row."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(
            pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64())
        )
        start, total = 0, size
        for i, n in enumerate(lengths.tolist()):
            if total and total + n > limit:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield joined(held)
                held, start, total = [], i, 0
            total += n
        held.append(batch.slice(start))
        size = total
    if held:
        yield joined(held)
    del held
    released()


def released() -> None:
    """Give memory that a task no longer needs back to the system: idle Python workers live on."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One batch of several."""
    if len(batches) == 1:
        return batches[0]
    table = pa.Table.from_batches(batches).combine_chunks()
    return table.to_batches()[0]
