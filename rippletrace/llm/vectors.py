"""Vector columns: which vectors take part, and matrices from Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, int]:
    """vec_id and v (array<double>) of the vectors that take part, and their dimension.

    Left out are vectors that are null, empty, zero or hold null or non-finite
    components, rows without an id, and vectors of another length than the most common
    one (the longer of two equally common).
    """
    v = F.col(embedding).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        v.alias("v"),
        finite.alias("finite"),
        F.exists(v, lambda x: x != 0).alias("filled"),
    ).filter("vec_id IS NOT NULL AND v IS NOT NULL AND finite AND filled")
    usable = usable.select("vec_id", "v")
    common = usable.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = common["d"] if common else 0
    return usable.filter(F.size("v") == d), d


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of a list column without nulls as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), d)
