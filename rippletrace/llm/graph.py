"""Connected components of an edge table, and of edge arrays inside one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippletrace.llm.common import discard, stored

#: Edges (16 bytes each) that one task closes at once; more take the distributed way, with the same result.
ALONE = 200_000
EDGE = "a long, b long"
EDGE_TYPE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the edges: every other node and the least node of its component."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, label[x], low)
        np.minimum.at(after, label[y], low)
        after = np.minimum(after, after[after])
        while (after[after] != after).any():
            after = after[after]
        if (after == label).all():
            break
        label = after
    other = label != np.arange(len(nodes))
    return nodes[label[other]], nodes[other]


def contracted(edges: DataFrame) -> DataFrame:
    """Replace each partition's edges by stars of the same components: no more edges than nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = b = np.zeros(0, dtype=np.int64)
        for batch in batches:
            a = np.concatenate([a, np.asarray(batch.column(0))])
            b = np.concatenate([b, np.asarray(batch.column(1))])
            if len(a) > 1_000_000:
                a, b = forest(a, b)
                if len(a) > 500_000:  # a partition's forest may be large: let it go, later rounds go on
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=EDGE_TYPE)
                    a = b = np.zeros(0, dtype=np.int64)
        if len(a):
            a, b = forest(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=EDGE_TYPE)

    return edges.select("a", "b").filter("a <> b").mapInArrow(run, EDGE)


def closed(edges: DataFrame) -> DataFrame:
    """Stars of the components of few edges, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.asarray(x.column(0)), np.asarray(x.column(1))) for x in batches if x.num_rows]
        if held:
            a, b = forest(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=EDGE_TYPE)

    return edges.select("a", "b").repartition(1).mapInArrow(run, EDGE)


def components(edges: DataFrame, contract: bool = True, alone: int | None = None) -> DataFrame:
    """node and component (its least node) for every node of the edges (a, b), by alternating star contraction.

    Each round links every node's larger neighbours to its least neighbour and writes the
    edges to the shared folder; it ends when a round changes nothing, never before. A node with very
    many neighbours is one row of an aggregate and a skewed join that Spark may split.
    Edges that are stars within their partitions already need no contraction.
    """
    first = contracted(edges) if contract else edges.select("a", "b").filter("a <> b")
    now = stored(first.distinct(), "edges")
    if now.count() <= (ALONE if alone is None else alone):
        now = stored(closed(now), "edges")
        return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
            now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
        )
    mark = None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # aggregates are written first: then both sides of a join are plain exchanges, which Spark splits where skewed
        low = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = both.filter("b > a").join(low, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        large = stored(large, "large")
        # now a < b: b hangs on a; link b's other, larger supports to its least one
        least = stored(large.groupBy("b").agg(F.min("a").alias("m")), "least")
        hung = F.array(
            F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b"))
        )
        small = (
            large.join(least, "b").select(F.explode(hung).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        )
        after = stored(small, "edges")
        for old in (large, least):
            discard(old)
        sign = after.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        discard(now)
        now = after
        if mark == tuple(sign):  # all edges are stars, and each node's least neighbour was its component
            return low.select(F.col("a").alias("node"), F.col("m").alias("component"))
        discard(low)
        mark = tuple(sign)
