"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions, shifted and put in the order of a Hilbert
curve; several projections and shifts give several orders, each range-partitioned by
Spark. Only keys travel: the orders yield milestones (the keys at evenly spaced ranks), a
table of bounded size, from which follows the window of keys around a query on each
curve. The rows stay where they are; each partition holds the windows of a block of queries
against its rows, and the windows' nearest rows merge and are ranked by the exact distance.

Equal vectors are one class with one place on each curve. As ties go to the smaller
vec_id, a class needs only its k + 1 least ids as neighbours, and one search serves all
queries of a class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippletrace.llm import hashing
from rippletrace.llm.common import partitions, released, session, stored
from rippletrace.llm.vectors import matrix, valid

#: Orders, projected dimensions, bits of a coordinate, and the window as a share of all rows.
#: On isotropic 64-dimensional vectors (nothing to be won by any index) this finds over 0.95 of the 10 nearest.
CURVES, DIMENSIONS, BITS, WINDOW = 28, 6, 8, 0.05
LEAST_WINDOW = 64
#: Milestones inside half a window, and at most on a curve; queries of a block (1 KB each); queries and rows compared at once.
MARKS, MOST_MARKS, QUERIES, TOGETHER, ROWS = 64, 4096, 8192, 512, 4096
#: Bits that order equal keys, each curve in its own way.
TIE = 14


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of unsigned cell coordinates.

    Works from the highest bit down: each level's corner decides a reflection or an
    exchange of the lower bits of two axes; the Gray code of the result is the position.
    """
    axes = [cells[:, i].astype(np.uint64) for i in range(cells.shape[1])]
    level = 1 << (bits - 1)
    while level > 1:
        bit, low = np.uint64(level), np.uint64(level - 1)
        for i, axis in enumerate(axes):
            upper = (axis & bit) != 0
            swap = np.where(upper, np.uint64(0), (axes[0] ^ axis) & low)
            axes[0] = np.where(upper, axes[0] ^ low, axes[0] ^ swap)
            if i:
                axes[i] = axis ^ swap
        level >>= 1
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros(len(cells), dtype=np.uint64)
    level = 1 << (bits - 1)
    while level > 1:
        turn = np.where(axes[-1] & np.uint64(level), turn ^ np.uint64(level - 1), turn)
        level >>= 1
    key = np.zeros(len(cells), dtype=np.uint64)
    for b in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << np.uint64(1)) | (((axis ^ turn) >> np.uint64(b)) & np.uint64(1))
    return key


class Best:
    """The nearest ids of each of a block's queries so far, an id at its least distance."""

    def __init__(self, queries: np.ndarray, most: int) -> None:
        self.queries, self.most = queries, most
        self.squares = (queries * queries).sum(axis=1)
        self.found: list[dict[int, float]] = [{} for _ in queries]
        self.bound = np.full(len(queries), np.inf)

    def add(self, some: slice, x: np.ndarray, ids: list[list[int]], near: np.ndarray) -> None:
        """Take in rows for some of the queries; ``near`` says which rows lie in which query's windows."""
        asked, bound, size = self.queries[some], self.bound[some], (x * x).sum(axis=1)
        scale = self.squares[some, None] + size
        slack = 1e-9 * scale  # more than rounding can take from a rough square
        rough = scale - 2 * (asked @ x.T) - slack
        rough[~near] = np.inf
        for q in np.flatnonzero(((rough <= bound[:, None] ** 2) & near).any(axis=1)).tolist():
            row, known = rough[q], self.found[some.start + q]
            close = np.flatnonzero((row <= bound[q] ** 2) & near[q])
            n = 4 * self.most
            while True:  # the roughly nearest first; more only if repeated ids leave too few
                few = close if len(close) <= n else close[row[close] <= np.partition(row[close], n - 1)[n - 1] + 2 * slack[q, close].max()]
                gap = np.sqrt(((x[few] - asked[q]) ** 2).sum(axis=1))
                new = dict(known)
                for g, j in zip(gap.tolist(), few.tolist(), strict=True):
                    for v in ids[j]:
                        if g < new.get(v, np.inf):
                            new[v] = g
                if len(few) == len(close) or len(new) >= self.most + len(known):
                    break
                n *= 2
            best = sorted((g, v) for v, g in new.items())[: self.most]
            self.found[some.start + q] = {v: g for g, v in best}
            if len(best) == self.most:
                bound[q] = best[-1][0] * (1 + 1e-9)  # a view of self.bound


def nearest(
    rows: DataFrame,
    queries: Column,
    k: int = 10,
    curves: int = CURVES,
    window: float = WINDOW,
    seed: int = 3,
) -> DataFrame:
    """For each row that meets ``queries`` (a condition on vec_id) its ``k`` nearest others found.

    Returns query_id, rank (from 1), vec_id, score (Euclidean distance in double
    precision), nearest first, ties to the smaller vec_id; fewer than k where there are
    fewer candidates. ``window`` is a share of the rows, or a number of ranks if it is
    above 1 (rounded out to a 2048th of the rows). Vectors that take no part (see
    :func:`rippletrace.llm.vectors.valid`) are neither queries nor candidates. Repeated ids
    count once as a query and once as a neighbour; rows with a query's own id are not its
    neighbours. An empty table gives an empty result.
    """
    spark = session(rows.sparkSession)
    parts = partitions(spark)
    usable, d = valid(rows)
    usable = stored(usable, "points")
    norm = usable.agg(
        F.percentile_approx(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), 0.5)
    ).first()[0]
    least = k + 1
    parted = usable.groupBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("salt")).agg(
        F.slice(F.sort_array(F.collect_set("vec_id")), 1, least).alias("ids"), F.bool_or(queries).alias("asks")
    )  # a class of any size is dealt over all partitions first
    classes = (
        parted.groupBy("v")
        .agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, least).alias("ids"), F.bool_or("asks").alias("asks"))
        .select(F.monotonically_increasing_id().alias("class"), "ids", "asks", "v")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Add each row's keys, one a curve; ties differ from curve to curve."""
        rng = np.random.default_rng(seed)
        planes = rng.standard_normal((curves, d, DIMENSIONS)) / (norm or 1.0)
        shifts = rng.random((curves, DIMENSIONS)) * 4
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(3), d)
            own = np.asarray(batch.column(0)).astype(np.uint64) * np.uint64(curves)
            keys = np.empty((len(x), curves), dtype="<i8")
            for c in range(curves):
                cell = np.clip((x @ planes[c] + shifts[c] + 4) * ((1 << BITS) / 12), 0, (1 << BITS) - 1)
                tie = hashing.mixed(own + np.uint64(c)) >> np.uint64(64 - TIE)
                keys[:, c] = ((hilbert_keys(cell.astype(np.int64), BITS) << np.uint64(TIE)) | tie).astype(np.int64)
            blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * curves), len(x), [None, pa.py_buffer(keys.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns, blob.cast(pa.binary())], names=["class", "ids", "asks", "v", "keys"])

    placed = stored(
        classes.mapInArrow(place, "class long, ids array<long>, asks boolean, v array<double>, keys binary"), "placed"
    )
    marks = milestones(placed, curves, window, parts)
    asking = placed.filter("asks")
    blocks = max(1, -(-asking.count() // QUERIES))
    found = None
    for b in range(blocks):  # a stated query set against all rows, a block of bounded size at a time
        mine = asking.filter(F.pmod(F.xxhash64("class"), F.lit(blocks)) == b).select("class", "v", "keys").collect()
        if mine:
            one = stored(searched(placed, mine, marks, d, curves, least), "found")
            found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], "class long, vec_id long, score double")
    best = Window.partitionBy("class").orderBy("score", "vec_id")
    near = stored(
        found.groupBy("class", "vec_id")
        .agg(F.min("score").alias("score"))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= least)
        .groupBy("class")
        .agg(F.collect_list(F.struct("vec_id", "score")).alias("near")),
        "near",
    )
    of_class = asking.select("class", "v").join(near, "class").select("v", "near")
    each = (
        usable.filter(queries)
        .select(F.col("vec_id").alias("query_id"), "v")
        .join(of_class, "v")
        .select("query_id", F.inline("near"))
        .filter("vec_id <> query_id")
    )
    merged = each.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    first = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        merged.withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def milestones(placed: DataFrame, curves: int, window: float, parts: int) -> tuple[list[np.ndarray], int]:
    """The keys at evenly spaced ranks of each curve, and how many of them make half a window.

    Keys are range-partitioned and sorted, counted as they pass, and every so many a key
    stays: at most ``MOST_MARKS`` a curve, however many rows there are.
    """
    spark = placed.sparkSession

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8").reshape(-1, curves)
                curve = np.repeat(np.arange(curves, dtype=np.int32), len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(curve), pa.array(keys.T.ravel())], names=["curve", "key"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Count the rows of each curve in this partition as they pass."""
        seen = np.zeros(curves, dtype=np.int64)
        for batch in batches:
            curve = np.asarray(batch.column(0))
            at = np.empty(len(curve), dtype=np.int64)
            for c in np.unique(curve).tolist():
                mine = np.flatnonzero(curve == c)
                at[mine] = seen[c] + np.arange(len(mine))
                seen[c] += len(mine)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=["curve", "key", "part", "at"])

    ranged = placed.select("keys").mapInArrow(unpack, "curve int, key long").repartitionByRange(parts, "curve", "key").sortWithinPartitions("curve", "key")
    order = stored(
        ranged.withColumn("part", F.spark_partition_id()).mapInArrow(number, "curve int, key long, part int, at long"), "order"
    )
    counts = order.groupBy("curve", "part").count().orderBy("curve", "part").collect()  # partitions + curves rows at most
    bases, before = [], [0] * curves
    for r in counts:
        bases.append((r["curve"], r["part"], before[r["curve"]]))
        before[r["curve"]] += r["count"]
    total = max(before, default=0)
    reach = max(LEAST_WINDOW, int(total * window) if window <= 1 else int(window)) // 2
    apart = max(1, reach // MARKS, -(-total // MOST_MARKS))
    base = F.broadcast(spark.createDataFrame(bases, "curve int, part int, base long"))
    kept = order.join(base, ["curve", "part"]).filter((F.col("base") + F.col("at")) % apart == 0).select("curve", "key").collect()
    out: list[list[int]] = [[] for _ in range(curves)]
    for r in kept:
        out[r["curve"]].append(r["key"])
    return [np.sort(np.array(x, dtype=np.int64)) for x in out], -(-reach // apart)


def searched(placed: DataFrame, mine: list, marks: tuple[list[np.ndarray], int], d: int, curves: int, least: int) -> DataFrame:
    """For a block of queries (class, v, keys) the nearest ids that each partition's rows have in their windows: class, vec_id, score."""
    at, half = marks
    keys = np.frombuffer(b"".join(bytes(r["keys"]) for r in mine), "<i8").reshape(-1, curves)
    low, high = np.empty_like(keys), np.empty_like(keys)
    for c in range(curves):
        own = np.concatenate([[-1], at[c], [np.iinfo(np.int64).max]])  # beyond the ends there is nothing to leave out
        low[:, c] = own[np.maximum(np.searchsorted(own, keys[:, c], side="right") - 1 - half, 0)]
        high[:, c] = own[np.minimum(np.searchsorted(own, keys[:, c], side="left") + half, len(own) - 1)]
    names = np.array([r["class"] for r in mine], dtype=np.int64)
    sent = placed.sparkSession.sparkContext.broadcast((names, np.array([r["v"] for r in mine], dtype=np.float64), low, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked, low, high = sent.value
        best = Best(asked, least)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                rows = batch.slice(a, ROWS)
                x = matrix(rows.column(1), d)
                keys = np.frombuffer(b"".join(rows.column(2).to_pylist()), "<i8").reshape(-1, curves)
                ids = rows.column(0).to_pylist()
                for q in range(0, len(asked), TOGETHER):
                    some = slice(q, q + TOGETHER)
                    near = np.zeros((len(asked[some]), len(x)), dtype=bool)
                    for c in range(curves):
                        near |= (keys[:, c] >= low[some, c, None]) & (keys[:, c] <= high[some, c, None])
                    best.add(some, x, ids, near)
        out = [(n, v, g) for n, found in zip(names.tolist(), best.found, strict=True) for v, g in found.items()]
        if out:
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
                names=["class", "vec_id", "score"],
            )
        released()

    return placed.select("ids", "v", "keys").mapInArrow(run, "class long, vec_id long, score double")
