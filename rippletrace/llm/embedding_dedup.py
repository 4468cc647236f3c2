"""Embedding near-deduplication by Euclidean p-stable hashing.

Normalised vectors are projected on random directions, shifted and cut into cells of one
width; a table's key joins several cells. A packed exchange finds the keys that more than
one vector has, so vectors travel only for those. Inside a bucket cosines are exact and in
double precision; a pair that meets in several tables counts in the first one.

Equal vectors are one class from the start. Buckets larger than a block are compared block
by block, each pair of blocks in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippletrace.llm import hashing
from rippletrace.llm.common import partitions, session, stored
from rippletrace.llm.exchange import PACKED, packed_rows, resolved
from rippletrace.llm.graph import components, forest
from rippletrace.llm.vectors import matrix, valid

#: Tables, cells a key, cell width: a pair at cosine 0.95 meets with probability 0.95, at 0.98 with 0.999.
TABLES, CELLS, WIDTH = 24, 8, 1.1
BLOCK = 1024


def signatures(x: np.ndarray, tables: int, cells: int, width: float, seed: int) -> np.ndarray:
    """One key per row and table."""
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((x.shape[1], tables * cells))
    shifts = rng.random(tables * cells) * width
    scaled = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows
    unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
    cell = np.floor((unit @ directions + shifts) / width).astype(np.int64).view(np.uint64)
    out = np.empty((len(x), tables), dtype=np.uint64)
    for t in range(tables):
        key = np.full(len(x), t + 1, dtype=np.uint64)
        for c in range(t * cells, (t + 1) * cells):
            key = hashing.mixed(key * np.uint64(hashing.BASE) + cell[:, c])
        out[:, t] = key
    return out


def near_duplicates(
    rows: DataFrame, threshold: float = 0.95, tables: int = TABLES, cells: int = CELLS, width: float = WIDTH, seed: int = 7
) -> DataFrame:
    """Link vectors with cosine >= ``threshold``.

    Returns one row per input row: vec_id, n_links (other rows linked directly),
    component_id (least vec_id reachable), kept (vec_id = component_id). Vectors that take
    no part (see :func:`rippletrace.llm.vectors.valid`) have no links and are their own
    component. Rows that repeat a vec_id count as rows; an empty table gives an empty
    result. No pair below the threshold is linked.
    """
    spark = session(rows.sparkSession)
    parts = partitions(spark)
    usable, d = valid(rows)
    usable = stored(usable, "vectors")
    classes = usable.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = signatures(matrix(batch.column(0), d), tables, cells, width, seed)
                keys = pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(8 * tables), len(s), [None, pa.py_buffer(np.ascontiguousarray(s).tobytes())]
                ).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(2), keys], names=["v", "rep", "n", "keys"]
                )

    signed = stored(
        classes.select("v", "rep", "n").mapInArrow(sign, "v array<double>, rep long, n long, keys binary"), "signed"
    )

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8")
                docs = np.repeat(np.asarray(batch.column(0)), tables)
                table = np.tile(np.arange(tables), batch.num_rows)
                yield packed_rows(keys, docs, table, np.zeros(len(keys), dtype=bool), parts)

    shared = resolved(
        signed.select("rep", "keys").mapInArrow(occurrences, PACKED),
        parts,
        lambda keys, docs, places: np.ones(len(keys), dtype=bool),
    )
    meeting = shared.withColumnsRenamed({"doc_id": "rep", "places": "tables"})

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per vector and table in which it meets another."""
        for batch in batches:
            at, key, table = [], [], []
            for i, (keys, blob) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                own = np.frombuffer(keys, "<i8")
                for t in np.unique(np.frombuffer(blob, "<i4")).tolist():
                    at.append(i)
                    key.append(int(own[t]))
                    table.append(t)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(table, pa.int32()), pa.array(key, pa.int64())],
                names=["rep", "t", "key"],
            )

    buckets = stored(
        signed.select("rep", "keys")
        .join(meeting, "rep")
        .select("rep", "keys", "tables")
        .mapInArrow(spread, "rep long, t int, key long"),
        "buckets",
    )
    sizes = buckets.groupBy("t", "key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    units = (
        buckets.join(sizes, ["t", "key"])
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .join(signed, "rep")
        .select(
            "t",
            "key",
            F.least("block", "other").alias("i"),
            F.greatest("block", "other").alias("j"),
            "block",
            "rep",
            "n",
            "v",
            "keys",
        )
    )
    kinds = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def compare(group: pa.Table) -> pa.Table:
        t, i, j = (group.column(c)[0].as_py() for c in ("t", "i", "j"))
        x = matrix(group.column("v"), d)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        rep = np.asarray(group.column("rep"))
        n = np.asarray(group.column("n"))
        block = np.asarray(group.column("block"))
        keys = np.frombuffer(b"".join(group.column("keys").to_pylist()), "<u8").reshape(len(rep), -1)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        near = x[left] @ x[right].T >= threshold
        if i == j:
            np.fill_diagonal(near, False)
        for s in range(t):  # counted in an earlier table already
            if not near.any():
                break
            near &= keys[left, s][:, None] != keys[right, s][None]
        links = np.zeros(len(rep), dtype=np.int64)
        links[left] += near @ n[right]
        if i != j:
            links[right] += n[left] @ near
        p, q = np.nonzero(near)
        a, b = forest(rep[left[p]], rep[right[q]]) if len(p) else (rep[:0], rep[:0])
        some = links > 0
        return pa.table(
            [
                pa.array(np.concatenate([rep[some], a])),
                pa.concat_arrays([pa.nulls(int(some.sum()), pa.int64()), pa.array(b)]),
                pa.array(np.concatenate([links[some], np.zeros(len(a), dtype=np.int64)])),
            ],
            schema=kinds,
        )

    found = stored(units.groupBy("t", "key", "i", "j").applyInArrow(compare, "a long, b long, n long"), "links")
    joined = components(found.filter("b IS NOT NULL").select("a", "b"))
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    named = (
        signed.select("v", "rep", "n")
        .join(counts, "rep", "left")
        .join(joined, F.col("rep") == F.col("node"), "left")
        .select("v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    part = usable.join(named, "v").select("vec_id", "n_links", "component_id")
    ids = rows.select(F.col("vec_id").cast("long").alias("vec_id"))
    known = part.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return ids.join(known, "vec_id", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept"),
    )
