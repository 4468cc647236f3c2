"""Exchange of packed occurrences: which hashed keys occur again, found bucket by bucket.

An occurrence is (key, document, position). Map tasks pack the occurrences of a chunk of
documents into one binary row per bucket, after combining equal keys inside the chunk, so
that a very common key costs one entry per chunk and a shuffle moves few, dense rows. A
bucket is one shuffle partition; its entries are sorted with numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippletrace.llm import hashing
from rippletrace.llm.common import released

PACKED = "part int, settled boolean, keys binary, where binary"
PACKED_TYPE = pa.schema(
    [("part", pa.int32()), ("settled", pa.bool_()), ("keys", pa.binary()), ("where", pa.binary())]
)
TOLD = "part int, where binary"
TOLD_TYPE = pa.schema([("part", pa.int32()), ("where", pa.binary())])
FOUND = "doc_id long, places binary"
FOUND_TYPE = pa.schema([("doc_id", pa.int64()), ("places", pa.binary())])


def squeezed(docs: np.ndarray, *columns: np.ndarray) -> bytes:
    """Documents and integers beside them as differences inside a document, by byte planes, compressed."""
    fresh = np.ones(len(docs), dtype=bool)
    fresh[1:] = docs[1:] != docs[:-1]
    planes = [np.diff(docs, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T]
    for c in columns:
        c = c.astype("<i8")
        step = np.diff(c, prepend=0)
        step[fresh] = c[fresh]
        planes.append(step.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(np.concatenate(planes)).tobytes())


def spread(blob: bytes, columns: int) -> list[np.ndarray]:
    """What :func:`squeezed` was given."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8 * (columns + 1), -1)
    step = [np.ascontiguousarray(raw[8 * k : 8 * k + 8].T).view("<i8").ravel() for k in range(columns + 1)]
    docs = np.cumsum(step[0])
    fresh = np.ones(len(docs), dtype=bool)
    fresh[1:] = docs[1:] != docs[:-1]
    begin = np.flatnonzero(fresh)
    size = np.diff(np.append(begin, len(docs)))
    out = [docs]
    for s in step[1:]:
        total = np.cumsum(s)
        out.append(total - np.repeat(total[begin] - s[begin], size))
    return out


def packed_rows(
    keys: np.ndarray, docs: np.ndarray, places: np.ndarray, settled: np.ndarray, parts: int, key: str = "<u8"
) -> pa.RecordBatch:
    """Rows for the exchange: open entries by bucket of their key; settled ones need no comparison.

    With ``key`` "<u4" only 32 bits of a key travel: enough for a prefilter, whose rare
    false matches cost a little work, since partitions hold about a million entries.
    """
    rows = []
    if settled.any():
        done_docs, done_places = docs[settled], places[settled]
        rows.append(
            {
                "part": int(done_docs[0] % parts) if len(done_docs) else 0,
                "settled": True,
                "keys": b"",
                "where": squeezed(done_docs, done_places),
            }
        )
        keys, docs, places = keys[~settled], docs[~settled], places[~settled]
    # the bucket comes from other bits than a sort inside the bucket needs: 64 bits and the bucket identify a key
    part = ((keys >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    for group in np.split(order, cuts) if len(order) else []:
        rows.append(
            {
                "part": int(((keys[group[0]] >> np.uint64(33)) % np.uint64(parts))),
                "settled": False,
                "keys": keys[group].astype(key).tobytes(),
                "where": squeezed(docs[group], places[group]),
            }
        )
    return pa.RecordBatch.from_pylist(rows, schema=PACKED_TYPE)


def by_part(parts: int, docs: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One row per partition of documents, with what it is told."""
    part = ((hashing.mixed(docs.view(np.uint64)) >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    rows = [
        {"part": int(part[g[0]]), "where": squeezed(docs[g], *(c[g] for c in columns))} for g in np.split(order, cuts)
    ]
    return pa.RecordBatch.from_pylist(rows, schema=TOLD_TYPE)


class Telling:
    """Collects what documents are told, and packs it by their partition a million entries at a time."""

    def __init__(self, parts: int, most: int = 1_000_000) -> None:
        self.parts, self.most = parts, most
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, docs: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((docs, *columns))
        self.size += len(docs)
        if self.size >= self.most:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            joined = [np.concatenate(c) for c in zip(*self.held, strict=True)]
            self.held.clear()
            self.size = 0
            yield by_part(self.parts, *joined)


def by_document(docs: np.ndarray, places: np.ndarray, kind: str) -> pa.RecordBatch:
    """One row per document with its places."""
    order = np.argsort(docs, kind="stable")
    docs, places = docs[order], places[order]
    cuts = np.flatnonzero(np.diff(docs)) + 1
    first = np.concatenate([[0], cuts]).astype(np.int64)
    offsets = np.append(first, len(docs)) * np.dtype(kind).itemsize
    data = pa.Array.from_buffers(
        pa.large_binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(places.tobytes())]
    ).cast(pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(docs[first]), data], schema=FOUND_TYPE)


def resolved(
    packed: DataFrame,
    parts: int,
    decide: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray],
    key: str = "<u8",
) -> DataFrame:
    """Bring each bucket together; ``decide(keys, docs, places)`` says which sorted entries are found.

    Entries arrive sorted by (key, document, place). Returns doc_id and places, one row
    per document that has any; found entries are packed again on their way there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        telling = Telling(parts)
        held: list[bytes] = []
        docs_of: list[np.ndarray] = []
        places_of_docs: list[np.ndarray] = []
        for batch in batches:
            for done, blob, where in zip(*(batch.column(i).to_pylist() for i in range(1, 4)), strict=True):
                docs, places = spread(where, 1)
                if done:
                    yield from telling.add(docs, places)
                else:
                    held.append(blob)
                    docs_of.append(docs)
                    places_of_docs.append(places.astype(np.int32))
        if held:
            keys = np.frombuffer(b"".join(held), key)
            docs, places = np.concatenate(docs_of), np.concatenate(places_of_docs)
            del held, docs_of, places_of_docs
            # only keys that occur twice need the full order
            order = np.argsort(keys, kind="stable")
            sorted_keys = keys[order]
            same = sorted_keys[1:] == sorted_keys[:-1]
            again = np.zeros(len(keys), dtype=bool)
            again[1:] |= same
            again[:-1] |= same
            order = order[again]
            keys, docs, places = keys[order], docs[order], places[order]
            order = np.lexsort((places, docs, keys))
            keys, docs, places = keys[order], docs[order], places[order]
            found = decide(keys, docs, places)
            yield from telling.add(docs[found], places[found])
            del keys, docs, places, order, again, same, sorted_keys, found
        yield from telling.rest()
        released()

    return assembled(packed.repartitionById(parts, F.col("part")).mapInArrow(run, TOLD), parts)


def assembled(told: DataFrame, parts: int, columns: int = 1) -> DataFrame:
    """doc_id and places, one row per document, of the rows of :func:`by_part`.

    Two columns a and b come as one number, a << 32 | b.
    """
    kind = "<i4" if columns == 1 else "<i8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[np.ndarray] = []
        places: list[np.ndarray] = []
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                doc, *rest = spread(blob, columns)
                docs.append(doc)
                places.append((rest[0] if columns == 1 else (rest[0] << 32) | rest[1]).astype(kind))
        if docs:
            yield by_document(np.concatenate(docs), np.concatenate(places), kind)
            docs.clear()
            places.clear()
            released()

    return told.repartitionById(parts, F.col("part")).mapInArrow(run, FOUND)


def places_of(blob: bytes | None) -> np.ndarray:
    """All places of a document, in no order."""
    return np.frombuffer(blob or b"", dtype="<i4")
