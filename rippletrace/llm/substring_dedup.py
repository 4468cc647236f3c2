"""Substring deduplication: words covered by a window of words that also starts earlier are removed.

Every window of ``window`` words gets its Rabin-Karp hash. So that unique windows need no
shuffle, windows are first told apart by their anchor (the k-word gram in them with the
least hash, about every sixth position): an anchor that occurs once in the corpus proves
its windows unique. The windows whose anchor repeats are counted by their full hash; the
later occurrences merge into maximal removal intervals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippletrace.llm import hashing
from rippletrace.llm.common import chunked, partitions, session, typed
from rippletrace.llm.exchange import PACKED, packed_rows, places_of, resolved

#: Bytes of text handled at once by a Python worker.
CHUNK = 2 << 20
#: Words in an anchor, as a share of the window.
ANCHOR = 0.5


class Chunk:
    """Words of a batch of documents in doc_id order."""

    def __init__(self, batch: pa.RecordBatch, window: int) -> None:
        ids = batch.column(0)
        order = np.argsort(np.asarray(ids), kind="stable")
        batch = batch.take(pa.array(order)) if (np.diff(order) < 0).any() else batch
        self.docs = np.asarray(batch.column(0)).astype(np.int64)
        data, offsets = hashing.buffer(batch.column(1))
        starts, ends, self.first = hashing.words(data, offsets)
        self.sums = hashing.prefix(hashing.word_hashes(data, starts, ends))
        counts = np.diff(self.first)
        row_end = np.repeat(self.first[1:], counts)
        k = max(1, int(window * ANCHOR))
        self.starts, self.anchor_of, self.gram = hashing.anchors(self.sums, row_end, window, k)
        self.row = np.repeat(np.arange(len(counts)), counts)
        self.batch = batch

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document and position in it of word numbers."""
        row = self.row[at]
        return self.docs[row], (at - self.first[row]).astype(np.int64)


def first_of_equal(keys: np.ndarray) -> np.ndarray:
    """For each entry the index of the first entry with its key."""
    order = np.argsort(keys, kind="stable")
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = keys[order][1:] != keys[order][:-1]
    lead = order[fresh]
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.repeat(lead, np.diff(np.append(np.flatnonzero(fresh), len(keys))))
    return out


def repeated_anchors(docs: DataFrame, window: int, parts: int) -> DataFrame:
    """doc_id and positions of the anchors that occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "text", CHUNK):
            c = Chunk(batch, window)
            if not len(c.anchor_of):
                continue
            at = np.unique(c.anchor_of)
            keys = c.gram[at]
            lead = first_of_equal(keys)
            doubled = np.bincount(lead, minlength=len(at))[lead] > 1
            # all are known to repeat, but the first must still tell other chunks
            doc, place = c.place(at)
            first = lead == np.arange(len(at))
            both = np.flatnonzero(first & doubled)
            yield packed_rows(
                np.concatenate([keys, keys[both]]),
                np.concatenate([doc, doc[both]]),
                np.concatenate([place, place[both]]),
                np.concatenate([doubled, np.zeros(len(both), dtype=bool)]),
                parts,
                "<u4",
            )

    packed = docs.mapInArrow(run, PACKED)
    return resolved(packed, parts, lambda keys, docs, places: np.ones(len(keys), dtype=bool), "<u4")


def later_windows(docs: DataFrame, window: int, parts: int) -> DataFrame:
    """doc_id and starts of the windows that also start earlier; ``docs`` carries the repeated anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "text", CHUNK):
            c = Chunk(batch, window)
            flagged = np.zeros(c.first[-1] + 1, dtype=bool)
            for row, blob in enumerate(c.batch.column(2).to_pylist()):
                if blob:
                    at = places_of(blob)
                    flagged[c.first[row] + at[at < c.first[row + 1] - c.first[row]]] = True
            at = c.starts[flagged[c.anchor_of]]
            if not len(at):
                continue
            keys = hashing.grams(c.sums, window)[at]
            doc, place = c.place(at)
            lead = first_of_equal(keys)
            later = (doc != doc[lead]) | (place != place[lead])
            told = later | (lead == np.arange(len(at)))  # a repeated row says nothing new
            yield packed_rows(keys[told], doc[told], place[told], later[told], parts)

    def later(keys: np.ndarray, docs: np.ndarray, places: np.ndarray) -> np.ndarray:
        fresh = np.ones(len(keys), dtype=bool)
        fresh[1:] = keys[1:] != keys[:-1]
        lead = np.repeat(np.flatnonzero(fresh), np.diff(np.append(np.flatnonzero(fresh), len(keys))))
        return (docs != docs[lead]) | (places != places[lead])

    return resolved(docs.mapInArrow(run, PACKED), parts, later)


def dedup(docs: DataFrame, window: int = 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove each word covered by a window that also starts in a smaller doc_id, or earlier in the same document.

    Returns one row per input row: doc_id, the carried columns, n_words, n_removed, spans
    (maximal removal intervals in words, end exclusive) and kept (the remaining words
    joined by one space). Null texts have no words; texts shorter than a window lose
    nothing; a null doc_id neither removes nor loses words; rows that repeat a doc_id are
    taken as one document and get the same result; an empty table gives an empty result.
    """
    spark = session(docs.sparkSession)
    parts = partitions(spark)
    slim = docs.select(typed(docs, "doc_id", "bigint"), typed(docs, "text", "string"))
    known = slim.filter(F.col("doc_id").isNotNull())
    whole = docs.select(
        typed(docs, "doc_id", "bigint"),
        typed(docs, "text", "string"),
        F.struct(*(F.col(c) for c in carry), F.lit(0).alias("_")).alias("row"),
    )
    dealt = whole.filter(F.col("doc_id").isNotNull()).repartition(parts, "doc_id")
    flagged = repeated_anchors(known, window, parts).withColumnRenamed("places", "anchors")
    # both joins read the same rows and columns of ``dealt``: Spark deals the texts out once and reuses that exchange
    marked = (
        dealt.join(flagged, "doc_id", "left")
        .filter("anchors IS NOT NULL")
        .select("doc_id", "text", "anchors", "row")
    )
    removed = later_windows(marked, window, parts).withColumnRenamed("places", "starts")

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, spans, kept = [], [], [], []
            for text, blob in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = (text or "").encode().split()
                runs: list[dict[str, int]] = []
                if blob:
                    starts = np.unique(places_of(blob)).astype(np.int64)
                    opens = np.flatnonzero(np.diff(starts, prepend=-window - 1) > window)
                    for a, b in zip(opens, np.append(opens[1:], len(starts)), strict=True):
                        runs.append({"start": int(starts[a]), "end": int(starts[b - 1]) + window})
                    left, at = [], 0
                    for r in runs:
                        left += words[at : r["start"]]
                        at = r["end"]
                    left += words[at:]
                else:
                    left = words
                total.append(len(words))
                gone.append(len(words) - len(left))
                spans.append(runs)
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(total, pa.int64()),
                    pa.array(gone, pa.int64()),
                    pa.array(spans, span),
                    pa.array(kept, pa.string()),
                ],
                names=["doc_id", "row", "n_words", "n_removed", "spans", "kept"],
            )

    joined = (
        dealt.join(removed, "doc_id", "left")
        .select("doc_id", "text", "row", "starts")
        .union(whole.filter(F.col("doc_id").isNull()).withColumn("starts", F.lit(None).cast("binary")))
    )
    kind = joined.schema["row"].dataType.simpleString()
    out = joined.mapInArrow(
        finish,
        f"doc_id long, row {kind}, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string",
    )
    return out.select("doc_id", *(F.col("row")[c].alias(c) for c in carry), "n_words", "n_removed", "spans", "kept")
