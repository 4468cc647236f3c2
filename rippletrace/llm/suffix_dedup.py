"""Suffix-array deduplication: bytes inside a string of fixed length that a smaller doc_id also holds.

Only suffixes that can match need sorting. A string's anchor (the byte gram in it with the
least hash) stands at the same place wherever the string stands, so anchors that occur in
one document only rule their strings out. The other strings travel as segments, runs of
starts with one anchor, to the anchor's partition; equal segments are merged there and the
suffixes of the distinct ones are sorted deep-shallow: multikey quicksort over eight-byte
characters to a shallow depth, then blind tries for the groups whose common prefix is
longer. Suffixes equal over the full length form a class, whose least document keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippletrace.llm import hashing
from rippletrace.llm.common import chunked, partitions, released, session, typed
from rippletrace.llm.exchange import (
    PACKED,
    TOLD,
    Telling,
    assembled,
    packed_rows,
    places_of,
    resolved,
    spread,
    squeezed,
)
from rippletrace.llm.substring_dedup import first_of_equal

CHUNK = 1 << 20
#: Bytes in an anchor, as a share of the string's length; depth to which quicksort goes.
ANCHOR = 0.48
SHALLOW = 32

SEGMENTS = "part int, told boolean, shelf int, where binary, data binary"
SEGMENTS_TYPE = pa.schema(
    [("part", pa.int32()), ("told", pa.bool_()), ("shelf", pa.int32()), ("where", pa.binary()), ("data", pa.binary())]
)
#: A partition's segments lie on so many shelves by their anchor; one shelf is sorted at a time.
SHELVES = 8


class Chunk:
    """Bytes of a batch of documents in doc_id order, with the anchors of their strings."""

    def __init__(self, batch: pa.RecordBatch, length: int) -> None:
        order = np.argsort(np.asarray(batch.column(0)), kind="stable")
        self.batch = batch.take(pa.array(order)) if (np.diff(order) < 0).any() else batch
        self.docs = np.asarray(self.batch.column(0)).astype(np.int64)
        self.data, self.offsets = hashing.buffer(self.batch.column(1))
        self.sums = hashing.prefix(hashing.BYTE_VALUE[self.data])
        row_end = np.repeat(self.offsets[1:], np.diff(self.offsets))
        self.starts, self.anchor_of, self.gram = hashing.anchors(
            self.sums, row_end, length, max(1, int(length * ANCHOR))
        )

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.searchsorted(self.offsets, at, side="right") - 1
        return self.docs[row], at - self.offsets[row]


def shared_anchors(docs: DataFrame, length: int, parts: int) -> DataFrame:
    """doc_id and positions of the anchors that occur in more than one document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "text", CHUNK):
            c = Chunk(batch, length)
            if not len(c.anchor_of):
                continue
            at = np.unique(c.anchor_of)
            keys = c.gram[at]
            doc, place = c.place(at)
            lead = first_of_equal(keys)
            shared = np.zeros(len(at), dtype=bool)
            shared[lead[doc != doc[lead]]] = True
            settled = shared[lead]
            tell = np.flatnonzero(settled & (lead == np.arange(len(at))))  # one entry for the other chunks
            yield packed_rows(
                np.concatenate([keys, keys[tell]]),
                np.concatenate([doc, doc[tell]]),
                np.concatenate([place, place[tell]]),
                np.concatenate([settled, np.zeros(len(tell), dtype=bool)]),
                parts,
                "<u4",
            )

    def decide(keys: np.ndarray, docs: np.ndarray, places: np.ndarray) -> np.ndarray:
        fresh = np.ones(len(keys), dtype=bool)
        fresh[1:] = keys[1:] != keys[:-1]
        group = np.cumsum(fresh) - 1
        begin = np.flatnonzero(fresh)
        several = docs[begin] != docs[np.append(begin[1:], len(keys)) - 1]  # sorted by document inside a key
        return several[group]

    return resolved(docs.mapInArrow(run, PACKED), parts, decide, "<u4")


def taken(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of several slices, one after the other."""
    ends = np.cumsum(sizes)
    return data[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def segments(docs: DataFrame, length: int, parts: int) -> DataFrame:
    """Runs of string starts with one shared anchor, packed by the anchor's partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in chunked(batches, "text", CHUNK):
            c = Chunk(batch, length)
            flagged = np.zeros(len(c.data) + 1, dtype=bool)
            for row, blob in enumerate(c.batch.column(2).to_pylist()):
                if blob:
                    at = places_of(blob)
                    flagged[c.offsets[row] + at[at < c.offsets[row + 1] - c.offsets[row]]] = True
            chosen = flagged[c.anchor_of]
            starts, anchor = c.starts[chosen], c.anchor_of[chosen]
            if not len(starts):
                continue
            fresh = np.ones(len(starts), dtype=bool)
            fresh[1:] = (np.diff(starts) != 1) | (np.diff(anchor) != 0)
            begin = np.flatnonzero(fresh)
            count = np.diff(np.append(begin, len(starts)))
            start, anchor = starts[begin], anchor[begin]
            doc, place = c.place(start)
            size = count + length - 1
            inverse = hashing.powers(len(c.data))[1]
            content = hashing.mixed(
                (c.sums[start + size] - c.sums[start]) * inverse[start] + size.astype(np.uint64)
            )
            lead = first_of_equal(content)
            told = doc != doc[lead]  # a smaller document of this chunk has the whole segment
            rows = []
            if told.any():
                rows.append(
                    {
                        "part": int(doc[told][0] % parts),
                        "told": True,
                        "shelf": 0,
                        "where": squeezed(doc[told], place[told], count[told]),
                        "data": b"",
                    }
                )
            left = np.flatnonzero(~told)
            slot = ((c.gram[anchor[left]] >> np.uint64(33)) % np.uint64(parts * SHELVES)).astype(np.int32)
            order = np.argsort(slot, kind="stable")
            for g in np.split(order, np.flatnonzero(np.diff(slot[order])) + 1):
                mine = left[g]
                rows.append(
                    {
                        "part": int(slot[g[0]]) // SHELVES,
                        "told": False,
                        "shelf": int(slot[g[0]]) % SHELVES,
                        "where": squeezed(doc[mine], place[mine], count[mine]),
                        "data": press.compress(taken(c.data, start[mine], size[mine]).tobytes()),
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=SEGMENTS_TYPE)

    return docs.mapInArrow(run, SEGMENTS)


class BlindTrie:
    """Distinct strings of one length with a common prefix; inner nodes know only a depth and branching bytes."""

    def __init__(self, text: bytes, length: int, first: int) -> None:
        self.text, self.length = text, length
        self.root: list | int = first  # a leaf is a position, an inner node [depth, {byte: child}]

    def insert(self, at: int) -> int:
        """Add the string at a position; the position of the equal string that the trie already holds, or ``at``."""
        text, node = self.text, self.root
        path = []
        while not isinstance(node, int):  # blind descent: skipped bytes are not looked at
            path.append(node)
            child = node[1].get(text[at + node[0]])
            if child is None:
                while not isinstance(node, int):
                    node = next(iter(node[1].values()))
                break
            node = child
        leaf = node
        common, a, b = 0, text[at : at + self.length], text[leaf : leaf + self.length]
        if a == b:
            return leaf
        low, high = 0, self.length
        while low < high:  # longest common prefix by halving
            common = (low + high + 1) // 2
            if a[:common] == b[:common]:
                low = common
            else:
                high = common - 1
        parent = None
        for inner in path:
            if inner[0] >= low:
                break
            parent = inner
        below = self.root if parent is None else parent[1][a[parent[0]]]
        if not isinstance(below, int) and below[0] == low:
            below[1][a[low]] = at
            return at
        fork = [low, {b[low]: below, a[low]: at}]
        if parent is None:
            self.root = fork
        else:
            parent[1][a[parent[0]]] = fork
        return at


def deep_shallow(
    text: np.ndarray, suffixes: np.ndarray, owners: np.ndarray, length: int, shallow: int = SHALLOW
) -> np.ndarray:
    """For each suffix the least owner among those that agree over ``length`` bytes.

    Suffixes that a smaller depth already tells apart from all of another owner leave the
    sort early.
    """
    least = owners.copy()
    padded = np.concatenate([text, np.zeros(16, dtype=np.uint8)])
    eight = np.ndarray((len(padded) - 7,), dtype=">u8", buffer=padded.data, strides=(1,))
    at = np.arange(len(suffixes))
    group = np.zeros(len(at), dtype=np.int64)
    depth, steps = 0, list(range(0, min(shallow, length), 8))
    for depth in steps:
        width = min(8, length - depth)
        key = eight[suffixes[at] + depth].astype(np.uint64) >> np.uint64(8 * (8 - width))
        order = np.argsort(key, kind="stable") if depth == 0 else np.lexsort((key, group))
        at, key, group = at[order], key[order], group[order]
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        begin = np.flatnonzero(fresh)
        size = np.diff(np.append(begin, len(at)))
        low = np.minimum.reduceat(owners[at], begin) if len(begin) else begin
        high = np.maximum.reduceat(owners[at], begin) if len(begin) else begin
        keep = np.repeat(low != high, size)
        group = np.repeat(np.arange(len(begin)), size)[keep]
        at = at[keep]
        if not len(at):
            return least
    reached = min(length, depth + 8)
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = group[1:] != group[:-1]
    begin = np.flatnonzero(fresh)
    size = np.diff(np.append(begin, len(at)))
    lead = np.repeat(at[begin], size)
    leaf = at.copy()
    # the first suffix of a group is its trie's only leaf; those that equal it need no descent
    same = np.ones(len(at), dtype=bool)
    for depth in [*range(reached, length - 7, 8), length - 8] if length - reached >= 8 else [max(0, length - 8)]:
        same &= eight[suffixes[at] + depth] == eight[suffixes[lead] + depth]
    leaf[same] = lead[same]
    rest = np.flatnonzero(~same)
    if len(rest):
        blob = padded.tobytes()
        position = suffixes.tolist() if len(rest) > len(suffixes) // 4 else suffixes
        of_group = group[rest]
        cuts = np.flatnonzero(np.diff(of_group)) + 1
        for members in np.split(rest, cuts):
            trie = BlindTrie(blob, length, int(position[lead[members[0]]]))
            holder = {int(position[lead[members[0]]]): int(lead[members[0]])}
            for m in members.tolist():
                p = int(position[at[m]])
                q = trie.insert(p)
                leaf[m] = holder.setdefault(q, int(at[m]))
    order = np.argsort(leaf, kind="stable")
    at, leaf = at[order], leaf[order]
    begin = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]]))
    low = np.minimum.reduceat(owners[at], begin)
    least[at] = np.repeat(low, np.diff(np.append(begin, len(at))))
    return least


def runs_of(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[0], flag.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def content_hashes(text: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of each slice, a megabyte of slices at a time."""
    out = np.empty(len(at), dtype=np.uint64)
    cuts = np.searchsorted(at, np.arange(0, len(text) + (1 << 20), 1 << 20))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if a < b:
            low = at[a]
            part = text[low : at[b - 1] + size[b - 1]]
            sums = hashing.prefix(hashing.BYTE_VALUE[part])
            s, n = at[a:b] - low, size[a:b]
            out[a:b] = hashing.mixed((sums[s + n] - sums[s]) * hashing.powers(len(part))[1][s] + n.astype(np.uint64))
    return out


def removed_starts(
    doc: np.ndarray, start: np.ndarray, count: np.ndarray, text: np.ndarray, length: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs (document, start, count) of string starts that a smaller document of these segments also has."""
    size = count + length - 1
    at = np.cumsum(size) - size
    # equal segments merge; the class's least document stands for it
    lead = first_of_equal(content_hashes(text, at, size))
    owner = doc.copy()
    np.minimum.at(owner, lead, doc)
    distinct = np.flatnonzero(lead == np.arange(len(lead)))
    n = count[distinct]
    base = np.cumsum(n) - n
    suffix = np.repeat(at[distinct] - base, n) + np.arange(n.sum())
    least = deep_shallow(text, suffix, np.repeat(owner[distinct], n), length)
    del suffix
    # back to every segment: its starts that a smaller document holds
    number = np.empty(len(lead), dtype=np.int64)
    number[distinct] = np.arange(len(distinct))
    number = number[lead]
    slot = base[number]
    some = np.flatnonzero(np.minimum.reduceat(least, base)[number] < doc)
    for a in range(0, len(some), 20_000):
        mine = some[a : a + 20_000]
        c = count[mine]
        ends = np.cumsum(c)
        which = np.repeat(np.arange(len(mine)), c)
        inner = np.arange(ends[-1]) - (ends - c)[which]
        gone = least[slot[mine][which] + inner] < doc[mine][which]
        first = gone.copy()
        first[1:] &= ~gone[:-1] | (which[1:] != which[:-1])
        last = gone.copy()
        last[:-1] &= ~gone[1:] | (which[1:] != which[:-1])
        f, e = np.flatnonzero(first), np.flatnonzero(last)
        if len(f):
            yield doc[mine][which[f]], start[mine][which[f]] + inner[f], e - f + 1


def sort_segments(packed: DataFrame, length: int, parts: int) -> DataFrame:
    """Runs of removed string starts (start << 32 | count), told to the documents' partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        telling = Telling(parts)
        shelves: list[list[tuple[bytes, bytes]]] = [[] for _ in range(SHELVES)]
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            for told, shelf, where, data in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                if told:
                    yield from telling.add(*spread(where, 2))
                else:
                    shelves[shelf].append((where, data))
        for held in shelves:
            if held:
                doc, start, count = (np.concatenate(x) for x in zip(*(spread(w, 2) for w, _ in held), strict=True))
                text = np.frombuffer(b"".join(unpress.decompress(d) for _, d in held), np.uint8)
                held.clear()
                for runs in removed_starts(doc, start, count, text, length):
                    yield from telling.add(*runs)
        yield from telling.rest()
        released()

    told = packed.repartitionById(parts, F.col("part")).mapInArrow(run, TOLD)
    return assembled(told, parts, columns=2)


def dedup(docs: DataFrame, length: int = 50) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts in a smaller doc_id.

    Texts count as UTF-8 bytes; matches never cross documents and are judged on the input.
    Returns one row per input row: doc_id, n_bytes, n_removed, n_spans, spans (maximal
    removed runs, end exclusive) and kept (the remaining bytes). Null texts are empty,
    texts shorter than ``length`` lose nothing, rows that repeat a doc_id never remove
    each other's bytes and get the same result, a null doc_id neither removes nor loses;
    an empty table gives an empty result.
    """
    spark = session(docs.sparkSession)
    parts = partitions(spark)
    slim = docs.select(typed(docs, "doc_id", "bigint"), typed(docs, "text", "string"))
    known = slim.filter("doc_id IS NOT NULL")
    dealt = known.repartition(parts, "doc_id")
    flagged = shared_anchors(known, length, parts)
    # both joins read the same rows and columns of ``dealt``: Spark deals the texts out once and reuses that exchange
    marked = dealt.join(flagged, "doc_id", "left").filter("places IS NOT NULL").select("doc_id", "text", "places")
    removed = sort_segments(segments(marked, length, parts), length, parts).withColumnRenamed("places", "runs")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, spans, kept = [], [], [], []
            for text, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = (text or "").encode()
                left, found = raw, []
                if blob:
                    runs = np.frombuffer(blob, "<i8")
                    start, end = runs >> 32, (runs >> 32) + (runs & 0xFFFFFFFF) + length - 1
                    order = np.argsort(start)
                    start, end = start[order], np.maximum.accumulate(end[order])
                    opens = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
                    closes = np.append(opens[1:], len(start)) - 1
                    cut, at = [], 0
                    for s, e in zip(start[opens].tolist(), end[closes].tolist(), strict=True):
                        cut.append(raw[at:s])
                        found.append({"start": s, "end": e})
                        at = e
                    cut.append(raw[at:])
                    left = b"".join(cut)
                total.append(len(raw))
                gone.append(len(raw) - len(left))
                spans.append(found)
                kept.append(left)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(total, pa.int64()),
                    pa.array(gone, pa.int64()),
                    pa.array([len(s) for s in spans], pa.int64()),
                    pa.array(spans, span),
                    pa.array(kept, pa.binary()),
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"],
            )

    return (
        dealt.join(removed, "doc_id", "left")
        .select("doc_id", "text", "runs")
        .union(slim.filter("doc_id IS NULL").withColumn("runs", F.lit(None).cast("binary")))
        .mapInArrow(
            finish,
            "doc_id long, n_bytes long, n_removed long, n_spans long, "
            "spans array<struct<start:long,end:long>>, kept binary",
        )
    )
