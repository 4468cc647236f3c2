"""Best-fit packing of tokenized documents by a grouping genetic algorithm on islands.

Texts are tokenized once into a table of pieces (only lengths and checksums travel on).
Pieces are dealt by hash into shards of bounded size; a shard is an independent packing
problem with the corpus's own length mix. Each shard evolves on several islands: crossover
injects whole well-filled bins of one parent into another, bins that hold the same pieces
are dissolved and the displaced pieces are placed by best fit. After each epoch the elite
of an island migrates to the next one (a shuffle of one small row per island).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from random import Random
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rippletrace.llm.common import chunked, session, stored

#: Mean number of pieces in a shard; islands per shard, epochs, population, most crossovers an epoch; an epoch
#: ends early at the bound (total length over capacity) or after so many crossovers in a row that brought nothing.
SHARD, ISLANDS, EPOCHS, POPULATION, CROSSOVERS, PATIENCE = 8192, 2, 2, 6, 96, 16

# Fixed value: how byte-level tokenizers of this family split a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

CHUNK = 4 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def is_plain(file: dict[str, Any]) -> bool:
    """Whether a tokenizer file is byte-level byte-pair encoding and nothing else, its merges in the order of its ids."""
    split, model = file.get("pre_tokenizer") or {}, file.get("model") or {}
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "fuse_unk")
    if file.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return False
    if model.get("type") != "BPE" or any(model.get(k) for k in odd):
        return False
    pieces = (m.replace(" ", "", 1) if isinstance(m, str) else "".join(m) for m in model["merges"])
    ids = [model["vocab"].get(p, -1) for p in pieces]
    return all(a < b for a, b in zip(ids, ids[1:], strict=False))


def encoder(path: str, pattern: str, special: str = "<|endoftext|>") -> Callable[[str], np.ndarray]:
    """Ids by the byte-level tokenizer file at ``path``, through the faster of two equal encoders.

    The byte-pair ranks are read from the tokenizer's own vocabulary. The file's tokenizer
    itself handles texts that hold one of its special tokens, and all texts if the file says
    anything that the faster encoder would not do alike (see :func:`is_plain`).
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    if not is_plain(file):
        own = Tokenizer.from_file(path)
        return lambda text: np.array(own.encode(text, add_special_tokens=False).ids, dtype="<u4")
    model = file["model"]["vocab"]
    specials = {t["content"] for t in file.get("added_tokens", [])} | {special}
    whole: list[Tokenizer] = []  # loaded only where a text needs it
    # the visible stand-ins that byte-level vocabularies use for the 256 bytes
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    shown = {chr(b): b for b in plain}
    shown |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(shown[c] for c in token): i for token, i in model.items() if token not in specials}
    del file, model
    fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in specials):
            if not whole:
                whole.append(Tokenizer.from_file(path))
            return np.array(whole[0].encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(fast.encode_ordinary(text), dtype="<u4")

    return encode


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, pattern: str = PATTERN
) -> DataFrame:
    """Tokenize each text, append ``end_id`` and cut what exceeds ``capacity``.

    A longer document's first piece takes the remainder, all others are full. Null text
    counts as empty: a document always has at least the end id. Repeated rows give
    repeated pieces.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, pattern)
        for batch in chunked(batches, "text", CHUNK):
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                n = len(ids)
                at, k = 0, 0
                while at < n:
                    size = (n - 1) % capacity + 1 if at == 0 else capacity
                    out.append((doc, k, at, size, zlib.crc32(ids[at : at + size].tobytes())))
                    at, k = at + size, k + 1
            if out:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(v, t)
                        for v, t in zip(
                            zip(*out, strict=True),
                            (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()),
                            strict=True,
                        )
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    session(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


class Bins:
    """A packing under construction: bins by free space, the tightest fit found by a bit mask."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.items: list[list[int]] = []
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def shelve(self, b: int, room: int) -> None:
        self.free[room].append(b)
        self.mask |= 1 << room

    def inject(self, items: list[int], room: int) -> None:
        self.items.append(items)
        if room:
            self.shelve(len(self.items) - 1, room)

    def best_fit(self, item: int, length: int) -> None:
        fits = self.mask >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            shelf = self.free[room]
            b = shelf.pop()
            if not shelf:
                self.mask ^= 1 << room
            self.items[b].append(item)
            if room > length:
                self.shelve(b, room - length)
        else:
            self.items.append([item])
            if length < self.capacity:
                self.shelve(len(self.items) - 1, self.capacity - length)


def fitted(lengths: list[int], order: list[int], capacity: int) -> list[list[int]]:
    """Bins by best fit in the given order."""
    bins = Bins(capacity)
    for i in order:
        bins.best_fit(i, lengths[i])
    return bins.items


def fitness(bins: list[list[int]], lengths: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first; then the more uneven filling, which leaves better bins to inject."""
    return len(bins), -sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(
    giver: list[list[int]], taker: list[list[int]], lengths: list[int], capacity: int, rng: Random
) -> list[list[int]]:
    """The taker with whole well-filled bins of the giver injected and displaced pieces placed by best fit."""
    chosen = [b for b in giver if sum(lengths[i] for i in b) >= 0.995 * capacity and rng.random() < 0.5]
    held = {i for b in chosen for i in b}
    child = Bins(capacity)
    for b in chosen:
        child.inject(list(b), capacity - sum(lengths[i] for i in b))
    loose: list[int] = []
    for b in taker:
        if any(i in held for i in b):
            loose += [i for i in b if i not in held]
        else:
            room = capacity - sum(lengths[i] for i in b)
            if room * 50 > capacity and rng.random() < 0.5:  # badly filled: let its pieces move
                loose += b
            else:
                child.inject(list(b), room)
    loose.sort(key=lambda i: (-lengths[i], i))
    for i in loose:
        child.best_fit(i, lengths[i])
    return child.items


def labels(bins: list[list[int]], n: int) -> bytes:
    out = np.zeros(n, dtype="<i4")
    for b, items in enumerate(bins):
        out[items] = b
    return out.tobytes()


def grouped(blob: bytes) -> list[list[int]]:
    label = np.frombuffer(blob, "<i4")
    order = np.argsort(label, kind="stable")
    cuts = np.flatnonzero(np.diff(label[order])) + 1
    return [g.tolist() for g in np.split(order, cuts)] if len(label) else []


def evolve(
    lengths: list[int], capacity: int, elites: list[bytes], seed: int, population: int, crossovers: int, patience: int = PATIENCE
) -> bytes:
    """One epoch on one island; its best packing as a bin label for each piece."""
    rng = Random(seed)
    n = len(lengths)
    by_size = sorted(range(n), key=lambda i: (-lengths[i], i))
    pool = [grouped(e) for e in elites] or [fitted(lengths, by_size, capacity)]
    while len(pool) < population:
        jitter = {i: lengths[i] * (0.9 + 0.2 * rng.random()) for i in range(n)}
        pool.append(fitted(lengths, sorted(range(n), key=lambda i: (-jitter[i], i)), capacity))
    least = -(-sum(lengths) // capacity)
    scored = sorted(((fitness(p, lengths, capacity), p) for p in pool), key=lambda x: x[0])
    idle = 0
    for _ in range(crossovers):
        if scored[0][0][0] == least or idle >= patience:
            break
        a, b = rng.sample(range(len(scored)), 2) if len(scored) > 1 else (0, 0)
        child = crossover(scored[min(a, b)][1], scored[max(a, b)][1], lengths, capacity, rng)
        fit = fitness(child, lengths, capacity)
        idle = 0 if fit < scored[-1][0] else idle + 1
        scored = sorted([*scored, (fit, child)], key=lambda x: x[0])[:population]
    return labels(scored[0][1], n)


def pack(
    cut: DataFrame,
    capacity: int = 2048,
    shard: int = SHARD,
    islands: int = ISLANDS,
    epochs: int = EPOCHS,
    seed: int = 11,
) -> DataFrame:
    """Assign the pieces of :func:`pieces` to sequences of at most ``capacity`` tokens.

    Adds sequence_id and offset (gapless from 0). Every row is placed once, repeated rows
    too; an empty table gives an empty result. ``cut`` should be a stored table: it is
    read twice.
    """
    spark = session(cut.sparkSession)
    shards = max(1, -(-cut.count() // shard))
    parts = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")) * 4))
    dealt = cut.withColumn(
        "shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "piece", "length"), F.lit(shards)).cast("int")
    )
    # salted by repetition so that many equal rows do not meet in one shard
    same = Window.partitionBy("shard", "doc_id", "piece").orderBy("start")
    dealt = dealt.withColumn("copy", F.row_number().over(same) - 1).withColumn(
        "shard", F.pmod(F.col("shard") + F.col("copy"), F.lit(shards)).cast("int")
    )
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = ["<i8", "<i4", "<i8", "<i8", "<i8"]

    def bundle(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "piece", "length", "copy")])
        row = {"shard": table.column("shard")[:1]}
        for c, kind in zip(names, kinds, strict=True):
            values = table.column(c).combine_chunks()
            row[c] = pa.array([np.asarray(values.fill_null(-(2**63) if c == "doc_id" else 0)).astype(kind).tobytes()])
        return pa.table(row)

    bundles = stored(
        dealt.groupBy("shard").applyInArrow(bundle, "shard int, " + ", ".join(f"{c} binary" for c in names)),
        "shards",
    )

    def epoch(turn: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    lengths = np.frombuffer(row["length"], "<i8").tolist()
                    elites = sorted(set(row["elites"] or []))
                    best = evolve(
                        lengths,
                        capacity,
                        elites,
                        hash((seed, row["shard"], row["island"], turn)),
                        POPULATION,
                        CROSSOVERS,
                    )
                    yield pa.RecordBatch.from_pylist(
                        [{"shard": row["shard"], "island": row["island"], "elite": best}],
                        schema=pa.schema(
                            [("shard", pa.int32()), ("island", pa.int32()), ("elite", pa.binary())]
                        ),
                    )

        return run

    base = bundles.select("shard", "length", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    elite: DataFrame | None = None
    for turn in range(epochs):
        if elite is None:
            entering = base.withColumn("elites", F.array().cast("array<binary>"))
        else:
            moved = elite.select(
                "shard",
                F.explode(
                    F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(islands)).cast("int"))
                ).alias("island"),
                "elite",
            )
            entering = base.join(
                moved.groupBy("shard", "island").agg(F.collect_list("elite").alias("elites")), ["shard", "island"]
            )
        entering = entering.repartition(parts, "shard", "island").select("shard", "island", "length", "elites")
        elite = stored(entering.mapInArrow(epoch(turn), "shard int, island int, elite binary"), "elite")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                columns = {c: np.frombuffer(row[c], k) for c, k in zip(names, kinds, strict=True)}
                lengths = columns["length"].tolist()
                best = min(row["elites"], key=lambda e: (fitness(grouped(e), lengths, capacity), e))
                label = np.frombuffer(best, "<i4").astype(np.int64)
                order = np.argsort(label, kind="stable")
                size = columns["length"][order]
                ends = np.cumsum(size)
                first = np.flatnonzero(np.diff(label[order], prepend=-1))
                base_of = np.repeat(ends[first] - size[first], np.diff(np.append(first, len(order))))
                offset = np.empty(len(order), dtype=np.int64)
                offset[order] = ends - size - base_of
                doc = columns["doc_id"]
                arrays = [pa.array(doc, mask=doc == -(2**63))]
                arrays += [pa.array(columns[c]) for c in names[1:]]
                yield pa.RecordBatch.from_arrays(
                    [*arrays, pa.array(label + (np.int64(row["shard"]) << 32)), pa.array(offset)],
                    names=[*names, "sequence_id", "offset"],
                )

    gathered = elite.groupBy("shard").agg(F.collect_list("elite").alias("elites"))
    return (
        bundles.join(gathered, "shard")
        .select("shard", *names, "elites")
        .mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
    )
