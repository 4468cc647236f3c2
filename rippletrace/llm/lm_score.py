"""Masked pseudo-likelihood scores of documents by a bidirectional window network.

Every word of the corpus is counted and has a probability of its own, factored by classes:
the most frequent words are classes of one word, all others share hashed classes. A small
network, trained in numpy on every position, predicts each class from the words on both
sides of it; within its class a word has its share of the class's occurrences in the whole
corpus. Tasks train replicas on their own examples and Spark averages them. A document's
score is the sum of its words' conditional log-probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippletrace.llm import hashing
from rippletrace.llm.common import chunked, partitions, session, stored, typed

#: Classes of one word, hashed classes, words on each side, hidden units.
WORDS, CLASSES, SIDE, HIDDEN = 192, 64, 2, 16
#: One in so many positions is an example in a round, another one in each; rounds; examples in a step; step size.
EVERY, ROUNDS, STEP, RATE = 2, 2, 128, 0.1
CHUNK = 2 << 20
SIZE = WORDS + CLASSES
EDGE = SIZE  # beside the first and last word


def coded(docs: DataFrame, parts: int) -> DataFrame:
    """Texts by chunks: a row of each text (doc_id, its words as places among the chunk's words) and
    rows of the chunk's words by buckets (bucket, hash, n), which follow one another in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in chunked(batches, "text", CHUNK):
            data, offsets = hashing.buffer(batch.column(1))
            starts, ends, first = hashing.words(data, offsets)
            key, place, n = np.unique(hashing.word_hashes(data, starts, ends), return_inverse=True, return_counts=True)
            bucket = (key % np.uint64(parts)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            back = np.empty(len(order), dtype=np.int32)
            back[order] = np.arange(len(order), dtype=np.int32)
            place = back[place]
            key, n, bucket = key[order], n[order], bucket[order]
            own, cut, many = np.unique(bucket, return_index=True, return_counts=True)
            cuts = [*zip(cut, cut + many, strict=True)]
            rows, words = batch.num_rows, len(own)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(rows + words, chunk)),
                    pa.concat_arrays([batch.column(0), pa.nulls(words, pa.int64())]),
                    pa.array([place[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)] + [None] * words, pa.binary()),
                    pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(own, pa.int64())]),
                    pa.array([None] * rows + [key[a:b].tobytes() for a, b in cuts], pa.binary()),
                    pa.array([None] * rows + [n[a:b].tobytes() for a, b in cuts], pa.binary()),
                ],
                names=["chunk", "doc_id", "places", "bucket", "hash", "n"],
            )
            chunk += 1

    return docs.mapInArrow(run, "chunk long, doc_id long, places binary, bucket long, hash binary, n binary")


def word_totals(parts: DataFrame) -> DataFrame:
    """Counts over the whole corpus, by buckets: each chunk's words with their totals; the bucket's most
    frequent words (top, n); the occurrences of each hashed class (class, n)."""
    kind = pa.schema(
        [("chunk", pa.int64()), ("bucket", pa.int64()), ("hash", pa.binary()), ("total", pa.binary()), ("top", pa.int64()), ("class", pa.int64()), ("n", pa.int64())]
    )

    def count(group: pa.Table) -> pa.Table:
        blobs = group.column("hash").to_pylist()
        key, place = np.unique(np.frombuffer(b"".join(blobs), "<u8"), return_inverse=True)
        total = np.zeros(len(key), dtype=np.int64)
        np.add.at(total, place, np.frombuffer(b"".join(group.column("n").to_pylist()), "<i8"))
        top = np.lexsort((key.view(np.int64), -total))[:WORDS]
        classes = np.zeros(CLASSES, dtype=np.int64)
        np.add.at(classes, hashed_class(key) - WORDS, total)
        first = np.concatenate([[0], np.cumsum([len(b) // 8 for b in blobs])])
        found = total[place]
        m = len(blobs)
        return pa.table(
            [
                pa.concat_arrays([group.column("chunk").combine_chunks(), pa.nulls(len(top) + CLASSES, pa.int64())]),
                pa.concat_arrays([group.column("bucket").combine_chunks(), pa.nulls(len(top) + CLASSES, pa.int64())]),
                pa.array(blobs + [None] * (len(top) + CLASSES), pa.binary()),
                pa.array([found[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)] + [None] * (len(top) + CLASSES), pa.binary()),
                pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(key[top].view(np.int64)), pa.nulls(CLASSES, pa.int64())]),
                pa.concat_arrays([pa.nulls(m + len(top), pa.int64()), pa.array(np.arange(CLASSES))]),
                pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(total[top]), pa.array(classes)]),
            ],
            schema=kind,
        )

    return parts.groupBy("bucket").applyInArrow(
        count, "chunk long, bucket long, hash binary, total binary, top long, class long, n long"
    )


def hashed_class(key: np.ndarray) -> np.ndarray:
    return (WORDS + (key >> np.uint64(40)) % np.uint64(CLASSES)).astype(np.int64)


def token_table(texts: DataFrame, totals: DataFrame, frequent: np.ndarray, sizes: np.ndarray) -> DataFrame:
    """doc_id, ids (the class of each word, one byte) and within (summed log-shares of the words in their classes)."""
    order = np.argsort(frequent)
    keys = frequent[order]

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        if words.num_rows:
            words = words.sort_by("bucket")
        key = np.frombuffer(b"".join(words.column("hash").to_pylist()), "<u8")
        total = np.frombuffer(b"".join(words.column("total").to_pylist()), "<i8")
        at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
        own = keys[at] == key if len(keys) else np.zeros(len(key), dtype=bool)
        rest = hashed_class(key)
        token = np.where(own, order[at] if len(keys) else 0, rest).astype(np.uint8)
        share = np.where(own, 0.0, np.log(total / np.maximum(sizes[rest - WORDS], 1)))
        ids, within = [], []
        for blob in texts.column("places").to_pylist():
            place = np.frombuffer(blob, "<i4")
            ids.append(token[place].tobytes())
            within.append(float(share[place].sum()))
        return pa.table({"doc_id": texts.column("doc_id"), "ids": pa.array(ids, pa.binary()), "within": pa.array(within, pa.float64())})

    return texts.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(run, "doc_id long, ids binary, within double")


class Network:
    """One hidden layer over the summed tables of the neighbours at each offset, softmax over all tokens."""

    def __init__(self, flat: np.ndarray | None = None, seed: int = 5) -> None:
        shapes = [(2 * SIDE, SIZE + 1, HIDDEN), (HIDDEN,), (HIDDEN, SIZE), (SIZE,)]
        sizes = [int(np.prod(s)) for s in shapes]
        if flat is None:
            flat = np.random.default_rng(seed).standard_normal(sum(sizes)).astype(np.float32) * np.float32(0.1)
        self.flat = flat.astype(np.float32).copy()
        views, at = [], 0
        for shape, n in zip(shapes, sizes, strict=True):
            views.append(self.flat[at : at + n].reshape(shape))
            at += n
        self.tables, self.bias, self.out, self.prior = views

    def hidden(self, context: np.ndarray) -> np.ndarray:
        h = self.tables[0][context[0]] + self.bias
        for o in range(1, 2 * SIDE):
            h += self.tables[o][context[o]]
        return np.tanh(h)

    def log_probability(self, context: np.ndarray, token: np.ndarray, block: int = 1024) -> np.ndarray:
        """Of each token given its neighbours."""
        out = np.empty(len(token), dtype=np.float64)
        ones = np.ones(SIZE, dtype=np.float32)
        every = np.arange(block)
        for a in range(0, len(token), block):
            b = min(len(token), a + block)
            logit = self.hidden(context[:, a:b]) @ self.out
            logit += self.prior
            right = logit[every[: b - a], token[a:b]].astype(np.float64)
            np.exp(logit, out=logit)
            out[a:b] = right - np.log((logit @ ones).astype(np.float64))
        return out

    def learn(self, context: np.ndarray, token: np.ndarray, squares: np.ndarray) -> None:
        """One step of AdaGrad on a few examples."""
        n = len(token)
        h = self.hidden(context)
        logit = h @ self.out + self.prior
        np.exp(np.minimum(logit, 60), out=logit)
        logit /= logit.sum(axis=1, keepdims=True)
        logit[np.arange(n), token] -= 1
        logit /= n
        below = (logit @ self.out.T) * (1 - h * h)
        step = np.zeros_like(self.flat)
        g = Network.__new__(Network)
        g.flat = step
        at = 0
        for name, like in (("tables", self.tables), ("bias", self.bias), ("out", self.out), ("prior", self.prior)):
            setattr(g, name, step[at : at + like.size].reshape(like.shape))
            at += like.size
        spot = (context + np.arange(2 * SIDE)[:, None] * (SIZE + 1))[:, :, None] * HIDDEN + np.arange(HIDDEN)
        g.tables += np.bincount(
            spot.ravel(), np.broadcast_to(below, spot.shape).ravel(), self.tables.size
        ).reshape(self.tables.shape)
        g.bias += below.sum(axis=0)
        g.out += h.T @ logit
        g.prior += logit.sum(axis=0)
        squares += step * step
        self.flat -= np.float32(RATE) * step / (np.sqrt(squares) + np.float32(1e-4))
        np.clip(self.flat, -8, 8, out=self.flat)


def neighbours(ids: np.ndarray, first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Tokens at each offset from the given positions; the edge where a row ends before."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    padded = np.full(len(ids) + SIDE * len(first), EDGE, dtype=np.int64)  # edges before, between and after the rows
    spot = np.arange(len(ids)) + (row + 1) * SIDE
    padded[spot] = ids
    spot = spot[at]
    return np.stack([padded[spot + o] for o in (*range(-SIDE, 0), *range(1, SIDE + 1))])


def joined_ids(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, blobs), dtype=np.int64, count=len(blobs)))])
    return np.frombuffer(b"".join(blobs), np.uint8).astype(np.int64), first


def examples(docs: np.ndarray, first: np.ndarray, turn: int, every: int) -> np.ndarray:
    """Positions that train in a round; the rounds of ``every`` successive turns take each position once."""
    n = np.diff(first)
    places = (np.arange(first[-1]) - np.repeat(first[:-1], n)).astype(np.uint64)
    pick = hashing.mixed(np.repeat(docs, n).view(np.uint64) * np.uint64(hashing.BASE) + places) % np.uint64(every)
    return np.flatnonzero(pick == turn % every)


def train(tokens: DataFrame, rounds: int = ROUNDS, every: int = EVERY) -> np.ndarray:
    """Weights averaged over the replicas that tasks train on one in ``every`` positions of all documents a round."""
    spark = tokens.sparkSession
    flat = Network().flat
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(flat)  # 21 000 numbers

        def replica(
            batches: Iterator[pa.RecordBatch], sent=sent, turn=turn  # noqa: ANN001
        ) -> Iterator[pa.RecordBatch]:
            net, squares, seen = Network(sent.value), np.zeros_like(sent.value), 0
            for batch in batches:
                docs, blobs = np.asarray(batch.column(0).fill_null(0)), batch.column(1).to_pylist()
                for start in range(0, len(blobs), 256):
                    ids, first = joined_ids(blobs[start : start + 256])
                    at = examples(docs[start : start + 256], first, turn, every)
                    at = np.random.default_rng(turn).permutation(at)
                    context, token = neighbours(ids, first, at), ids[at]
                    for a in range(0, len(at), STEP):
                        net.learn(context[:, a : a + STEP], token[a : a + STEP], squares)
                    seen += len(at)
            if seen:
                yield pa.RecordBatch.from_pydict({"n": pa.array([seen]), "flat": pa.array([net.flat.tobytes()])})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(0), 0
            for batch in batches:
                for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    total = (total if n else 0) + np.frombuffer(blob, np.float32).astype(np.float64) * k
                    n += k
            if n:
                yield pa.RecordBatch.from_pydict(
                    {"n": pa.array([n]), "flat": pa.array([(total / n).astype(np.float32).tobytes()])}
                )

        replicas = tokens.select("doc_id", "ids").mapInArrow(replica, "n long, flat binary")
        middle = max(1, int(partitions(spark) ** 0.5))  # a tree: the driver gets few sums, whatever the number of tasks
        sums = replicas.repartition(middle).mapInArrow(add, "n long, flat binary").collect()
        if sums:
            total = sum(r["n"] for r in sums)
            flat = sum(
                np.frombuffer(bytes(r["flat"]), np.float32).astype(np.float64) * (r["n"] / total) for r in sums
            ).astype(np.float32)
    return flat


def scored(docs: DataFrame) -> DataFrame:
    """Score every whole text: doc_id, n_tokens, log_likelihood (summed), score (its mean per token).

    Null and wordless texts have n_tokens 0, log_likelihood 0 and a null score; a null
    doc_id is scored like any other; repeated rows get equal scores; an empty table gives
    an empty result.
    """
    spark = session(docs.sparkSession)
    slim = docs.select(typed(docs, "doc_id", "bigint"), typed(docs, "text", "string"))
    code = stored(coded(slim, partitions(spark)), "coded")
    totals = stored(word_totals(code.filter("bucket IS NOT NULL").select("chunk", "bucket", "hash", "n")), "totals")
    top = totals.filter("top IS NOT NULL").orderBy(F.desc("n"), "top").limit(WORDS).collect()
    frequent = np.array([r["top"] for r in top], dtype=np.int64).view(np.uint64)
    sizes = np.zeros(CLASSES, dtype=np.int64)
    for r in totals.filter("class IS NOT NULL").groupBy("class").agg(F.sum("n").alias("n")).collect():
        sizes[r["class"]] = r["n"]
    np.subtract.at(sizes, hashed_class(frequent) - WORDS, np.array([r["n"] for r in top], dtype=np.int64))
    tokens = stored(
        token_table(
            code.filter("places IS NOT NULL").select("chunk", "doc_id", "places"),
            totals.filter("chunk IS NOT NULL").select("chunk", "bucket", "hash", "total"),
            frequent,
            sizes,
        ),
        "tokens",
    )
    sent = spark.sparkContext.broadcast(train(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(sent.value)
        for batch in batches:
            total, count = np.asarray(batch.column(2)).copy(), np.zeros(batch.num_rows, dtype=np.int64)
            blobs = batch.column(1).to_pylist()
            for a in range(0, len(blobs), 64):
                ids, first = joined_ids(blobs[a : a + 64])
                n = np.diff(first)
                count[a : a + 64] = n
                log = net.log_probability(neighbours(ids, first, np.arange(len(ids))), ids)
                sums = np.concatenate([[0.0], np.cumsum(log)])
                total[a : a + 64] += sums[first[1:]] - sums[first[:-1]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(count),
                    pa.array(total),
                    pa.array(total / np.maximum(count, 1), mask=count == 0),
                ],
                names=["doc_id", "n_tokens", "log_likelihood", "score"],
            )

    return tokens.mapInArrow(run, "doc_id long, n_tokens long, log_likelihood double, score double")
