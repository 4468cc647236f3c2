"""N-gram Jaccard join by parity sketches.

A document's shingles are XOR-hashed into a sketch whose Hamming distance never exceeds
the symmetric difference of two sets. A similarity threshold bounds that difference by
the two sizes, so inside a band of sizes the sketch is cut into more parts than there can
be differences and runs of parts together: in some run similar sets agree on two whole
parts (pigeonhole, twice) and meet by equality of one that is well filled or of both.
Groups of documents that share parts are then compared exactly.

Equal sets are one class from the start (their digest), so copies never form pairs. Groups
too large for one task are split by whole sketches, a fortieth of the text: sets whose
sketches are too far apart part company. What is still large is compared with the middle
of its sketches, set by set; only sets that this leaves apart meet block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippletrace.llm import hashing
from rippletrace.llm.common import chunked, partitions, released, session, stored
from rippletrace.llm.graph import EDGE, EDGE_TYPE, components, forest

CHUNK = 1 << 20
#: A part with fewer shingles says little: by itself, an empty one would join a whole size band. Weak parts
#: count in pairs, formed inside runs of RUN neighbouring parts, so keys stay in proportion to shingles.
WEAK, RUN = 3, 8
#: Shingles and sets of a group that one task compares; larger groups are first refined by whole sketches.
BLOCK, ROWS = 1_500_000, 128
#: Sets of a size band that one task compares by sketches.
SKETCHES = 2048
SKETCH_WORDS = 32

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Shingles:
    """Distinct k-word shingle hashes of a batch's texts: ``hash`` sorted inside each ``row``."""

    def __init__(self, column: pa.Array, k: int) -> None:
        data, offsets = hashing.buffer(column)
        data = LOWER[data]
        starts, ends, first = hashing.words(data, offsets)
        sums = hashing.prefix(hashing.word_hashes(data, starts, ends))
        counts = np.diff(first)
        grams = hashing.grams(sums, k)
        row = np.repeat(np.arange(len(counts)), counts)[: len(grams)]
        fits = np.arange(len(grams)) + k <= first[1:][row]
        values, rows = [grams[fits]], [row[fits]]
        for short in range(1, k):
            at = np.flatnonzero(counts == short)
            if len(at):
                values.append(hashing.mixed(hashing.grams(sums, short)[first[:-1][at]] + np.uint64(short)))
                rows.append(at)
        value, row = np.concatenate(values), np.concatenate(rows)
        order = np.argsort(value)
        order = order[np.argsort(row[order].astype(np.uint16 if len(counts) < 65536 else np.int64), kind="stable")]
        value, row = value[order], row[order]
        fresh = np.ones(len(value), dtype=bool)
        fresh[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        self.hash, self.row = value[fresh], row[fresh]
        self.first = np.searchsorted(self.row, np.arange(len(counts) + 1))
        self.size = np.diff(self.first)

    def sketches(self) -> list[bytes]:
        """Each set's parity sketch of a power of two of bits, at least one a shingle; halves fold into a shorter one."""
        bits = 1 << np.ceil(np.log2(np.maximum(self.size, 64))).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(bits)])
        at = first[self.row] + ((self.hash >> np.uint64(20)).astype(np.int64) & (bits[self.row] - 1))
        odd = np.bincount(at, minlength=first[-1]).astype(np.uint8) & 1
        blob = np.packbits(odd, bitorder="little").tobytes()
        cut = (first >> 3).tolist()
        return [blob[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def digests(self) -> np.ndarray:
        """A 64-bit digest of each row's set; 0 for an empty one."""
        sums = np.zeros(len(self.hash) + 1, dtype=np.uint64)
        np.cumsum(hashing.mixed(self.hash ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
        out = hashing.mixed(sums[self.first[1:]] - sums[self.first[:-1]] + self.size.astype(np.uint64)) | np.uint64(1)
        return np.where(self.size > 0, out, 0).astype(np.int64)


def bands(percent: int, largest: int) -> np.ndarray:
    """Lower bounds of the size bands: two sets that can be similar lie in one band or in neighbouring ones."""
    out = [1]
    while out[-1] <= largest:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out)


def most_different(bounds: np.ndarray, percent: int) -> np.ndarray:
    """For each band as the larger set's: how many shingles two similar sets can differ by at the most."""
    return 2 * (bounds[1:] - 1) * (100 - percent) // (100 + percent)


def parts_of(bounds: np.ndarray, percent: int) -> np.ndarray:
    """For each band as the larger set's: parts to cut a sketch into; 0 where similar sets are equal (by digest).

    There is at least one part more than differences and runs together. Larger bands get
    some more parts, so that hardly any set needs its empty ones (see :func:`part_keys`).
    """
    most = most_different(bounds, percent)
    m = most + 1
    for _ in range(40):  # a contraction: each round adds an eighth of what the last one added
        empty = m * np.exp(-(bounds[1:] - 1) * 0.95 / m)
        spare = np.where(m >= 3 * RUN, np.ceil(empty + 3 * np.sqrt(empty) + 1), 0).astype(np.int64)
        m = np.maximum(m, most + 1 + -(-m // RUN) + spare)
    m = np.maximum(m, most + 1 + -(-m // RUN))
    return np.where(most > 0, m, 0)


def part_keys(s: Shingles, use: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the parts of the used rows' sketches, with each key's row.

    Two similar sets of a band agree on more parts than there are runs, so on two of one
    run; well-filled ones are keys, weak ones form keys in pairs. Where a set has more
    filled parts than differences and runs together, all this holds for filled parts
    alone, and its empty ones say nothing; a similar set agrees on those filled parts.
    """
    bounds = bands(percent, int(s.size.max(initial=1)) * 100 // percent + 1)
    m_of, most = parts_of(bounds, percent), most_different(bounds, percent)
    band = np.searchsorted(bounds, s.size, side="right") - 1
    keys, owners = [], []
    for step in (0, 1):  # as the larger set, or as the smaller one of a set in the next band
        group = np.minimum(band + step, len(m_of) - 1)
        m = np.where(use, m_of[group], 0)
        base = np.concatenate([[0], np.cumsum(m)])
        mine = m[s.row] > 0
        if not mine.any():
            continue
        value, row = s.hash[mine], s.row[mine]
        bits = value % (m[row].astype(np.uint64) * np.uint64(1 << 20))  # bit of the sketch: 2**20 bits a part
        part = base[row] + (bits >> np.uint64(20)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part = part[order]
        token = hashing.mixed(bits[order] + np.uint64(1))
        count = np.bincount(part, minlength=base[-1])
        low = np.concatenate([[0], np.cumsum(count)])
        xors = np.concatenate([[np.uint64(0)], np.bitwise_xor.accumulate(token)])
        sketch = xors[low[1:]] ^ xors[low[:-1]]
        owner = np.repeat(np.arange(len(m)), m)
        number = np.arange(base[-1]) - base[owner]
        strong = count >= WEAK
        key = hashing.mixed(
            sketch + hashing.mixed((group[owner].astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64))
        )
        keys.append(key[strong])
        owners.append(owner[strong])
        filled = np.bincount(owner, weights=count > 0, minlength=len(m))
        enough = filled > most[group] + -(-m // RUN)
        weak = np.flatnonzero(~strong & ((count > 0) | ~enough[owner]))
        run = owner[weak] * np.int64(1 << 32) + number[weak] // RUN
        for apart in range(1, RUN):  # the parts of a run follow one another
            i = np.flatnonzero(run[apart:] == run[:-apart])
            if not len(i):
                break
            keys.append(hashing.mixed(key[weak[i]] * np.uint64(hashing.BASE) + key[weak[i + apart]]))
            owners.append(owner[weak[i]])
    if not keys:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, digest and sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "text", CHUNK):
            s = Shingles(batch.column(1), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s.size.astype(np.int64)), pa.array(s.digests()), pa.array(s.sketches(), pa.binary())],
                names=["doc_id", "n_shingles", "digest", "sketch"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest long, sketch binary")


def shared_parts(docs: DataFrame, k: int, percent: int, parts: int) -> DataFrame:
    """Edges (a, b) between digests of sets that agree on a part; every such pair is connected by them."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "text", CHUNK):
            s = Shingles(batch.column(1), k)
            digest = s.digests()
            use = np.zeros(len(digest), dtype=bool)
            use[np.unique(digest, return_index=True)[1]] = True  # equal sets speak once
            keys, owner = part_keys(s, use & (s.size > 0), percent)
            bucket = ((keys >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(bucket.astype(np.uint16) if parts < 65536 else bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            rows = [
                {"part": int(bucket[g[0]]), "keys": keys[g].tobytes(), "docs": digest[owner[g]].tobytes()}
                for g in (np.split(order, cuts) if len(order) else [])
            ]
            yield pa.RecordBatch.from_pylist(
                rows, schema=pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary())])
            )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list[bytes], list[bytes]] = ([], [])
        for batch in batches:
            held[0].extend(batch.column(1).to_pylist())
            held[1].extend(batch.column(2).to_pylist())
        if not held[0]:
            return
        keys, docs = np.frombuffer(b"".join(held[0]), "<u8"), np.frombuffer(b"".join(held[1]), "<i8")
        order = np.argsort(keys, kind="stable")
        keys, docs = keys[order], docs[order]
        same = keys[1:] == keys[:-1]
        other = same & (docs[1:] != docs[:-1])
        a, b = docs[:-1][other], docs[1:][other]  # a chain connects all that share the key
        if len(a):
            a, b = forest(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=EDGE_TYPE)
        del held, keys, docs, order, same, other
        released()

    packed = docs.mapInArrow(split, "part int, keys binary, docs binary")
    return packed.repartitionById(parts, F.col("part")).mapInArrow(meet, EDGE)


def linked(
    sets: list[np.ndarray], block: list[int], percent: int, cross: bool, label: list[int]
) -> list[tuple[int, int]]:
    """Links that connect the sets exactly as all similar pairs would, those of one label being connected already; between blocks only, if ``cross``."""
    n = len(sets)
    size = np.array([len(x) for x in sets])
    sketch = np.zeros((n, SKETCH_WORDS), dtype=np.uint64)
    for i, x in enumerate(sets):
        bit = (x >> np.uint64(20)) % np.uint64(64 * SKETCH_WORDS)
        odd = np.flatnonzero(np.bincount(bit.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1)
        np.bitwise_or.at(sketch[i], odd >> 6, np.uint64(1) << (odd & 63).astype(np.uint64))
    order = np.argsort(size, kind="stable")
    size, sketch = size[order], sketch[order]
    side = np.array(block)[order]
    root = np.unique(np.array(label), return_inverse=True)[1][order]
    out: list[tuple[int, int]] = []
    for i in range(n):
        to = int(np.searchsorted(size, size[i] * 100 // percent, side="right"))
        if to <= i + 1:
            continue
        apart = np.bitwise_count(sketch[i + 1 : to] ^ sketch[i]).sum(axis=1, dtype=np.int64)
        near = apart * (100 + percent) <= (size[i + 1 : to] + size[i]) * (100 - percent)
        near &= root[i + 1 : to] != root[i]
        if cross:
            near &= side[i + 1 : to] != side[i]
        for j in (np.flatnonzero(near) + i + 1).tolist():
            if root[i] == root[j]:
                continue
            both = len(np.intersect1d(sets[order[i]], sets[order[j]], assume_unique=True))
            if 100 * both >= percent * (size[i] + size[j] - both):
                out.append((int(order[i]), int(order[j])))
                root[root == root[j]] = root[i]
    return out


def alike(size: np.ndarray, sketch: list[bytes], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges that connect sets exactly as all pairs do whose sketches allow similarity; between two sides, if there are two.

    The set nearest to the majority of all sketches goes first: of near copies it is the
    likeliest original, so their edges form a star around it.
    """
    order = np.argsort(size, kind="stable")
    size, side = size[order], side[order]
    sketch = [sketch[i] for i in order.tolist()]
    width = np.array([len(x) // 8 for x in sketch])
    cross = len(np.unique(side)) > 1
    root = np.arange(len(size))
    out: list[tuple[int, int]] = []

    def step(i: int, js: np.ndarray, rows: np.ndarray, start: int) -> None:
        js = js[root[js] != root[i]]
        if cross:
            js = js[side[js] != side[i]]
        if not len(js):
            return
        apart = np.bitwise_count(rows[js - start] ^ rows[i - start]).sum(axis=1, dtype=np.int64)
        js = js[apart * (100 + percent) <= (size[js] + size[i]) * (100 - percent)]
        if len(js):
            found, which = np.unique(root[js], return_index=True)
            out.extend((int(order[i]), int(order[j])) for j in js[which].tolist())
            root[np.isin(root, found)] = root[i]

    widths, many = np.unique(width, return_counts=True)
    for w, n in zip(widths.tolist(), many.tolist(), strict=True):
        start, end = (int(x) for x in np.searchsorted(width, [w, w + 1]))
        stop = int(np.searchsorted(size, size[end - 1] * 100 // percent, side="right"))
        rows = np.empty((stop - start, w), dtype=np.uint64)
        for i in range(start, stop):
            x = np.frombuffer(sketch[i], "<u8")
            rows[i - start] = x if len(x) == w else np.bitwise_xor.reduce(x.reshape(-1, w), axis=0)
        if n == many.max() and n > 2 and not cross:
            ones = np.zeros(64 * w, dtype=np.int64)
            for a in range(0, n, 1024):
                ones += np.unpackbits(rows[a : min(n, a + 1024)].view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
            middle = np.packbits(ones * 2 > n).view(np.uint64)
            i = start + int(np.bitwise_count(rows[:n] ^ middle).sum(axis=1, dtype=np.int64).argmin())
            low, high = np.searchsorted(size, [-(-size[i] * percent // 100), size[i] * 100 // percent + 1])
            step(i, np.arange(max(start, low), min(stop, high)), rows, start)
        for i in range(start, end):
            to = int(np.searchsorted(size, size[i] * 100 // percent, side="right"))
            if to > i + 1:
                step(i, np.arange(i + 1, to), rows, start)
    return out


def sketch_edges(members: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between sets of a component (component, digest, n_shingles, sketch) that their sketches allow to be similar.

    Sets meet by size bands no narrower than the threshold, a band and its neighbour at a
    time, large bands in parts. Rows travel packed by band.
    """
    band = F.floor(F.log("n_shingles") / (1.001 * math.log(100 / percent))).cast("int")
    banded = stored(members.withColumn("band", band), "banded")
    parts = stored(
        banded.groupBy("component", "band").agg(F.ceil(F.count("*") / SKETCHES).cast("int").alias("parts")), "bands"
    )
    dealt = banded.join(parts, ["component", "band"]).withColumn("sub", F.pmod(F.xxhash64("digest"), "parts").cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = pa.Table.from_batches([batch]).group_by(["component", "band", "sub", "parts"], use_threads=False)
                packed = found.aggregate([("digest", "list"), ("n_shingles", "list"), ("sketch", "list")])
                yield from packed.rename_columns(["component", "band", "sub", "parts", "digests", "sizes", "sketches"]).to_batches()

    columns = ["component", "band", "sub", "parts", "digest", "n_shingles", "sketch"]
    packed = dealt.select(*columns).mapInArrow(
        pack, "component long, band int, sub int, parts int, digests array<long>, sizes array<long>, sketches array<binary>"
    )
    nearby = parts.select(
        "component", (F.col("band") - 1).alias("band"), F.col("parts").alias("above")
    ).join(parts.select("component", "band"), ["component", "band"])
    above = packed.join(nearby, ["component", "band"], "left")
    below = parts.select("component", (F.col("band") + 1).alias("band"), F.col("parts").alias("under"))
    placed = above.join(below, ["component", "band"], "left")
    unit = lambda band, low, high: F.struct(band.alias("band"), low.cast("int").alias("low"), high.cast("int").alias("high"))
    own = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda t: unit(F.col("band"), F.least("sub", t), F.greatest("sub", t)),
    )
    none = F.array().cast("array<struct<band:int,low:int,high:int>>")
    # units of two bands carry the upper one's parts as negative numbers
    up = F.when(
        F.col("above").isNotNull(),
        F.transform(F.sequence(F.lit(1), F.col("above")), lambda t: unit(F.col("band"), F.col("sub"), -t)),
    ).otherwise(none)
    down = F.when(
        F.col("under").isNotNull(),
        F.transform(F.sequence(F.lit(0), F.col("under") - 1), lambda t: unit(F.col("band") - 1, t, -F.col("sub") - 1)),
    ).otherwise(none)
    units = placed.select("component", F.explode(F.concat(own, up, down)).alias("u"), "band", "sub", "digests", "sizes", "sketches")
    units = units.select("component", F.col("u.band").alias("at"), "u.low", "u.high", "band", "sub", "digests", "sizes", "sketches")

    def compare(group: pa.Table) -> pa.Table:
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        at = group.column("at")[0].as_py()
        digest, size, sketch, side = [], [], [], []
        for row in group.select(["band", "sub", "digests", "sizes", "sketches"]).to_pylist():
            upper = row["band"] > at if high < 0 else row["sub"] == high and low != high
            digest += row["digests"]
            size += row["sizes"]
            sketch += row["sketches"]
            side += [upper] * len(row["digests"])
        if (high < 0 or low != high) and (all(side) or not any(side)):
            return EDGE_TYPE.empty_table()
        one, first = np.unique(np.array(digest), return_index=True)
        pairs = alike(np.array(size)[first], [sketch[i] for i in first.tolist()], np.array(side)[first], percent)
        return pa.table([pa.array([one[i] for i, _ in pairs], pa.int64()), pa.array([one[j] for _, j in pairs], pa.int64())], schema=EDGE_TYPE)

    return units.groupBy("component", "at", "low", "high").applyInArrow(compare, EDGE)


def sets_of(table: pa.Table, k: int) -> dict[int, np.ndarray]:
    """The shingle set of each digest in a table of digest and text; rows whose text has another digest say nothing."""
    out: dict[int, np.ndarray] = {}
    at, want = table.schema.get_field_index("text"), table.schema.get_field_index("digest")
    for batch in chunked(iter(table.combine_chunks().to_batches()), "text", CHUNK):
        s = Shingles(batch.column(at), k)
        for a, b, own, digest in zip(s.first[:-1], s.first[1:], s.digests().tolist(), batch.column(want).to_pylist(), strict=True):
            if own == digest and digest not in out:
                out[digest] = s.hash[a:b].copy()
    return out


def star_links(edges: DataFrame, bodies: DataFrame, k: int, percent: int) -> DataFrame:
    """The edges (a, b) whose sets are similar, exactly: every set meets its star's center, large stars in parts."""
    parts = stored(edges.groupBy("a").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("parts")), "stars")
    leaf = F.pmod(F.xxhash64("b"), "parts").cast("int")
    leaves = edges.join(parts, "a").select("a", leaf.alias("part"), F.col("b").alias("digest"))
    centers = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("digest"))
    units = leaves.unionByName(centers).join(bodies, "digest")

    def compare(group: pa.Table) -> pa.Table:
        a, sets = group.column("a")[0].as_py(), sets_of(group, k)
        center = sets.pop(a)
        found = []
        for digest, x in sorted(sets.items()):
            both = len(np.intersect1d(center, x, assume_unique=True))
            if 100 * both >= percent * (len(center) + len(x) - both):
                found.append(digest)
        return pa.table([pa.array([a] * len(found), pa.int64()), pa.array(found, pa.int64())], schema=EDGE_TYPE)

    return units.select("a", "part", "digest", "text").groupBy("a", "part").applyInArrow(compare, EDGE)


def unit_blocks(classes: DataFrame, sizes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """digest, label, component, and the unit (i, j) and block of each comparison that a set takes part in.

    A small group is one unit. In a large one the sets of its most frequent label are
    linked already: only the others meet one another and those, block by block.
    """
    named = classes.join(sizes.filter("n > 1"), "component")
    zero = F.lit(0)
    small = named.filter(f"n <= {ROWS} AND shingles <= {BLOCK}").select(
        "digest", F.col("digest").alias("label"), "component", zero.alias("i"), zero.alias("j"), zero.alias("block")
    )
    if labels is None:
        return small
    hot = named.filter(f"n > {ROWS} OR shingles > {BLOCK}").drop("n", "shingles")
    own = stored(
        hot.join(labels, F.col("digest") == F.col("node"), "left").select(
            "digest", "n_shingles", "component", F.coalesce("label", "digest").alias("label")
        ),
        "labels",
    )
    counted = own.groupBy("component", "label").agg(F.count("*").alias("n"))
    most = counted.groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("most"))
    sided = stored(own.join(stored(most, "most"), "component").withColumn("linked", F.col("label") == F.col("most")), "sided")
    blocks = lambda of: F.coalesce(
        F.greatest(F.ceil(F.count_if(of) / ROWS), F.ceil(F.sum(F.when(of, F.col("n_shingles"))) / BLOCK)), zero
    ).cast("int")
    split = sided.groupBy("component").agg(blocks(~F.col("linked")).alias("loose"), blocks(F.col("linked")).alias("tied"))
    spot = lambda n: F.pmod(F.xxhash64("digest"), F.greatest(F.col(n), F.lit(1))).cast("int")
    dealt = (
        sided.join(stored(split.filter("loose > 0"), "split"), "component")
        .withColumn("block", F.when(F.col("linked"), F.col("loose") + spot("tied")).otherwise(spot("loose")))
        .withColumn("to", F.when(F.col("linked"), F.col("loose")).otherwise(F.col("loose") + F.col("tied")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("to") - 1)))
    )
    large = dealt.select(
        "digest", "label", "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block"
    )
    return small.unionByName(large)


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Link texts whose k-word shingle sets have 100 * intersection >= percent * union.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; with fewer than k words the
    whole sequence is the one shingle. Returns one row per input row: doc_id, n_shingles,
    component_id (least doc_id reachable by links). Null or wordless texts have an empty
    set and link with nothing; equal texts share a component; a row without a doc_id is
    linked with nothing but by equality and has the component of its equals (null, if it has
    none with an id); repeated rows are one class; an empty table gives an empty result.
    """
    spark = session(docs.sparkSession)
    parts = partitions(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = stored(shingle_sets(slim, k), "sets")
    groups = stored(components(shared_parts(slim, k, percent, parts), contract=False), "groups")

    # one document of each class in a group
    classes = (
        sets.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"))
        .join(groups, F.col("digest") == F.col("node"))
        .select("doc_id", "digest", "n_shingles", "component")
    )
    classes = stored(classes, "classes")

    def measured(of: DataFrame) -> DataFrame:
        return stored(of.groupBy("component").agg(F.sum("n_shingles").alias("shingles"), F.count("*").alias("n")), "sizes")

    sizes = measured(classes)
    crowded = f"n > {ROWS} OR shingles > {BLOCK}"
    large = sizes.filter(crowded).select("component")
    proven = labels = edges = None
    if not large.isEmpty():
        # a large group's sets that no sketch holds together go their own ways
        members = classes.join(large, "component", "left_semi").join(
            sets.select("doc_id", "digest", "sketch").hint("merge"), ["doc_id", "digest"]
        )
        edges = stored(sketch_edges(members.select("component", "digest", "n_shingles", "sketch"), percent).distinct(), "near")
        finer = stored(components(edges), "finer")
        refined = classes.drop("component").join(finer, F.col("digest") == F.col("node")).select(*classes.columns)
        classes = stored(classes.join(large, "component", "left_anti").unionByName(refined), "classes")
        sizes = measured(classes)
    # the texts of groups leave the table once, the same way at every size: no broadcast of what grows
    grouped = classes.join(sizes.filter("n > 1"), "component", "left_semi").select("doc_id", "digest")
    bodies = stored(slim.join(grouped.hint("merge"), "doc_id").select("digest", "text"), "bodies")
    if edges is not None:
        hot = stored(classes.join(sizes.filter(crowded), "component", "left_semi").select(F.col("digest").alias("a")), "hot")
        if not hot.isEmpty():
            proven = stored(star_links(edges.join(hot, "a", "left_semi"), bodies, k, percent), "proven")
            labels = stored(components(proven).withColumnRenamed("component", "label"), "labels")
    units = bodies.join(unit_blocks(classes, sizes, labels), "digest").select(
        "component", "i", "j", "block", "digest", "label", "text"
    )

    def compare(table: pa.Table) -> pa.Table:
        sets = sets_of(table, k)
        about = dict(zip(table.column("digest").to_pylist(), zip(table.column("block").to_pylist(), table.column("label").to_pylist(), strict=True), strict=True))
        digests = list(sets)
        cross = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        links = linked([sets[d] for d in digests], [about[d][0] for d in digests], percent, cross, [about[d][1] for d in digests])
        return pa.table(
            {
                "a": pa.array([digests[x] for x, _ in links], pa.int64()),
                "b": pa.array([digests[y] for _, y in links], pa.int64()),
            }
        )

    links = units.groupBy("component", "i", "j").applyInArrow(compare, EDGE)
    joined = components(links if proven is None else links.unionByName(proven), contract=False)
    named = sets.select("doc_id", "n_shingles", "digest").join(joined, F.col("digest") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "digest").alias("class")
    )
    least = named.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("component_id"))
    least = stored(least, "least")  # so that the join below has two plain exchanges and a hot class can be split
    return named.join(least, "class", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
