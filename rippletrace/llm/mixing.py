"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to).
Token capacity then flows pattern -> source on a small network: a pattern offers its
tokens once at cost 0 and again at rising cost, so repetition is convexly priced and
used only where a quota asks for it. The flow says how many tokens each pattern gives;
documents are then picked in a seeded hash order whose cut-off is found by radix
refinement, so no sort or running total ever sees more than a bounded number of bins.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippletrace.llm.common import session, stored

#: Bits that one round of the cut-off search resolves, and rounds.
RADIX_BITS, ROUNDS = 12, 4
#: Fillings after the first cut, and the share of a need that may stay open without one.
FILLS, ENOUGH = 4, 0.002

#: A pattern table of more rows is joined by shuffle instead of being broadcast.
BROADCAST_ROWS = 100_000


def bounded(table: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table that the driver made, if it is small."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quotas(sizes: list[int], weights: list[float], budget: float, most: float) -> list[float]:
    """Split ``budget`` by weight; no share above ``most`` times its size, the excess reshared by weight."""
    shares: list[float] = [0.0] * len(sizes)
    active = set(range(len(sizes)))
    rest = float(budget)
    while active:
        total = sum(weights[i] for i in active)
        over = [i for i in active if rest * weights[i] / total > most * sizes[i]] if total else []
        if not over:
            for i in active:
                shares[i] = rest * weights[i] / total if total else 0.0
            return shares
        for i in over:
            shares[i] = float(most * sizes[i])
        active -= set(over)
        rest -= sum(shares[i] for i in over)
    return shares


class FlowNetwork:
    """Min-cost flow by successive shortest paths; the network has patterns plus sources as nodes."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        """Add an arc and its reverse; the arc's number."""
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def push(self, source: int, sink: int) -> int:
        """Send as much as fits, cheapest first; the amount sent."""
        sent = 0
        while True:
            best = {source: 0}
            via: dict[int, int] = {}
            queue, queued = deque([source]), {source}
            while queue:
                a = queue.popleft()
                queued.discard(a)
                for e in self.out[a]:
                    b, c = self.to[e], best[a] + self.cost[e]
                    if self.room[e] and (b not in best or c < best[b]):
                        best[b], via[b] = c, e
                        if b not in queued:
                            queued.add(b)
                            queue.append(b)
            if sink not in best:
                return sent
            path, at = [], sink
            while at != source:
                path.append(via[at])
                at = self.to[via[at] ^ 1]
            amount = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= amount
                self.room[e ^ 1] += amount
            sent += amount


def route(patterns: list[tuple[tuple[int, ...], int]], targets: list[float], repeats: int) -> list[int]:
    """Tokens that each pattern (member sources, tokens) gives so that sources reach their targets."""
    n, m = len(patterns), len(targets)
    net = FlowNetwork(n + m + 2)
    source, sink = n + m, n + m + 1
    passes: list[list[int]] = []
    for p, (members, tokens) in enumerate(patterns):
        # the k-th use of a token costs k * k: convex, so second uses come last
        passes.append([net.arc(source, p, tokens, k * k) for k in range(repeats)])
        for s in members:
            net.arc(p, n + s, repeats * tokens, 0)
    for s, target in enumerate(targets):
        net.arc(n + s, sink, round(target), 0)
    net.push(source, sink)
    return [sum(net.room[e ^ 1] for e in arcs) for arcs in passes]


def cutoffs(docs: DataFrame, wanted: dict[int, tuple[int, int, int]]) -> dict[int, tuple[int, int]]:
    """For each pattern the rank up to which documents fit, and their tokens.

    ``docs`` has pattern, rank (48 bits) and size; ``wanted`` gives the need, the rank to
    start from and the largest size to look at. Each round sums sizes by the next 12 bits
    of the rank inside the bin that holds the crossing, so a round returns at most 4096
    bins per pattern, whatever the size of the input. A cut at 2**48 means that all fit.
    """
    spark = docs.sparkSession
    top = 1 << (RADIX_BITS * ROUNDS)
    state = {p: (0, 0) for p in wanted}  # the bin's first bits, tokens before it
    done: dict[int, tuple[int, int]] = {}
    for turn in range(ROUNDS):
        shift = RADIX_BITS * (ROUNDS - 1 - turn)
        if not state:
            break
        known = spark.createDataFrame(
            [(p, prefix, *wanted[p][1:]) for p, (prefix, _) in state.items()],
            "pattern int, prefix long, low long, cap long",
        )
        bins = (
            docs.join(bounded(known, len(state)), "pattern")
            .filter(F.shiftright("rank", shift + RADIX_BITS) == F.col("prefix"))
            .filter("rank >= low AND size <= cap AND size > 0")
            .groupBy("pattern", F.shiftright("rank", shift).alias("bin"))
            .agg(F.sum("size").alias("size"))
        )
        listed = bins.groupBy("pattern").agg(F.array_sort(F.collect_list(F.struct("bin", "size"))).alias("bins"))
        found = {row["pattern"]: row["bins"] for row in listed.toLocalIterator()}
        after: dict[int, tuple[int, int]] = {}
        for p, (_, total) in state.items():
            for b, size in found.get(p, ()):
                if total + size > wanted[p][0]:
                    if shift:
                        after[p] = (b, total)
                    else:
                        done[p] = (b, total)
                    break
                total += size
            else:
                done[p] = (top, total)
        state = after
    return done


def choices(docs: DataFrame, needs: dict[int, int]) -> dict[int, list[tuple[int, int, int]]]:
    """Intervals (low, cut, cap): documents of low <= rank < cut and size <= cap together come close to the need.

    Where the next document would exceed the need, later ones that still fit fill the rest.
    """
    chosen: dict[int, list[tuple[int, int, int]]] = {p: [] for p in needs}
    wanted = {p: (need, 0, need) for p, need in needs.items()}
    for _ in range(1 + FILLS):
        after = {}
        for p, (cut, total) in cutoffs(docs, wanted).items():
            need, low, cap = wanted[p]
            chosen[p].append((low, cut, cap))
            rest = need - total
            if cut < 1 << (RADIX_BITS * ROUNDS) and rest > ENOUGH * needs[p]:
                after[p] = (rest, cut + 1, rest)
        wanted = after
        if not wanted:
            break
    return chosen


class Mix:
    """A decided mix: how often documents of each membership pattern are used."""

    def __init__(
        self, docs: DataFrame, sources: Column | None, weights: tuple[float, ...], budget: float, most: int, seed: int
    ) -> None:
        spark = session(docs.sparkSession)
        self.sources, self.seed = sources, seed
        self.sized = stored(
            docs.select("doc_id", self.members(), self.rank(), word_count(F.col("text")).alias("size")), "mix"
        )
        found = self.sized.groupBy("sources").agg(F.sum("size").alias("tokens")).collect()
        names = sorted({s for r in found for s in r["sources"]}, key=lambda s: (s is None, s or ""))
        index = {s: i for i, s in enumerate(names)}
        totals = [0] * len(names)
        for r in found:
            for s in r["sources"]:
                totals[index[s]] += r["tokens"]
        shares = [weights[i % len(weights)] for i in range(len(names))]
        targets = quotas(totals, shares, budget * sum(r["tokens"] for r in found), most)
        patterns = [(tuple(index[s] for s in r["sources"]), r["tokens"]) for r in found]
        gives = route(patterns, targets, most)
        whole = [give // tokens if tokens else 0 for (_, tokens), give in zip(patterns, gives, strict=True)]
        needs = {
            p: give - whole[p] * tokens
            for p, ((_, tokens), give) in enumerate(zip(patterns, gives, strict=True))
            if tokens and give > whole[p] * tokens
        }
        keys = spark.createDataFrame(
            [(r["sources"], p) for p, r in enumerate(found)], "pattern_sources array<string>, pattern int"
        )
        ranked = self.sized.join(bounded(keys, len(found)), F.col("sources").eqNullSafe(F.col("pattern_sources")))
        cuts = choices(ranked.select("pattern", "rank", "size"), needs) if needs else {}
        #: One row per pattern.
        self.patterns = len(found)
        self.table = spark.createDataFrame(
            [
                (r["sources"], whole[p], cuts.get(p, []), totals[patterns[p][0][0]], targets[patterns[p][0][0]])
                for p, r in enumerate(found)
            ],
            "pattern_sources array<string>, uses int, more array<struct<low:long,cut:long,cap:long>>, source_size long, target double",
        )

    def members(self) -> Column:
        given = F.array(F.col("source")) if self.sources is None else self.sources
        listed = F.array_sort(F.array_distinct(given))
        none = F.array(F.lit(None).cast("string"))
        return F.when(F.size(F.coalesce(given, F.array())) > 0, listed).otherwise(none).alias("sources")

    def rank(self) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), F.col("doc_id")), 16).alias("rank")

    def used(self, rows: DataFrame) -> DataFrame:
        """Rows with sources, rank and size, joined to their pattern; times: how often each is used."""
        inside = F.exists(
            "more", lambda i: (F.col("rank") >= i["low"]) & (F.col("rank") < i["cut"]) & (F.col("size") <= i["cap"])
        )
        return rows.join(bounded(self.table, self.patterns), F.col("sources").eqNullSafe(F.col("pattern_sources"))).withColumn(
            "times", F.col("uses") + inside.cast("int")
        )


def mix(
    docs: DataFrame,
    sources: Column | None = None,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    budget: float = 1.5,
    most: int = 2,
    seed: int = 17,
) -> DataFrame:
    """Choose how often each document enters a mix whose sources meet target weights.

    ``sources`` is an array column (default: the one value of ``source``); sources by
    code point, null last, get ``weights`` in turn. They share ``budget`` times all
    tokens; no target exceeds ``most`` times its source's tokens.

    Returns one row per input row: doc_id, sources, size, source_size and target (of the
    first source), taken. Null or empty texts have size 0 and take 0; a document without
    sources counts as source null; repeated rows are chosen alike; an empty table gives
    an empty result. The driver holds one number per source and per pattern, never
    documents.
    """
    decided = Mix(docs, sources, weights, budget, most, seed)
    return decided.used(decided.sized).select(
        "doc_id",
        "sources",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("times")).cast("long").alias("taken"),
    )


def mixed_rows(
    docs: DataFrame,
    sources: Column | None = None,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    budget: float = 1.5,
    most: int = 2,
    seed: int = 17,
) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as :func:`mix` uses it. Moves no texts."""
    decided = Mix(docs, sources, weights, budget, most, seed)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), decided.members(), decided.rank(), word_count(F.col("text")).alias("size"))
    return decided.used(rows).filter("times > 0").select(F.explode(F.array_repeat("row", F.col("times"))).alias("row")).select("row.*")
