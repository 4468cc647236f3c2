"""Dependency graphs: checks, closure, shortest paths, path counts.

Two ways lead to the same rows. Pairs of ordinary size are each closed inside one task
(:func:`propagate_pairs`); graphs too large for that advance level by level as frames
(:func:`propagate`), each level written to the shared folder.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippletrace.functions.ids import kind_of
from rippletrace.runtime import discard, stored

#: Pairs with more edges than this take the level-by-level way.
PAIR_EDGES = 1_000_000
#: Path counts stop here, and look at walks of this many more edges than the shortest.
MOST_PATHS, MORE_EDGES = 10, 9


#: Rounds of a closure after which the tables of earlier rounds become one.
MERGE_AFTER = 8


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges_of(elements: DataFrame) -> DataFrame:
    """pair_id, src, dst: an edge from each input to its consumer."""
    return elements.select("pair_id", F.explode("inputs").alias("src"), F.col("id").alias("dst"))


def missing_dependencies(elements: DataFrame) -> DataFrame:
    """Inputs that name no element: pair_id, missing_id, users (sorted)."""
    known = elements.select("pair_id", F.col("id").alias("src"))
    return (
        edges_of(elements)
        .join(known, ["pair_id", "src"], "left_anti")
        .groupBy("pair_id", F.col("src").alias("missing_id"))
        .agg(F.array_sort(F.collect_set("dst")).alias("users"))
    )


def direct(edges: DataFrame, of: DataFrame, dependents: bool = True) -> DataFrame:
    """Direct dependents (or dependencies) of the nodes ``of`` (pair_id, node)."""
    here, there = ("src", "dst") if dependents else ("dst", "src")
    return edges.join(of.withColumnRenamed("node", here), ["pair_id", here]).select(
        "pair_id", F.col(here).alias("node"), F.col(there).alias("other")
    )


def reach(edges: DataFrame, seeds: DataFrame, dependents: bool = True) -> DataFrame:
    """Nodes reached from the seeds (pair_id, node) with their least distance; seeds have distance 0.

    Each round expands only nodes not seen before and ends with an empty frontier.
    """
    here, there = ("src", "dst") if dependents else ("dst", "src")
    arcs = edges.select("pair_id", F.col(here).alias("node"), F.col(there).alias("to"))
    seen = stored(seeds.select("pair_id", "node").distinct().withColumn("distance", F.lit(0)), "reach")
    frontier = seen
    parts = [seen]
    for d in count(1):
        step = (
            frontier.select("pair_id", "node")
            .join(arcs, ["pair_id", "node"])
            .select("pair_id", F.col("to").alias("node"))
            .distinct()
            .join(seen.select("pair_id", "node"), ["pair_id", "node"], "left_anti")
            .withColumn("distance", F.lit(d))
        )
        frontier = stored(step, "reach")
        if frontier.isEmpty():
            discard(frontier)
            break
        parts.append(frontier)
        seen = _union(parts)
        if len(parts) > MERGE_AFTER:
            seen = stored(seen, "reach")
            for old in parts[:-1]:
                discard(old)
            parts = [seen]
    return seen


def propagate(edges: DataFrame, seeds: DataFrame, with_paths: bool = True) -> DataFrame:
    """Each reached node's best label: (seq, distance, path), least first.

    ``seeds`` is (pair_id, node, seq). A node takes the least seq that reaches it, then the
    shortest way, then the lexicographically least path; without paths only seq.
    """
    start = F.array("node") if with_paths else F.array().cast("array<string>")
    label = F.struct(F.col("seq"), F.lit(0).alias("distance"), start.alias("path"))
    frontier = stored(seeds.groupBy("pair_id", "node").agg(F.min(label).alias("label")), "labels")
    parts = [frontier]  # each round's improvements; a node's label is the least of its rows
    while True:
        after = F.struct(
            F.col("label.seq").alias("seq"),
            (F.col("label.distance") + 1 if with_paths else F.lit(0)).alias("distance"),
            (F.concat("label.path", F.array("dst")) if with_paths else F.col("label.path")).alias("path"),
        )
        offered = (
            frontier.withColumnRenamed("node", "src")
            .join(edges.select("pair_id", "src", "dst"), ["pair_id", "src"])
            .select("pair_id", F.col("dst").alias("node"), after.alias("label"), F.lit(True).alias("new"))
        )
        known = _union(parts).withColumn("new", F.lit(False))
        # one shuffle brings offers and known labels of a node together
        better = (
            offered.unionByName(known)
            .groupBy("pair_id", "node")
            .agg(F.min(F.when(F.col("new"), F.col("label"))).alias("label"), F.min(F.when(~F.col("new"), F.col("label"))).alias("had"))
            .filter("label IS NOT NULL AND (had IS NULL OR label < had)")
            .drop("had")
        )
        frontier = stored(better, "labels")
        if frontier.isEmpty():
            discard(frontier)
            break
        parts.append(frontier)
        if len(parts) > MERGE_AFTER:
            merged = stored(_union(parts).groupBy("pair_id", "node").agg(F.min("label").alias("label")), "labels")
            for old in parts[:-1]:
                discard(old)
            parts = [merged]
    state = _union(parts).groupBy("pair_id", "node").agg(F.min("label").alias("label"))
    return state.select("pair_id", "node", "label.*")


def propagate_pairs(edges: DataFrame, seeds: DataFrame, with_paths: bool = True) -> DataFrame:
    """As :func:`propagate`, each pair inside one task: for batches of many ordinary pairs."""

    def close(edge: pd.DataFrame, seed: pd.DataFrame) -> pd.DataFrame:
        after: dict[str, list[str]] = defaultdict(list)
        for a, b in zip(edge["src"], edge["dst"], strict=True):
            after[a].append(b)
        label: dict[str, tuple[int, int, tuple[str, ...]]] = {}
        by_seq: dict[int, list[str]] = defaultdict(list)
        for node, seq in zip(seed["node"], seed["seq"], strict=True):
            by_seq[int(seq)].append(node)
        for seq in sorted(by_seq):
            level = {n: (seq, 0, (n,) if with_paths else ()) for n in by_seq[seq] if n not in label}
            label |= level
            while level:
                offered: dict[str, tuple[int, int, tuple[str, ...]]] = {}
                for n, (_, d, path) in level.items():
                    for m in after.get(n, ()):
                        if m not in label:
                            new = (seq, d + 1 if with_paths else 0, (*path, m) if with_paths else ())
                            if m not in offered or new < offered[m]:
                                offered[m] = new
                label |= offered
                level = offered
        pair = seed["pair_id"].iloc[0] if len(seed) else edge["pair_id"].iloc[0]
        return pd.DataFrame(
            [(pair, n, s, d, list(p)) for n, (s, d, p) in label.items()],
            columns=["pair_id", "node", "seq", "distance", "path"],
        )

    return (
        edges.select("pair_id", "src", "dst")
        .groupBy("pair_id")
        .cogroup(seeds.select("pair_id", "node", "seq").groupBy("pair_id"))
        .applyInPandas(close, "pair_id string, node string, seq long, distance int, path array<string>")
    )


def propagate_auto(edges: DataFrame, seeds: DataFrame, with_paths: bool = True, most: int = PAIR_EDGES) -> DataFrame:
    """Ordinary pairs in one task each, the others level by level."""
    sizes = edges.groupBy("pair_id").count()
    large = stored(sizes.filter(F.col("count") > most).select("pair_id"), "large")
    if large.isEmpty():
        return propagate_pairs(edges, seeds, with_paths)
    # one row for each million edges at most: told apart where the edges are, which a shuffle by pair would bring to a few tasks
    large = F.broadcast(large)
    small = propagate_pairs(
        edges.join(large, "pair_id", "left_anti"), seeds.join(large, "pair_id", "left_anti"), with_paths
    )
    big = propagate(edges.join(large, "pair_id"), seeds.join(large, "pair_id"), with_paths=with_paths)
    return small.unionByName(big)


def shortest_paths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """From the least start (pair_id, node) that reaches it, each node's shortest and then lexicographically least path."""
    seeds = starts.select("pair_id", "node").distinct()
    order = seeds.withColumn("seq", F.lit(0).cast("long"))
    return propagate(edges, order).drop("seq")


def alternative_path_counts(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """Further paths between the two ends (pair_id, start, node, distance), at most ten.

    Counts walks of up to nine edges more than the shortest; in an acyclic graph every
    walk is a simple path. One round per edge of length, counts add up per node.
    """
    bounds = ends.select("pair_id", "start", "node", "distance")
    limit = bounds.agg(F.max("distance")).first()[0]
    if limit is None:
        return bounds.select("pair_id", "start", "node", F.lit(0).cast("int").alias("alternatives"))
    # walk backwards from the ends' common starts: (start, at) -> walks of exactly k edges
    level = stored(
        bounds.select("pair_id", "start").distinct().select("pair_id", "start", F.col("start").alias("at"), F.lit(1).cast("long").alias("n")),
        "walks",
    )
    found = None
    for k in range(1, limit + MORE_EDGES + 1):
        step = (
            level.withColumnRenamed("at", "src")
            .join(edges.select("pair_id", "src", "dst"), ["pair_id", "src"])
            .groupBy("pair_id", "start", F.col("dst").alias("at"))
            .agg(F.least(F.sum("n"), F.lit(1 << 40)).alias("n"))
        )
        level = stored(step, "walks")
        if level.isEmpty():
            break
        counted = level.withColumn("k", F.lit(k))
        found = counted if found is None else found.union(counted)
    if found is None:
        return bounds.select("pair_id", "start", "node", F.lit(0).cast("int").alias("alternatives"))
    totals = (
        bounds.join(found.withColumnRenamed("at", "node"), ["pair_id", "start", "node"])
        .filter(F.col("k") <= F.col("distance") + MORE_EDGES)
        .groupBy("pair_id", "start", "node")
        .agg(F.sum("n").alias("n"))
    )
    return bounds.join(totals, ["pair_id", "start", "node"], "left").select(
        "pair_id",
        "start",
        "node",
        F.least(F.greatest(F.coalesce("n", F.lit(1)) - 1, F.lit(0)), F.lit(MOST_PATHS)).cast("int").alias("alternatives"),
    )


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges left after peeling off nodes without a way in or out again and again: empty iff there is no cycle."""
    now = stored(edges.select("pair_id", "src", "dst").distinct(), "peel")
    size = now.count()
    while True:
        into = now.select("pair_id", F.col("dst").alias("src")).distinct()
        out = now.select("pair_id", F.col("src").alias("dst")).distinct()
        after = stored(now.join(into, ["pair_id", "src"], "left_semi").join(out, ["pair_id", "dst"], "left_semi"), "peel")
        left = after.count()
        discard(now)
        now = after
        if left in (0, size):
            break
        size = left
    return now


def least_ancestors(edges: DataFrame) -> DataFrame:
    """For each node the least node that reaches it, itself included: pair_id, node, color."""
    ends = edges.select("pair_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    frontier = stored(ends.withColumn("color", F.col("node")), "colors")
    parts = [frontier]
    while True:
        offered = (
            frontier.withColumnRenamed("node", "src")
            .join(edges, ["pair_id", "src"])
            .select("pair_id", F.col("dst").alias("node"), "color", F.lit(True).alias("new"))
        )
        better = (
            offered.unionByName(_union(parts).withColumn("new", F.lit(False)))
            .groupBy("pair_id", "node")
            .agg(F.min(F.when(F.col("new"), F.col("color"))).alias("color"), F.min(F.when(~F.col("new"), F.col("color"))).alias("had"))
            .filter("color < had")
            .drop("had")
        )
        frontier = stored(better, "colors")
        if frontier.isEmpty():
            break
        parts.append(frontier)
        if len(parts) > MERGE_AFTER:
            parts = [stored(_union(parts).groupBy("pair_id", "node").agg(F.min("color").alias("color")), "colors")]
    return _union(parts).groupBy("pair_id", "node").agg(F.min("color").alias("color"))


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """Nodes that lie on a cycle (pair_id, node).

    Nodes without a way in or out are peeled off; of the rest each node takes its least
    ancestor as its color, and what reaches that ancestor inside the color is a strongly
    connected component. Components go, and the remainder is peeled again: work stays
    proportional to edges and rounds, no pairs of nodes are formed.
    """
    core = cyclic_core(edges)
    found = stored(core.select("pair_id", F.col("src").alias("node")).limit(0), "cycles")
    while not core.isEmpty():
        color = stored(least_ancestors(core), "colors")
        of = lambda end: color.select("pair_id", F.col("node").alias(end), F.col("color").alias(f"{end}_color"))  # noqa: B023, E731
        inner = core.join(of("src"), ["pair_id", "src"]).join(of("dst"), ["pair_id", "dst"]).filter("src_color = dst_color")
        inner = stored(inner.select("pair_id", "src", "dst", F.col("src_color").alias("color")), "inner")
        members = stored(reach(inner, color.filter("node = color"), dependents=False).select("pair_id", "node"), "members")
        # a lone member is on a cycle only by an edge to itself
        inside = inner.join(members.withColumnRenamed("node", "src"), ["pair_id", "src"], "left_semi").join(
            members.withColumnRenamed("node", "dst"), ["pair_id", "dst"], "left_semi"
        )
        found = found.union(inside.select("pair_id", F.col("src").alias("node")).distinct())
        left = core.join(members.withColumnRenamed("node", "src"), ["pair_id", "src"], "left_anti").join(
            members.withColumnRenamed("node", "dst"), ["pair_id", "dst"], "left_anti"
        )
        core = cyclic_core(left)
    return found.distinct()


def cycle_report(edges: DataFrame) -> DataFrame:
    """One cycle per pair, from its least node along least successors: pair_id, cycle (first node again at the end)."""
    core = cyclic_core(edges)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        after = pdf.groupby("src")["dst"].min().to_dict()
        at, seen = min(after), []
        while at not in seen:
            seen.append(at)
            at = after[at]
        cycle = seen[seen.index(at) :]
        cycle = cycle[cycle.index(min(cycle)) :] + cycle[: cycle.index(min(cycle))]
        return pd.DataFrame({"pair_id": [pdf["pair_id"].iloc[0]], "cycle": [[*cycle, cycle[0]]]})

    # one outgoing edge a node is enough: the least
    least = core.groupBy("pair_id", "src").agg(F.min("dst").alias("dst"))
    return least.groupBy("pair_id").applyInPandas(walk, "pair_id string, cycle array<string>")


def typed_nodes(elements: DataFrame) -> DataFrame:
    """pair_id, node and the kind that its id names."""
    return elements.select("pair_id", F.col("id").alias("node"), kind_of(F.col("id")).alias("node_kind"))


def path_edges(paths: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """The hops of paths (pair_id, var_id, path): an array of src, dst, kind.

    Without kinds every hop's kind is ``unknown``; with kinds (pair_id, src, dst, kind) one
    hop without a kind empties the whole path.
    """
    hops = paths.select("pair_id", "var_id", F.posexplode_outer(F.expr("slice(path, 1, greatest(size(path) - 1, 0))")).alias("at", "src"), "path")
    hops = hops.withColumn("dst", F.expr("try_element_at(path, at + 2)"))
    if kinds is None:
        hops = hops.withColumn("kind", F.when(F.col("src").isNotNull(), F.lit("unknown")))
    else:
        hops = hops.join(kinds.select("pair_id", "src", "dst", "kind"), ["pair_id", "src", "dst"], "left")
    some = F.col("src").isNotNull()
    return hops.groupBy("pair_id", "var_id").agg(
        F.when(
            F.bool_and(F.when(some, F.col("kind").isNotNull()).otherwise(True)),
            F.transform(
                F.array_sort(F.collect_list(F.when(some, F.struct("at", "src", "dst", "kind")))),
                lambda h: F.struct(h["src"].alias("src"), h["dst"].alias("dst"), h["kind"].alias("kind")),
            ),
        )
        .otherwise(F.array().cast("array<struct<src:string,dst:string,kind:string>>"))
        .alias("edges")
    )
