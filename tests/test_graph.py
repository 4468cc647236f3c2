import inspect
import random

import pytest

from rippletrace.operators import graph as G
from rippletrace.operators import lineage


def frame(spark, edges, pair="p"):
    return spark.createDataFrame([(pair, a, b) for a, b in edges], "pair_id string, src string, dst string")


@pytest.mark.parametrize("seed", [1, 2])
def test_both_closures_agree(spark, seed):
    rng = random.Random(seed)
    n = 14
    edges = sorted({(f"n{a:02d}", f"n{b:02d}") for a in range(n) for b in range(a + 1, n) if rng.random() < 0.25})
    seeds = spark.createDataFrame([("p", "n03", 2), ("p", "n00", 5), ("p", "n04", 2)], "pair_id string, node string, seq long")
    one = {tuple(map(str, r)) for r in G.propagate(frame(spark, edges), seeds).collect()}
    two = {tuple(map(str, r)) for r in G.propagate_pairs(frame(spark, edges), seeds).collect()}
    three = {tuple(map(str, r)) for r in G.propagate_auto(frame(spark, edges), seeds, most=1).collect()}
    assert one == two == three


def test_large_pairs_are_told_apart_without_a_shuffle_by_pair(spark):
    most = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(most)
    spark.conf.set(most, "-1")
    try:
        start = spark.createDataFrame([("p", "a", 1)], "pair_id string, node string, seq long")
        plan = G.propagate_auto(frame(spark, [("a", "b"), ("b", "c")]), start, most=1)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(most, before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_closures_have_no_depth_bound(spark):
    for f in (G.reach, G.propagate, G.cyclic_core, G.least_ancestors, lineage.downstream):
        assert "rounds" not in inspect.signature(f).parameters
    edges = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)]  # more levels than tables that are kept apart
    start = spark.createDataFrame([("p", "n00", 1)], "pair_id string, node string, seq long")
    want = {(f"n{i:02d}", i) for i in range(21)}
    assert {(r["node"], r["distance"]) for r in G.reach(frame(spark, edges), start).collect()} == want
    assert {(r["node"], r["distance"]) for r in G.propagate(frame(spark, edges), start).collect()} == want
    assert {(r["node"], r["distance"]) for r in G.propagate_pairs(frame(spark, edges), start).collect()} == want
    flow = [e for i in range(20) for e in ((f"n{i:02d}", f"t{i}", "produces"), (f"t{i}", f"n{i + 1:02d}", "consumes"))]
    flow = spark.createDataFrame([("p", *e) for e in flow], "pair_id string, src string, dst string, kind string")
    below = lineage.downstream(flow, start.select("pair_id", start["node"].alias("id"))).collect()
    assert {(r["id"], r["distance"]) for r in below} == want and max(len(r["path"]) for r in below) == 41


def test_alternative_paths(spark):
    edges = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "d"), ("d", "e")]
    ends = spark.createDataFrame([("p", "a", "d", 1), ("p", "a", "e", 2), ("p", "b", "d", 1)], "pair_id string, start string, node string, distance int")
    got = {(r["start"], r["node"]): r["alternatives"] for r in G.alternative_path_counts(frame(spark, edges), ends).collect()}
    assert got == {("a", "d"): 2, ("a", "e"): 2, ("b", "d"): 0}
    wide = [("a", f"m{i}") for i in range(20)] + [(f"m{i}", "z") for i in range(20)]
    ends = spark.createDataFrame([("p", "a", "z", 2)], "pair_id string, start string, node string, distance int")
    assert G.alternative_path_counts(frame(spark, wide), ends).first()["alternatives"] == 10


def test_cycles(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "e")]
    assert {r["node"] for r in G.cycle_nodes(frame(spark, edges)).collect()} == {"b", "c"}
    knots = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("d", "e"), ("e", "f"), ("f", "g"), ("g", "e"), ("h", "h"), ("c", "x"), ("x", "e")]
    assert {r["node"] for r in G.cycle_nodes(frame(spark, knots)).collect()} == set("abcdefgh")
    assert G.cycle_report(frame(spark, edges)).first()["cycle"] == ["b", "c", "b"]
    assert G.cycle_report(frame(spark, edges[:2])).isEmpty() and G.cycle_nodes(frame(spark, edges[:2])).isEmpty()


def test_reach_and_typed_paths(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c")]
    start = spark.createDataFrame([("p", "a")], "pair_id string, node string")
    assert {(r["node"], r["distance"]) for r in G.reach(frame(spark, edges), start).collect()} == {("a", 0), ("b", 1), ("c", 1)}
    paths = spark.createDataFrame([("p", "c", ["a", "b", "c"]), ("p", "a", ["a"])], "pair_id string, var_id string, path array<string>")
    plain = {r["var_id"]: [tuple(e) for e in r["edges"]] for r in G.path_edges(paths).collect()}
    assert plain == {"c": [("a", "b", "unknown"), ("b", "c", "unknown")], "a": []}
    kinds = spark.createDataFrame([("p", "a", "b", "flow")], "pair_id string, src string, dst string, kind string")
    assert {r["var_id"]: r["edges"] for r in G.path_edges(paths, kinds).collect()}["c"] == []


def test_numbering_spreads_over_partitions(spark):
    from rippletrace.runtime import numbered

    rows = spark.range(0, 500).selectExpr("CASE WHEN id < 400 THEN 'big' ELSE 'small' END AS g", "id * 7 % 500 AS x")
    got = sorted((r["g"], r["n"], r["x"]) for r in numbered(rows, ["g"], ["x"], "n").collect())
    for g in ("big", "small"):
        mine = [(n, x) for a, n, x in got if a == g]
        assert [n for n, _ in mine] == list(range(1, len(mine) + 1)) and [x for _, x in mine] == sorted(x for _, x in mine)
