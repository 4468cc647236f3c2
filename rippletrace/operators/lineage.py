"""Lineage graphs of steps and tables: validation, differences, downstream impact."""

from __future__ import annotations

from functools import reduce
from itertools import count
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippletrace.operators.graph import MERGE_AFTER, _union
from rippletrace.runtime import discard, stored

SIGNS = ("payload_sha256", "transform_id", "op", "transform_class_id")


def violations(nodes: DataFrame, edges: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """All broken rules of graphs: pair_id, rule (rank), name, element.

    ``nodes`` has pair_id, id, kind (step or table), inputs, outputs, producer, consumers;
    ``edges`` pair_id, src, dst, kind; ``versions`` pair_id, schema_version.
    """
    none = F.array().cast("array<string>")
    full = nodes.select(
        "pair_id", "id", "kind", "producer", *(F.coalesce(c, none).alias(c) for c in ("inputs", "outputs", "consumers"))
    )

    def rule(df: DataFrame, rank: int, name: str, element: Column) -> DataFrame:
        return df.select("pair_id", F.lit(rank).alias("rule"), F.lit(name).alias("name"), element.alias("element"))

    arc = F.concat_ws(">", "src", "dst", "kind")
    ids = full.select("pair_id", F.col("id"), F.col("kind").alias("node_kind"))
    src = ids.select("pair_id", F.col("id").alias("src"), F.col("node_kind").alias("src_kind"))
    dst = ids.select("pair_id", F.col("id").alias("dst"), F.col("node_kind").alias("dst_kind"))
    ended = edges.join(src, ["pair_id", "src"]).join(dst, ["pair_id", "dst"])
    wrong = ~(
        ((F.col("kind") == "produces") & (F.col("src_kind") == "step") & (F.col("dst_kind") == "table"))
        | ((F.col("kind") == "consumes") & (F.col("src_kind") == "table") & (F.col("dst_kind") == "step"))
    )

    def told(kind: str, here: str, there: str, name: str) -> DataFrame:
        return edges.filter(F.col("kind") == kind).groupBy("pair_id", F.col(here).alias("id")).agg(F.array_sort(F.collect_set(there)).alias(name))

    said = (
        full.join(told("consumes", "dst", "src", "in_edges"), ["pair_id", "id"], "left")
        .join(told("produces", "src", "dst", "out_edges"), ["pair_id", "id"], "left")
        .join(told("produces", "dst", "src", "made_by"), ["pair_id", "id"], "left")
        .join(told("consumes", "src", "dst", "used_by"), ["pair_id", "id"], "left")
        .select("pair_id", "id", "kind", "inputs", "outputs", "producer", "consumers", *(F.coalesce(c, none).alias(c) for c in ("in_edges", "out_edges", "made_by", "used_by")))
    )
    differ = lambda a, b: (F.size(F.array_except(a, b)) > 0) | (F.size(F.array_except(b, a)) > 0)
    producer = F.when(F.col("producer").isNull(), none).otherwise(F.array("producer"))
    repeated = lambda c: F.size(F.array_distinct(c)) < F.size(c)
    prefix = F.when(F.col("kind") == "step", "s:").otherwise("t:")
    found = [
        rule(full.groupBy("pair_id", "id").count().filter("count > 1"), 2, "duplicate node", F.col("id")),
        rule(full.filter(~F.col("id").startswith(prefix)), 3, "wrong prefix", F.col("id")),
        rule(full.filter(repeated(F.col("inputs")) | repeated(F.col("outputs")) | repeated(F.col("consumers"))), 4, "repeated list entry", F.col("id")),
        rule(edges.groupBy("pair_id", "src", "dst", "kind").count().filter("count > 1"), 5, "duplicate edge", arc),
        rule(edges.join(src, ["pair_id", "src"], "left_anti"), 6, "unknown edge end", arc),
        rule(edges.join(dst, ["pair_id", "dst"], "left_anti"), 6, "unknown edge end", arc),
        rule(ended.filter(wrong), 7, "edge between wrong kinds", arc),
        rule(said.filter((F.col("kind") == "step") & differ(F.col("inputs"), F.col("in_edges"))), 8, "inputs differ from edges", F.col("id")),
        rule(said.filter((F.col("kind") == "step") & differ(F.col("outputs"), F.col("out_edges"))), 9, "outputs differ from edges", F.col("id")),
        rule(said.filter((F.col("kind") == "table") & differ(producer, F.col("made_by"))), 10, "producer differs from edges", F.col("id")),
        rule(said.filter((F.col("kind") == "table") & differ(F.col("consumers"), F.col("used_by"))), 11, "consumers differ from edges", F.col("id")),
    ]
    if versions is not None:
        found.append(rule(versions.filter("schema_version IS NULL OR schema_version <> 1"), 1, "schema version", F.col("schema_version").cast("string")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def first_violation(found: DataFrame) -> DataFrame:
    """What a reader that stops at the first broken rule reports, per graph."""
    return found.groupBy("pair_id").agg(F.min(F.struct("rule", "element", "name")).alias("v")).select("pair_id", "v.rule", "v.name", "v.element")


def node_changes(a: DataFrame, b: DataFrame, kind: str) -> DataFrame:
    """Ids only on one side: pair_id, kind, id, change (added, removed)."""
    x, y = a.select("pair_id", "id").distinct(), b.select("pair_id", "id").distinct()
    gone = x.join(y, ["pair_id", "id"], "left_anti").withColumn("change", F.lit("removed"))
    come = y.join(x, ["pair_id", "id"], "left_anti").withColumn("change", F.lit("added"))
    return gone.union(come).select("pair_id", F.lit(kind).alias("kind"), "id", "change")


def tables_of(edges: DataFrame) -> DataFrame:
    ends = edges.select("pair_id", F.explode(F.array("src", "dst")).alias("id"))
    return ends.filter(F.col("id").startswith("t:")).distinct()


def changed_steps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Steps on both sides whose payload, transform, operation or class differs: pair_id, id, changed (fields)."""
    joined = a.alias("a").join(b.alias("b"), ["pair_id", "id"])
    fields = F.filter(
        F.array(*(F.when(~F.col(f"a.{s}").eqNullSafe(F.col(f"b.{s}")), F.lit(s)) for s in SIGNS)), lambda x: x.isNotNull()
    )
    return joined.select("pair_id", "id", fields.alias("changed")).filter(F.size("changed") > 0)


def rewired_steps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Steps on both sides with other inputs or outputs, and what came and went."""
    joined = a.alias("a").join(b.alias("b"), ["pair_id", "id"])
    less = lambda x, y, c: F.array_sort(F.array_except(F.col(f"{x}.{c}"), F.col(f"{y}.{c}")))
    out = joined.select(
        "pair_id",
        "id",
        less("b", "a", "inputs").alias("inputs_added"),
        less("a", "b", "inputs").alias("inputs_removed"),
        less("b", "a", "outputs").alias("outputs_added"),
        less("a", "b", "outputs").alias("outputs_removed"),
    )
    return out.filter(" OR ".join(f"size({c}) > 0" for c in out.columns[2:]))


def class_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Classes of steps whose members differ: pair_id, transform_class_id, op, from_steps, to_steps, classification.

    The lists hold every step of the class, also unchanged ones.
    """

    def by_class(df: DataFrame, side: str) -> DataFrame:
        return (
            df.filter("transform_class_id IS NOT NULL")
            .groupBy("pair_id", "transform_class_id", "op")
            .agg(
                F.array_sort(F.collect_list("id")).alias(f"{side}_steps"),
                F.array_sort(F.collect_list("transform_id")).alias(f"{side}_transforms"),
                F.array_sort(F.collect_list("payload_sha256")).alias(f"{side}_payloads"),
            )
        )

    joined = by_class(a, "from").join(by_class(b, "to"), ["pair_id", "transform_class_id", "op"])
    same = (F.col("from_transforms") == F.col("to_transforms")) & (F.col("from_payloads") == F.col("to_payloads"))
    return joined.filter("from_steps <> to_steps").select(
        "pair_id",
        "transform_class_id",
        "op",
        "from_steps",
        "to_steps",
        F.when(same, "rewire_only").otherwise("param_value_change").alias("classification"),
    )


def edge_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges only on one side."""
    key = ["pair_id", "src", "dst", "kind"]
    return (
        a.select(key).distinct().join(b, key, "left_anti").withColumn("change", F.lit("removed"))
        .unionByName(b.select(key).distinct().join(a, key, "left_anti").withColumn("change", F.lit("added")))
    )


def event_log(a: DataFrame, b: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Events: steps added and removed unless their class is paired, changed payloads, replaced classes, rewired steps.

    pair_id, type, transform_class_id, op, step_id, detail; ordered by all of them when written.
    """
    pairs = stored(class_pairs(a, b), "pairs") if pairs is None else pairs
    covered = pairs.select("pair_id", "transform_class_id", "op")

    def alone(x: DataFrame, y: DataFrame, kind: str) -> DataFrame:
        only = x.join(y.select("pair_id", "id"), ["pair_id", "id"], "left_anti")
        free = only.join(covered, ["pair_id", "transform_class_id", "op"], "left_anti")
        return free.select("pair_id", F.lit(kind).alias("type"), "transform_class_id", "op", F.col("id").alias("step_id"), F.lit("{}").alias("detail"))

    of_b = b.select("pair_id", "id", "transform_class_id", "op")
    payload = (
        changed_steps(a, b)
        .join(of_b, ["pair_id", "id"])
        .select("pair_id", F.lit("step_payload_changed").alias("type"), "transform_class_id", "op", F.col("id").alias("step_id"), F.to_json(F.struct("changed")).alias("detail"))
    )
    replaced = pairs.select(
        "pair_id", F.lit("step_replaced_same_class").alias("type"), "transform_class_id", "op", F.lit("").alias("step_id"), F.to_json(F.struct("classification", "from_steps", "to_steps")).alias("detail")
    )
    wired = (
        rewired_steps(a, b)
        .join(of_b, ["pair_id", "id"])
        .select("pair_id", F.lit("step_rewired").alias("type"), "transform_class_id", "op", F.col("id").alias("step_id"), F.to_json(F.struct("inputs_added", "inputs_removed", "outputs_added", "outputs_removed")).alias("detail"))
    )
    out = alone(b, a, "step_added").unionByName(alone(a, b, "step_removed"))
    return out.unionByName(payload).unionByName(replaced).unionByName(wired)


def counts(a: DataFrame, b: DataFrame, edges_a: DataFrame, edges_b: DataFrame) -> DataFrame:
    """Counters of raw differences and of events: pair_id, counter, n.

    Steps meet in one keyed full outer join, edges in another, and every counter is an
    expression over a joined row.
    """
    pairs = stored(class_pairs(a, b), "pairs")
    mark = F.lit(True)
    x = a.withColumn("there", mark).alias("a")
    y = b.withColumn("here", mark).alias("b")
    covered = pairs.select("pair_id", "transform_class_id", "op", F.lit(True).alias("covered"))
    steps = x.join(y, ["pair_id", "id"], "full_outer")
    gone, come, both = F.col("here").isNull(), F.col("there").isNull(), F.col("here") & F.col("there")
    other = lambda c: (F.size(F.array_except(F.col(f"a.{c}"), F.col(f"b.{c}"))) > 0) | (F.size(F.array_except(F.col(f"b.{c}"), F.col(f"a.{c}"))) > 0)
    changed = both & ~reduce(and_, (F.col(f"a.{s}").eqNullSafe(F.col(f"b.{s}")) for s in SIGNS))
    wired = both & (other("inputs") | other("outputs"))
    told = lambda of, *names: [F.when(of, F.lit(n)) for n in names]
    flagged = steps.select(
        "pair_id",
        F.coalesce("b.transform_class_id", "a.transform_class_id").alias("transform_class_id"),
        F.coalesce("b.op", "a.op").alias("op"),
        *(F.coalesce(c, F.lit(False)).alias(n) for c, n in ((gone, "gone"), (come, "come"), (changed, "changed"), (wired, "wired"))),
    ).filter("gone OR come OR changed OR wired")
    free = F.col("covered").isNull()
    of_steps = flagged.join(covered, ["pair_id", "transform_class_id", "op"], "left").select(
        "pair_id",
        F.array(
            *told(F.col("gone"), "raw_step_removed"),
            *told(F.col("come"), "raw_step_added"),
            *told(F.col("changed"), "raw_step_changed", "event_step_payload_changed"),
            *told(F.col("wired"), "raw_step_rewired", "event_step_rewired"),
            *told(F.col("gone") & free, "event_step_removed"),
            *told(F.col("come") & free, "event_step_added"),
        ).alias("c"),
    )

    def one_sided(x: DataFrame, y: DataFrame, name: str) -> DataFrame:
        keys = x.columns
        joined = x.distinct().withColumn("there", mark).join(y.distinct().withColumn("here", mark), keys, "full_outer").filter("there IS NULL OR here IS NULL")
        return joined.select("pair_id", F.array(F.when(F.col("here").isNull(), f"raw_{name}_removed").otherwise(f"raw_{name}_added")).alias("c"))

    arcs = ["pair_id", "src", "dst", "kind"]
    of_pairs = pairs.select("pair_id", F.array(F.concat(F.lit("raw_class_"), "classification"), F.lit("event_step_replaced_same_class")).alias("c"))
    every = of_steps.unionByName(of_pairs).unionByName(one_sided(edges_a.select(arcs), edges_b.select(arcs), "edge"))
    every = every.unionByName(one_sided(tables_of(edges_a), tables_of(edges_b), "table"))
    return every.select("pair_id", F.explode(F.array_compact("c")).alias("counter")).groupBy("pair_id", "counter").agg(F.count("*").alias("n"))


def seeds(a: DataFrame, b: DataFrame) -> DataFrame:
    """Steps of graph B from which changes spread: pair_id, id, reasons (in a fixed order)."""
    pairs = stored(class_pairs(a, b), "pairs")
    changed = changed_steps(a, b).select("pair_id", "id", F.struct(F.lit(1).alias("r"), F.lit("payload_changed").alias("reason")).alias("why"))
    replaced = pairs.select("pair_id", F.explode("to_steps").alias("id"), F.struct(F.lit(2).alias("r"), F.lit("replaced_same_class").alias("reason")).alias("why"))
    added = (
        b.join(a.select("pair_id", "id"), ["pair_id", "id"], "left_anti")
        .join(pairs.select("pair_id", "transform_class_id", "op"), ["pair_id", "transform_class_id", "op"], "left_anti")
        .select("pair_id", "id", F.struct(F.lit(3).alias("r"), F.lit("step_added").alias("reason")).alias("why"))
    )
    wired = rewired_steps(a, b).select("pair_id", "id", F.struct(F.lit(4).alias("r"), F.lit("rewired").alias("reason")).alias("why"))
    every = changed.unionByName(replaced).unionByName(added).unionByName(wired)
    return every.groupBy("pair_id", "id").agg(F.transform(F.array_sort(F.collect_set("why")), lambda w: w["reason"]).alias("reasons"))


def downstream(edges_b: DataFrame, start: DataFrame) -> DataFrame:
    """Steps reached downstream of the seeds in graph B: pair_id, id, distance, parent, via, path.

    Breadth first from steps to the tables that they produce and on to the steps that
    consume those, each half a hop with one row per table or step: a table with many
    producers and consumers never pairs them. A step's parent is the least (step, table)
    one level up; a table entered before leads nowhere new. Seeds have no parent and are
    their own path.
    """
    made = stored(edges_b.filter("kind = 'produces'").select("pair_id", F.col("src").alias("id"), F.col("dst").alias("via")), "made")
    used = stored(edges_b.filter("kind = 'consumes'").select("pair_id", F.col("src").alias("via"), F.col("dst").alias("id")), "used")
    none = F.lit(None).cast("string")
    level = stored(start.select("pair_id", "id", F.lit(0).alias("distance"), none.alias("parent"), none.alias("via"), F.array("id").alias("path")), "level")
    seen, parts = level, [level]
    entered: DataFrame | None = None
    tables: list[DataFrame] = []
    for d in count(1):
        into = made.join(level.select("pair_id", "id", "path"), ["pair_id", "id"])
        if entered is not None:
            into = into.join(entered.select("pair_id", "via"), ["pair_id", "via"], "left_anti")
        half = into.groupBy("pair_id", "via").agg(F.min(F.struct(F.col("id").alias("parent"), "path")).alias("from"))
        half = stored(half.select("pair_id", "via", "from.*"), "half")
        step = (
            used.join(half, ["pair_id", "via"])
            .join(seen.select("pair_id", "id"), ["pair_id", "id"], "left_anti")
            .groupBy("pair_id", "id")
            .agg(F.min(F.struct("parent", "via", "path")).alias("best"))
            .select("pair_id", "id", F.lit(d).alias("distance"), "best.parent", "best.via", F.concat("best.path", F.array("best.via", "id")).alias("path"))
        )
        level = stored(step, "level")
        if level.isEmpty():
            discard(level)
            break
        tables.append(half)
        entered = _union([t.select("pair_id", "via") for t in tables])
        parts.append(level)
        seen = _union(parts)
        if len(parts) > MERGE_AFTER:
            seen, entered = stored(seen, "level"), stored(entered, "half")
            for old in (*parts[:-1], *tables):
                discard(old)
            parts, tables = [seen], [entered]
    return seen


def touched_tables(edges_b: DataFrame, start: DataFrame) -> DataFrame:
    """Tables that the seeds produce."""
    return (
        edges_b.filter("kind = 'produces'")
        .join(start.select("pair_id", F.col("id").alias("src")), ["pair_id", "src"], "left_semi")
        .select("pair_id", F.col("dst").alias("id"))
        .distinct()
    )


def impacted_tables(edges_b: DataFrame, reached: DataFrame) -> DataFrame:
    """Tables that downstream steps, not the seeds, produce."""
    start = reached.filter("distance = 0")
    below = reached.filter("distance > 0").select("pair_id", F.col("id").alias("src"))
    return (
        edges_b.filter("kind = 'produces'")
        .join(below, ["pair_id", "src"], "left_semi")
        .select("pair_id", F.col("dst").alias("id"))
        .distinct()
        .join(touched_tables(edges_b, start), ["pair_id", "id"], "left_anti")
    )


def induced_edges(edges_b: DataFrame, reached: DataFrame) -> DataFrame:
    """Edges between what was reached: its steps and the tables that they produce."""
    steps = reached.select("pair_id", "id").distinct()
    made = edges_b.filter("kind = 'produces'").join(steps.withColumnRenamed("id", "src"), ["pair_id", "src"], "left_semi")
    nodes = steps.union(made.select("pair_id", F.col("dst").alias("id"))).distinct()
    return (
        edges_b.join(nodes.withColumnRenamed("id", "src"), ["pair_id", "src"], "left_semi")
        .join(nodes.withColumnRenamed("id", "dst"), ["pair_id", "dst"], "left_semi")
        .select("pair_id", "src", "dst", "kind")
    )
