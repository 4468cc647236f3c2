"""Impact of changes: seeds by event type, closure, one reason per variable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippletrace.operators.graph import edges_of, propagate, propagate_auto
from rippletrace.runtime import stored

# Reasons and their precedence; the greatest wins, then the first event.
PRECEDENCE = {
    "MISSING_TRANSFORM_REF": 100,
    "DIRECT_CHANGE_MISSING_INPUT": 90,
    "MISSING_INPUT": 85,
    "DIRECT_CHANGE": 80,
    "TRANSFORM_REMOVED": 75,
    "TRANSFORM_IMPL_CHANGED": 70,
    "TRANSITIVE_DEPENDENCY": 10,
}
REMOVALS = ("SOURCE_REMOVED", "DERIVED_REMOVED", "CONSTRAINT_REMOVED")
DIRECT = ("DERIVED_TRANSFORM_REF_CHANGED", "DERIVED_TRANSFORM_PARAMS_CHANGED", "DERIVED_TYPE_CHANGED", "DERIVED_INPUTS_CHANGED")
CONDUCTED = ("CONSTRAINT_INPUTS_CHANGED", "CONSTRAINT_EXPRESSION_CHANGED")
BY_TRANSFORM = ("TRANSFORM_IMPL_CHANGED", "TRANSFORM_REMOVED")


def precedence(reason: Column) -> Column:
    return F.create_map(*(F.lit(x) for k, v in PRECEDENCE.items() for x in (k, v)))[reason]


def origins(events: DataFrame, elements_v1: DataFrame, elements_v2: DataFrame) -> DataFrame:
    """Where events enter the graph: pair_id, node, event_seq, change_type, reason (of the node itself, or null)."""
    own = events.filter(F.col("change_type").isin(*REMOVALS, *DIRECT, *CONDUCTED)).select(
        "pair_id",
        F.col("element_id").alias("node"),
        "event_seq",
        "change_type",
        F.when(F.col("change_type").isin(*DIRECT), F.lit("DIRECT_CHANGE")).alias("reason"),
    )
    # an input that is neither source nor derived in version 2 (constraints do not count) is missing
    available = elements_v2.filter("kind IN ('source', 'derived')").select("pair_id", F.col("id").alias("src"))
    dangling = (
        edges_of(elements_v2.filter("kind = 'derived'"))
        .join(available, ["pair_id", "src"], "left_anti")
        .select("pair_id", F.col("dst").alias("node"))
        .distinct()
        .withColumn("dangling", F.lit(True))
    )
    own = own.join(dangling, ["pair_id", "node"], "left").select(
        "pair_id",
        "node",
        "event_seq",
        "change_type",
        F.when(
            (F.col("change_type") == "DERIVED_INPUTS_CHANGED") & F.coalesce("dangling", F.lit(False)),
            F.lit("DIRECT_CHANGE_MISSING_INPUT"),
        )
        .otherwise(F.col("reason"))
        .alias("reason"),
    )
    users = elements_v1.filter("kind = 'derived'").select(
        "pair_id", F.col("id").alias("node"), F.col("transform_ref").alias("element_id")
    )
    used = (
        events.filter(F.col("change_type").isin(*BY_TRANSFORM))
        .join(users, ["pair_id", "element_id"])
        .select("pair_id", "node", "event_seq", "change_type", F.col("change_type").alias("reason"))
    )
    return own.unionByName(used)


def impact(
    elements_v1: DataFrame,
    elements_v2: DataFrame,
    events: DataFrame,
    transforms_v2: DataFrame | None = None,
    with_paths: bool = True,
    batch: bool = False,
) -> DataFrame:
    """Impacted derived variables of version 1: pair_id, var_id, reason, event_seq, path, by_change.

    ``events`` are numbered (see :func:`rippletrace.operators.changes.ordered`). A removed
    element's direct dependents lack an input; everything further downstream of an event
    is transitive, by the first event that reaches it and along the shortest, then least
    path. A version-2 variable whose transform is not in the registry overrides all.
    """
    edges = stored(edges_of(elements_v1), "edges")
    derived = elements_v1.filter("kind = 'derived'").select("pair_id", F.col("id").alias("var_id"))
    start = stored(origins(events, elements_v1, elements_v2), "origins")
    itself = start.filter("reason IS NOT NULL").select(
        "pair_id", F.col("node").alias("var_id"), "reason", "event_seq", F.array("node").alias("path")
    )
    lacking = (
        start.filter(F.col("change_type").isin(*REMOVALS))
        .withColumnRenamed("node", "src")
        .join(edges, ["pair_id", "src"])
        .select(
            "pair_id",
            F.col("dst").alias("var_id"),
            F.lit("MISSING_INPUT").alias("reason"),
            "event_seq",
            F.array("src", "dst").alias("path"),
        )
    )
    seeds = start.select("pair_id", "node", F.col("event_seq").alias("seq"))
    # what an event marks itself is no dependent of it: start from the direct dependents
    close = propagate_auto if batch else propagate
    closed = close(edges, seeds, with_paths=with_paths)
    transitive = closed.select(
        "pair_id", F.col("node").alias("var_id"), F.lit("TRANSITIVE_DEPENDENCY").alias("reason"), F.col("seq").alias("event_seq"), "path", "distance"
    )
    entered = start.select("pair_id", F.col("node").alias("var_id")).distinct().withColumn("entered", F.lit(True))
    # a node that an event enters by itself is transitive only if another origin reaches it
    transitive = transitive.join(entered, ["pair_id", "var_id"], "left").filter("entered IS NULL").drop("entered", "distance")
    again = reached_origins(edges, start, closed)
    rows = itself.unionByName(lacking).unionByName(transitive).unionByName(again)
    if transforms_v2 is not None:
        rows = rows.unionByName(missing_refs(elements_v1, elements_v2, transforms_v2))
    best = (
        rows.withColumn("rank", F.struct((-precedence(F.col("reason"))).alias("p"), "event_seq", F.size("path").alias("n"), "path"))
        .groupBy("pair_id", "var_id")
        .agg(
            F.min_by(F.struct("reason", "event_seq", "path"), "rank").alias("best"),
            F.bool_or(F.col("reason") != "MISSING_TRANSFORM_REF").alias("by_change"),
        )
        .select("pair_id", "var_id", "best.*", "by_change")
        .join(derived, ["pair_id", "var_id"], "left_semi")
    )
    return best if with_paths else best.withColumn("path", F.array().cast("array<string>"))


def reached_origins(edges: DataFrame, start: DataFrame, closed: DataFrame) -> DataFrame:
    """Origins without a reason of their own (removed or conducting elements) that another event reaches."""
    silent = start.filter("reason IS NULL").select("pair_id", F.col("node").alias("dst")).distinct()
    return (
        edges.join(silent, ["pair_id", "dst"])
        .join(closed.withColumnRenamed("node", "src"), ["pair_id", "src"])
        .groupBy("pair_id", "dst")
        .agg(F.min(F.struct("seq", F.size("path").alias("n"), F.concat("path", F.array("dst")).alias("path"))).alias("best"))
        .select(
            "pair_id",
            F.col("dst").alias("var_id"),
            F.lit("TRANSITIVE_DEPENDENCY").alias("reason"),
            F.col("best.seq").alias("event_seq"),
            F.col("best.path").alias("path"),
        )
    )


def missing_refs(elements_v1: DataFrame, elements_v2: DataFrame, transforms_v2: DataFrame) -> DataFrame:
    """Version-2 variables, known in version 1, whose transform the registry lacks."""
    known = transforms_v2.select("pair_id", F.col("id").alias("transform_ref"))
    before = elements_v1.filter("kind = 'derived'").select("pair_id", "id")
    return (
        elements_v2.filter("kind = 'derived'")
        .join(known, ["pair_id", "transform_ref"], "left_anti")
        .join(before, ["pair_id", "id"], "left_semi")
        .select(
            "pair_id",
            F.col("id").alias("var_id"),
            F.lit("MISSING_TRANSFORM_REF").alias("reason"),
            F.lit(0).cast("long").alias("event_seq"),
            F.array("id").alias("path"),
        )
    )


def unaffected(elements_v1: DataFrame, impacted: DataFrame) -> DataFrame:
    """Version-1 variables without an impact from changes.

    Variables marked only for a missing transform count as unaffected too, as do removed
    variables that nothing else touches.
    """
    by_change = impacted.filter("by_change").select("pair_id", F.col("var_id").alias("id"))
    return (
        elements_v1.filter("kind = 'derived'")
        .join(by_change, ["pair_id", "id"], "left_anti")
        .select("pair_id", F.col("id").alias("var_id"))
    )


def unresolved(elements_v1: DataFrame, events: DataFrame) -> DataFrame:
    """Version-1 dependents of removed elements and what they lack: pair_id, var_id, missing_ids (sorted)."""
    gone = events.filter(F.col("change_type").isin(*REMOVALS)).select("pair_id", F.col("element_id").alias("src"))
    derived = elements_v1.filter("kind = 'derived'").select("pair_id", F.col("id").alias("dst"))
    return (
        edges_of(elements_v1)
        .join(gone, ["pair_id", "src"])
        .join(derived, ["pair_id", "dst"], "left_semi")
        .groupBy("pair_id", F.col("dst").alias("var_id"))
        .agg(F.array_sort(F.collect_set("src")).alias("missing_ids"))
    )


def transform_ref_errors(elements: DataFrame, transforms: DataFrame, version: int) -> DataFrame:
    """Messages for derived variables whose transform the registry lacks: pair_id, version, element_id, message."""
    known = transforms.select("pair_id", F.col("id").alias("transform_ref"))
    return (
        elements.filter("kind = 'derived'")
        .join(known, ["pair_id", "transform_ref"], "left_anti")
        .select(
            "pair_id",
            F.lit(version).alias("version"),
            F.col("id").alias("element_id"),
            F.format_string("derived variable %s (%s) uses transform %s, which the registry lacks", "id", "name", "transform_ref").alias("message"),
        )
    )
