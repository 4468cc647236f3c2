"""Change detection: keyed full outer joins of two versions, one row per change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippletrace.functions.ids import json_list
from rippletrace.runtime import numbered

# The order of change types of one element in an event log.
PRIORITY = {
    "SOURCE_REMOVED": 10,
    "SOURCE_ADDED": 20,
    "SOURCE_RENAMED": 30,
    "DERIVED_REMOVED": 10,
    "DERIVED_ADDED": 20,
    "DERIVED_RENAMED": 30,
    "DERIVED_TRANSFORM_REF_CHANGED": 40,
    "DERIVED_TRANSFORM_PARAMS_CHANGED": 50,
    "DERIVED_TYPE_CHANGED": 60,
    "DERIVED_INPUTS_CHANGED": 70,
    "CONSTRAINT_REMOVED": 10,
    "CONSTRAINT_ADDED": 20,
    "CONSTRAINT_RENAMED": 30,
    "CONSTRAINT_INPUTS_CHANGED": 40,
    "CONSTRAINT_EXPRESSION_CHANGED": 50,
    "TRANSFORM_REMOVED": 10,
    "TRANSFORM_ADDED": 20,
    "TRANSFORM_IMPL_CHANGED": 30,
}

EVENT_TYPE = "struct<change_type:string,old_value:string,new_value:string,details:string>"


def id_sets(elements: DataFrame) -> DataFrame:
    """The ids of each kind: pair_id, kind, ids (sorted)."""
    return elements.groupBy("pair_id", "kind").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def lookup(elements: DataFrame, keys: DataFrame, position: str | None = None) -> DataFrame:
    """The elements that keys (pair_id, id) name; of repeated ids the first by position, else by name."""
    order = [F.col(position)] if position else [F.col("kind"), F.col("name")]
    first = Window.partitionBy("pair_id", "id").orderBy(*order)
    found = elements.join(keys.select("pair_id", "id").distinct(), ["pair_id", "id"], "left_semi")
    return found.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def event(
    condition: Column, change_type: Column | str, old: Column | None = None, new: Column | None = None, details: Column | None = None
) -> Column:
    """An event struct where the condition holds, else null."""
    none = F.lit(None).cast("string")
    kind = F.lit(change_type) if isinstance(change_type, str) else change_type
    return F.when(
        condition,
        F.struct(
            kind.alias("change_type"),
            (none if old is None else old).cast("string").alias("old_value"),
            (none if new is None else new).cast("string").alias("new_value"),
            (none if details is None else details).cast("string").alias("details"),
        ),
    )


def inlined(joined: DataFrame, found: list[Column], keys: list[Column]) -> DataFrame:
    """One row per event that is not null."""
    events = F.filter(F.array(*found), lambda e: e.isNotNull())
    return joined.select(*keys, F.explode(events).alias("e")).select(*(k for k in joined.select(*keys).columns), "e.*")


def spec_changes(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """Changes between two versions' elements: pair_id, change_type, element_id, old_value, new_value, details.

    A renamed, retyped or rewired element gives one event for each; a changed transform
    hides a change of its parameters; a source's type may change silently.
    """
    a, b = v1.alias("a"), v2.alias("b")
    joined = a.join(b, ["pair_id", "kind", "id"], "full_outer")
    old, new = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    there = old("name").isNotNull() | old("type").isNotNull() | old("inputs").isNotNull() | old("transform_ref").isNotNull()
    here = new("name").isNotNull() | new("type").isNotNull() | new("inputs").isNotNull() | new("transform_ref").isNotNull()
    both = there & here
    upper = F.upper("kind")
    derived, constraint = F.col("kind") == "derived", F.col("kind") == "constraint"
    differ = lambda c: ~old(c).eqNullSafe(new(c))
    no_inputs = F.array().cast("array<string>")
    before, after = F.coalesce(old("inputs"), no_inputs), F.coalesce(new("inputs"), no_inputs)
    found = [
        event(there & ~here, F.concat(upper, F.lit("_REMOVED")), old=old("name")),
        event(~there & here, F.concat(upper, F.lit("_ADDED")), new=new("name")),
        event(both & differ("name"), F.concat(upper, F.lit("_RENAMED")), old("name"), new("name")),
        event(both & derived & differ("transform_ref"), "DERIVED_TRANSFORM_REF_CHANGED", old("transform_ref"), new("transform_ref")),
        event(
            both & derived & ~differ("transform_ref") & differ("params_hash"),
            "DERIVED_TRANSFORM_PARAMS_CHANGED",
            old("params_hash"),
            new("params_hash"),
            F.to_json(F.struct(new("transform_ref").alias("transform_ref"))),
        ),
        event(both & derived & differ("type"), "DERIVED_TYPE_CHANGED", old("type"), new("type")),
        event(
            both & (derived | constraint) & ~before.eqNullSafe(after),
            F.concat(upper, F.lit("_INPUTS_CHANGED")),
            json_list(before),
            json_list(after),
            F.to_json(F.struct(before.alias("old_inputs"), after.alias("new_inputs"))),
        ),
        event(
            both & constraint & differ("expression"),
            "CONSTRAINT_EXPRESSION_CHANGED",
            F.coalesce(old("expression"), F.lit("")),
            F.coalesce(new("expression"), F.lit("")),
        ),
    ]
    return inlined(joined, found, [F.col("pair_id"), F.col("id").alias("element_id")])


def registry_changes(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """Transforms added, removed or with another implementation digest; other fields alone change nothing."""
    a, b = v1.alias("a"), v2.alias("b")
    joined = a.join(b, ["pair_id", "id"], "full_outer")
    there, here = F.col("a.digest").isNotNull(), F.col("b.digest").isNotNull()
    details = F.to_json(
        F.struct(
            F.col("a.source").alias("old_source"),
            F.col("b.source").alias("new_source"),
            F.col("a.ref").alias("old_ref"),
            F.col("b.ref").alias("new_ref"),
            F.col("a.version").alias("old_version"),
            F.col("b.version").alias("new_version"),
        )
    )
    found = [
        event(there & ~here, "TRANSFORM_REMOVED", old=F.col("a.version")),
        event(~there & here, "TRANSFORM_ADDED", new=F.col("b.version")),
        event(
            there & here & (F.col("a.digest") != F.col("b.digest")),
            "TRANSFORM_IMPL_CHANGED",
            F.col("a.digest"),
            F.col("b.digest"),
            details,
        ),
    ]
    return inlined(joined, found, [F.col("pair_id"), F.col("id").alias("element_id")])


def event_priority(change_type: Column) -> Column:
    table = F.create_map(*(F.lit(x) for k, v in PRIORITY.items() for x in (k, v)))
    return F.coalesce(table[change_type], F.lit(999))


def ordered(events: DataFrame) -> DataFrame:
    """Number the events of each pair: by element, priority of the type, type, old and new value."""
    ranked = events.withColumns(
        {
            "_priority": event_priority(F.col("change_type")),
            "_old": F.coalesce("old_value", F.lit("")),
            "_new": F.coalesce("new_value", F.lit("")),
        }
    )
    return numbered(
        ranked, ["pair_id"], ["element_id", "_priority", "change_type", "_old", "_new"], "event_seq"
    ).drop("_priority", "_old", "_new")


def change_summary(events: DataFrame) -> DataFrame:
    """Number of events of each type."""
    return events.groupBy("pair_id", "change_type").agg(F.count("*").alias("n"))


def type_spans(events: DataFrame) -> DataFrame:
    """The number of events of each type, its first and its last element; no row holds a type's events."""
    return events.groupBy("pair_id", "change_type").agg(
        F.count("*").alias("n"), F.min("element_id").alias("first_id"), F.max("element_id").alias("last_id")
    )


def by_type(events: DataFrame) -> DataFrame:
    """The events of each type together, in element order; for rendering small results."""
    return events.groupBy("pair_id", "change_type").agg(
        F.array_sort(F.collect_list(F.struct("element_id", "old_value", "new_value", "details"))).alias("events")
    )


def binding_changes(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """BINDING_REMOVED, _ADDED, _CHANGED by raw column, RAW_COLUMN_RENAMED by source id.

    Where several raw columns bind one source, the last (by position, then name) stands for it.
    """
    a, b = v1.alias("a"), v2.alias("b")
    by_column = a.join(b, ["pair_id", "raw_column"], "full_outer")
    old, new = F.col("a.source_id"), F.col("b.source_id")
    found = [
        event(old.isNotNull() & new.isNull(), "BINDING_REMOVED", old=old),
        event(old.isNull() & new.isNotNull(), "BINDING_ADDED", new=new),
        event(old != new, "BINDING_CHANGED", old, new),
    ]
    rows = inlined(by_column, found, [F.col("pair_id"), F.col("raw_column").alias("element_id")])

    def last(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("pair_id", "source_id").agg(
            F.max(F.struct("position", "raw_column"))["raw_column"].alias(name)
        )

    renamed = (
        last(v1, "old_value")
        .join(last(v2, "new_value"), ["pair_id", "source_id"])
        .filter("old_value <> new_value")
        .select(
            "pair_id",
            F.col("source_id").alias("element_id"),
            F.lit("RAW_COLUMN_RENAMED").alias("change_type"),
            "old_value",
            "new_value",
            F.lit(None).cast("string").alias("details"),
        )
    )
    return rows.unionByName(renamed)


def column_changes(v1: DataFrame, v2: DataFrame, owner: str = "table") -> DataFrame:
    """Columns added, removed or retyped by owner (table or data source): (pair_id, owner, column, type) tables."""
    a, b = v1.alias("a"), v2.alias("b")
    joined = a.join(b, ["pair_id", owner, "column"], "full_outer")
    old, new = F.col("a.type"), F.col("b.type")
    found = [
        event(old.isNotNull() & new.isNull(), "COLUMN_REMOVED", old=old),
        event(old.isNull() & new.isNotNull(), "COLUMN_ADDED", new=new),
        event(old != new, "COLUMN_TYPE_CHANGED", old, new),
    ]
    return inlined(joined, found, [F.col("pair_id"), F.col(owner), F.col("column")]).drop("details")


def column_sections(changes: DataFrame, owner: str = "table") -> DataFrame:
    """Per owner the sorted added, removed and retyped columns, as a report shows them."""
    pick = lambda kind, what: F.array_sort(F.collect_list(F.when(F.col("change_type") == kind, what)))
    retyped = F.concat(F.col("column"), F.lit(": "), F.col("old_value"), F.lit(" -> "), F.col("new_value"))
    return changes.groupBy("pair_id", owner).agg(
        pick("COLUMN_ADDED", F.col("column")).alias("added"),
        pick("COLUMN_REMOVED", F.col("column")).alias("removed"),
        pick("COLUMN_TYPE_CHANGED", retyped).alias("type_changed"),
    )
