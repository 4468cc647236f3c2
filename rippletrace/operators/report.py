"""Witnesses, indexes, summaries and reports of a comparison."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rippletrace.functions.canon import digest, short_digest

# Versions and caps of the detailed report.
SCHEMA_VERSION, CONTRACT_VERSION, POLICY = "0.1", "1", "rippletrace.canonical-json.v1"
CAPS = {"max_witnesses": 100_000, "max_root_causes_per_node": 16, "max_trigger_events_per_node": 16, "max_top_roots": 50}
OWN = ("DIRECT_CHANGE", "DIRECT_CHANGE_MISSING_INPUT", "TRANSFORM_IMPL_CHANGED", "TRANSFORM_REMOVED", "MISSING_TRANSFORM_REF")
BY_BINDING = ("MISSING_BINDING", "AMBIGUOUS_BINDING")
NO_IDS = "array<string>"


def event_dict(change_type: str, element_id: str, old: Any, new: Any, details: Any) -> dict[str, Any]:
    return {
        "change_type": change_type,
        "element_id": element_id,
        "old_value": old,
        "new_value": new,
        "details": json.loads(details) if isinstance(details, str) else details,
    }


@F.pandas_udf(StringType())
def event_id(kind: pd.Series, element: pd.Series, old: pd.Series, new: pd.Series, details: pd.Series) -> pd.Series:
    """Short content id of an event."""
    rows = zip(kind, element, old, new, details, strict=True)
    return pd.Series([f"evt:{short_digest(event_dict(*(None if x is None or x != x else x for x in r)))}" for r in rows], dtype=object)


@F.pandas_udf(StringType())
def issue_id(kind: pd.Series, element: pd.Series, affected: pd.Series) -> pd.Series:
    """Short content id of an issue."""

    def one(k: str, e: str, a: str) -> str:
        other = "transform_ref" if k == "MISSING_TRANSFORM_REF" else "source_id"
        return f"iss:{short_digest({'issue_type': k, 'element_id': e, 'details': {'affected_id': a, other: e}})}"

    return pd.Series([one(*r) for r in zip(kind, element, affected, strict=True)], dtype=object)


def event_index(events: DataFrame) -> DataFrame:
    """Numbered events with their ids."""
    return events.withColumn("event_id", event_id("change_type", "element_id", "old_value", "new_value", "details"))


def issue_index(missing: DataFrame, ambiguous: DataFrame, refs: DataFrame) -> DataFrame:
    """Issues with their ids: pair_id, issue_type, element_id, affected_id, issue_id.

    ``missing`` and ``ambiguous`` are (pair_id, var_id, sources), ``refs`` (pair_id, var_id, transform_ref).
    """
    rows = None
    for df, kind in ((missing, "MISSING_BINDING"), (ambiguous, "AMBIGUOUS_BINDING")):
        r = df.select("pair_id", F.lit(kind).alias("issue_type"), F.explode("sources").alias("element_id"), F.col("var_id").alias("affected_id"))
        rows = r if rows is None else rows.unionByName(r)
    rows = rows.unionByName(refs.select("pair_id", F.lit("MISSING_TRANSFORM_REF").alias("issue_type"), F.col("transform_ref").alias("element_id"), F.col("var_id").alias("affected_id")))
    return rows.withColumn("issue_id", issue_id("issue_type", "element_id", "affected_id"))


def witnesses(
    impact: DataFrame, unresolved: DataFrame, elements_v1: DataFrame, elements_v2: DataFrame, index: DataFrame, issues: DataFrame, caps: dict[str, int] = CAPS
) -> DataFrame:
    """Why each variable is impacted.

    pair_id, var_id, reason, root_cause_ids, distance, predecessor, triggering_event_ids,
    triggering_issue_ids; lists sorted and cut to their caps, with the full sizes beside them.
    """
    none = F.array().cast(NO_IDS)
    origin = F.when(F.size("path") > 0, F.array(F.col("path")[0])).otherwise(F.array("var_id"))
    bound = issues.filter(F.col("issue_type").isin(*BY_BINDING)).groupBy("pair_id", F.col("affected_id").alias("var_id"), F.col("issue_type").alias("reason")).agg(
        F.array_sort(F.collect_set("element_id")).alias("bound")
    )
    base = impact.join(unresolved, ["pair_id", "var_id"], "left").join(bound, ["pair_id", "var_id", "reason"], "left")
    reason = F.col("reason")
    roots = (
        F.when(reason.isin(*OWN), F.array("var_id"))
        .when(reason == "MISSING_INPUT", F.when(F.size(F.coalesce("missing_ids", none)) > 0, F.col("missing_ids")).otherwise(origin))
        .when(reason.isin(*BY_BINDING), F.coalesce("bound", none))
        .when(reason == "TRANSITIVE_DEPENDENCY", origin)
        .otherwise(F.array("var_id"))
    )
    cut = lambda c, n: F.slice(c, 1, n)
    rooted = base.withColumn("roots_all", roots).withColumn("root_cause_ids", cut(F.col("roots_all"), caps["max_root_causes_per_node"]))
    away = F.size("path") > 1
    placed = rooted.withColumns(
        {
            "distance": F.when(reason.isin(*OWN), 0).when(reason.isin(*BY_BINDING), 1).when(away, F.size("path") - 1).otherwise(0),
            "predecessor": F.when(reason.isin(*OWN), F.lit(None).cast("string"))
            .when(reason.isin(*BY_BINDING), F.try_element_at("root_cause_ids", F.lit(1)))
            .when(away, F.element_at("path", F.when(away, F.size("path") - 1).otherwise(1))),
        }
    )
    # the elements whose events explain a variable
    ref1 = elements_v1.select("pair_id", F.col("id").alias("var_id"), F.col("transform_ref").alias("ref1")).filter("ref1 IS NOT NULL")
    ref2 = elements_v2.select("pair_id", F.col("id").alias("var_id"), F.col("transform_ref").alias("ref2")).filter("ref2 IS NOT NULL")
    placed = placed.join(ref1, ["pair_id", "var_id"], "left").join(ref2, ["pair_id", "var_id"], "left")
    causes = (
        F.when(reason.isin("DIRECT_CHANGE", "DIRECT_CHANGE_MISSING_INPUT"), F.array("var_id"))
        .when(reason == "MISSING_INPUT", F.col("root_cause_ids"))
        .when(reason == "TRANSITIVE_DEPENDENCY", F.slice("root_cause_ids", 1, 1))
        .when(reason.isin("TRANSFORM_IMPL_CHANGED", "TRANSFORM_REMOVED"), F.array(F.coalesce("ref1", "ref2")))
        .otherwise(none)
    )
    told = (
        placed.select("pair_id", "var_id", F.explode(causes).alias("element_id"))
        .join(index.select("pair_id", "element_id", "event_id"), ["pair_id", "element_id"])
        .groupBy("pair_id", "var_id")
        .agg(F.array_sort(F.collect_set("event_id")).alias("events_all"))
    )
    found = issues.select("pair_id", F.col("issue_type").alias("reason"), F.col("affected_id").alias("var_id"), "issue_id").groupBy("pair_id", "reason", "var_id").agg(
        F.array_sort(F.collect_set("issue_id")).alias("issues_all")
    )
    joined = placed.join(told, ["pair_id", "var_id"], "left").join(found, ["pair_id", "reason", "var_id"], "left")
    most = caps["max_trigger_events_per_node"]
    return joined.select(
        "pair_id",
        "var_id",
        "reason",
        "root_cause_ids",
        "distance",
        "predecessor",
        cut(F.coalesce("events_all", none), most).alias("triggering_event_ids"),
        cut(F.coalesce("issues_all", none), most).alias("triggering_issue_ids"),
        F.size("roots_all").alias("roots"),
        F.size(F.coalesce("events_all", none)).alias("events"),
        F.size(F.coalesce("issues_all", none)).alias("issues"),
        F.col("roots_all"),
        F.coalesce("events_all", none).alias("events_all"),
    )


def omitted(items: Column, cap: int, path: Column) -> Column:
    """What a cap leaves out: path, cap, actual, omitted_count and the first and last omitted ids; null if nothing."""
    left = F.slice(items, cap + 1, F.greatest(F.size(items), F.lit(1)))
    ends = F.when(F.size(left) > 1, F.array(left[0], F.element_at(left, -1))).otherwise(left)
    return F.when(
        F.size(items) > cap,
        F.struct(path.alias("path"), F.lit(cap).alias("cap"), F.size(items).alias("actual"), (F.size(items) - cap).alias("omitted_count"), ends.alias("sample_ids")),
    )


def omissions(found: DataFrame, caps: dict[str, int] = CAPS) -> DataFrame:
    """Everything that caps left out of witnesses: pair_id and the record's fields."""
    at = lambda name: F.concat(F.lit("details.witnesses."), F.col("var_id"), F.lit(f".{name}"))
    both = F.array(
        omitted(F.col("roots_all"), caps["max_root_causes_per_node"], at("root_cause_ids")),
        omitted(F.col("events_all"), caps["max_trigger_events_per_node"], at("triggering_event_ids")),
    )
    return found.select("pair_id", F.explode(F.filter(both, lambda o: o.isNotNull())).alias("o")).select("pair_id", "o.*")


def reason_histogram(impact: DataFrame) -> DataFrame:
    return impact.groupBy("pair_id", "reason").agg(F.count("*").alias("n"))


def top_root_causes(found: DataFrame, most: int = CAPS["max_top_roots"]) -> DataFrame:
    """The roots that impact most variables: id, impacted_count; count falling, then id."""
    counts = found.select("pair_id", F.explode("root_cause_ids").alias("id")).groupBy("pair_id", "id").agg(F.count("*").alias("impacted_count"))
    return counts.orderBy(F.desc("impacted_count"), "id", "pair_id").limit(most)


def explained(impact: DataFrame, elements_v1: DataFrame) -> DataFrame:
    """Impact with the names along each path: pair_id, var_id, name, reason, steps (id, name), text."""
    names = elements_v1.select("pair_id", F.col("id").alias("node"), "name")
    hops = impact.select("pair_id", "var_id", F.posexplode_outer("path").alias("at", "node")).join(names, ["pair_id", "node"], "left")
    named = hops.groupBy("pair_id", "var_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("node").isNotNull(), F.struct("at", "node", "name")))), lambda h: F.struct(h["node"].alias("id"), h["name"].alias("name"))).alias("steps")
    )
    own = names.withColumnsRenamed({"node": "var_id"})
    out = impact.join(named, ["pair_id", "var_id"], "left").join(own, ["pair_id", "var_id"], "left")
    way = F.array_join(F.transform("steps", lambda s: F.coalesce(s["name"], s["id"])), " -> ")
    return out.select("pair_id", "var_id", "name", "reason", "steps", F.concat(F.coalesce("name", "var_id"), F.lit(": "), F.lower(F.replace("reason", F.lit("_"), F.lit(" "))), F.when(way != "", F.concat(F.lit(" via "), way)).otherwise("")).alias("text"))


def event_texts(events: DataFrame, elements_v1: DataFrame, elements_v2: DataFrame) -> DataFrame:
    """One sentence per event, with names of version 1 or else 2."""
    names = elements_v1.select("pair_id", F.col("id").alias("element_id"), F.col("name").alias("n1"))
    other = elements_v2.select("pair_id", F.col("id").alias("element_id"), F.col("name").alias("n2"))
    joined = events.join(names, ["pair_id", "element_id"], "left").join(other, ["pair_id", "element_id"], "left")
    what = F.lower(F.replace("change_type", F.lit("_"), F.lit(" ")))
    who = F.concat(F.col("element_id"), F.coalesce(F.concat(F.lit(" ("), F.coalesce("n1", "n2"), F.lit(")")), F.lit("")))
    values = F.when(F.col("old_value").isNotNull() & F.col("new_value").isNotNull(), F.concat(F.lit(": "), F.col("old_value"), F.lit(" -> "), F.col("new_value"))).otherwise("")
    return joined.select("pair_id", "event_seq", F.concat(what, F.lit(" "), who, values).alias("text"))


def run_status(failed: bool, impacted: list[str]) -> str:
    return "non_executable" if failed else "impacted" if impacted else "no_impact"


def core_report(core: dict[str, Any]) -> dict[str, Any]:
    """The report without paths, from the collected parts of one pair."""
    total = len(core["events"])
    registry = sum(e["change_type"].startswith("TRANSFORM_") for e in core["events"])
    return {
        "run_status": run_status(core["validation_failed"], core["impacted_ids"]),
        "validation_failed": core["validation_failed"],
        "validation_errors": core["validation_errors"],
        "summary": {
            "total_events": total,
            "spec_events": total - registry,
            "registry_events": registry,
            "impacted_count": len(core["impacted_ids"]),
            "unaffected_count": len(core["unaffected_ids"]),
            "missing_bindings_count": sum(map(len, core["missing_bindings"].values())),
            "missing_transforms_count": sum(map(len, core["missing_transform_refs"].values())),
        },
        "change_events": core["events"],
        "impacted": core["impacted_ids"],
        "unaffected": core["unaffected_ids"],
        **{k: core[k] for k in ("reasons", "missing_inputs", "missing_bindings", "ambiguous_bindings", "missing_transform_refs")},
    }


def full_report(core: dict[str, Any], edge_kinds: dict[tuple[str, str], str] | None = None, evidence: dict[str, Any] | None = None) -> dict[str, Any]:
    """The report with typed paths per variable."""

    def edges(path: list[str]) -> list[dict[str, str]]:
        hops = list(zip(path, path[1:], strict=False))
        if edge_kinds is not None and any(h not in edge_kinds for h in hops):
            return []
        return [{"src": a, "dst": b, "kind": edge_kinds[a, b] if edge_kinds is not None else "unknown"} for a, b in hops]

    head = core_report(core)
    details = {
        v: {
            "reason": core["reasons"].get(v, "UNKNOWN"),
            "path": edges(core["paths"].get(v, [])),
            "missing_inputs": core["missing_inputs"].get(v, []),
            "missing_bindings": core["missing_bindings"].get(v, []),
            "missing_transforms": [{"side": "b", "transform_id": t} for t in core["missing_transform_refs"].get(v, [])],
            **({"value_evidence": evidence[v]} if evidence and v in evidence else {}),
        }
        for v in core["impacted_ids"]
    }
    keep = ("run_status", "validation_failed", "validation_errors", "summary", "change_events", "impacted", "unaffected")
    return {k: head[k] for k in keep} | {"impact_details": details}


def core_digest(core: dict[str, Any]) -> str:
    names = ("validation_failed", "validation_errors", "events", "impacted_ids", "unaffected_ids", "reasons", "missing_inputs", "missing_bindings", "missing_transform_refs")
    return digest({k: core[k] for k in names})


def markdown(core: dict[str, Any]) -> str:
    """The report as Markdown, without a clock so that reruns agree."""
    report = core_report(core)
    s = report["summary"]
    lines = ["# Impact report", "", f"Status: {report['run_status']}", ""]
    lines += [f"- events: {s['total_events']} ({s['spec_events']} specification, {s['registry_events']} registry)"]
    lines += [f"- impacted: {s['impacted_count']}", f"- unaffected: {s['unaffected_count']}", ""]
    if report["validation_errors"]:
        lines += ["## Validation errors", "", *(f"- {e}" for e in report["validation_errors"]), ""]
    if core["events"]:
        lines += ["## Changes", ""]
        by_type: dict[str, list[dict[str, Any]]] = {}
        for e in core["events"]:
            by_type.setdefault(e["change_type"], []).append(e)
        for kind in sorted(by_type):
            lines += [f"### {kind}", "", *(f"- `{e['element_id']}`: {e['old_value']} -> {e['new_value']}" for e in by_type[kind]), ""]
    if report["impacted"]:
        lines += ["## Impacted", ""]
        for v in report["impacted"]:
            path = " -> ".join(core["paths"].get(v, []))
            more = core["alternative_path_counts"].get(v, 0)
            lines.append(f"- `{v}`: {core['reasons'].get(v)}" + (f" via {path}" if path else "") + (f" (+{more} further paths)" if more else ""))
        lines.append("")
    lines += ["## Unaffected", "", *(f"- `{v}`" for v in report["unaffected"]), ""]
    return "\n".join(lines)
