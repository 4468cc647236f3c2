"""The library's surface: compare, validate and verify artifacts, for one pair or a batch."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippletrace.functions.canon import digest
from rippletrace.operators import bindings as B
from rippletrace.operators import changes as C
from rippletrace.operators import graph as G
from rippletrace.operators import impact as I
from rippletrace.operators import lineage as L
from rippletrace.operators import report as R
from rippletrace.operators import validate as V
from rippletrace.operators import verify as Y
from rippletrace.runtime import stored
from rippletrace.sources import artifacts as A
from rippletrace.sources import bundles as S


class ArtifactError(ValueError):
    """An artifact that cannot be compared."""


@dataclass
class Diff:
    """A batch of comparisons as tables keyed by pair_id."""

    elements_v1: DataFrame
    elements_v2: DataFrame
    events: DataFrame
    impact: DataFrame
    unaffected: DataFrame
    unresolved: DataFrame
    missing_bindings: DataFrame
    ambiguous_bindings: DataFrame
    missing_transform_refs: DataFrame
    errors: DataFrame
    with_paths: bool

    def alternatives(self) -> DataFrame:
        """Further paths per impacted variable (full detail only)."""
        ends = self.impact.filter("size(path) > 1").select("pair_id", F.col("path")[0].alias("start"), F.col("var_id").alias("node"), (F.size("path") - 1).alias("distance"))
        counted = G.alternative_path_counts(G.edges_of(self.elements_v1), stored(ends, "ends"))
        return counted.filter("alternatives > 0").select("pair_id", F.col("node").alias("var_id"), "alternatives")

    def collected(self, pair_id: str) -> dict[str, Any]:
        """One pair's result as plain values, for rendering. Only for results that fit the driver."""
        mine = lambda df: df.filter(F.col("pair_id") == pair_id)
        lists = lambda df, name: {r["var_id"]: list(r[name]) for r in mine(df).collect()}
        found = mine(self.impact).collect()
        events = mine(self.events).orderBy("event_seq").collect()
        errors = sorted({r["message"] for r in mine(self.errors).collect()})
        return {
            "validation_failed": bool(errors),
            "validation_errors": errors,
            "events": [R.event_dict(e["change_type"], e["element_id"], e["old_value"], e["new_value"], e["details"]) for e in events],
            "impacted_ids": sorted(r["var_id"] for r in found),
            "unaffected_ids": sorted(r["var_id"] for r in mine(self.unaffected).collect()),
            "reasons": {r["var_id"]: r["reason"] for r in found},
            "paths": {r["var_id"]: list(r["path"]) for r in found} if self.with_paths else {},
            "missing_inputs": lists(self.unresolved, "missing_ids"),
            "missing_bindings": lists(self.missing_bindings, "sources"),
            "ambiguous_bindings": lists(self.ambiguous_bindings, "sources"),
            "missing_transform_refs": {r["var_id"]: [r["transform_ref"]] for r in mine(self.missing_transform_refs).collect()},
            "alternative_path_counts": {r["var_id"]: r["alternatives"] for r in mine(self.alternatives()).collect()} if self.with_paths else {},
        }

    def witnesses(self, caps: dict[str, int] = R.CAPS) -> DataFrame:
        index = R.event_index(self.events)
        issues = R.issue_index(self.missing_bindings, self.ambiguous_bindings, self.missing_transform_refs)
        return R.witnesses(self.impact, self.unresolved, self.elements_v1, self.elements_v2, index, issues, caps)


def diff_tables(
    v1: DataFrame,
    v2: DataFrame,
    transforms_v1: DataFrame | None = None,
    transforms_v2: DataFrame | None = None,
    bindings_v2: DataFrame | None = None,
    detail: str = "core",
    batch: bool = False,
) -> Diff:
    """Compare element tables. Pairs whose graph has dangling inputs or a cycle must be sorted out before (see :func:`graph_errors`)."""
    v1, v2 = stored(v1, "v1"), stored(v2, "v2")
    changes = C.spec_changes(v1, v2)
    if transforms_v1 is not None and transforms_v2 is not None:
        changes = changes.unionByName(C.registry_changes(transforms_v1, transforms_v2))
    events = stored(C.ordered(changes), "events")
    full = detail == "full"
    found = I.impact(v1, v2, events, transforms_v2, with_paths=full, batch=batch)
    found = stored(found, "impact")
    spark = v1.sparkSession
    none = spark.createDataFrame([], "pair_id string, var_id string, sources array<string>")
    errors = spark.createDataFrame([], "pair_id string, message string")
    refs = spark.createDataFrame([], "pair_id string, var_id string, transform_ref string")
    unaffected = I.unaffected(v1, found)
    if transforms_v2 is not None:
        checked = I.transform_ref_errors(v2, transforms_v2, 2)
        if transforms_v1 is not None:
            checked = checked.unionByName(I.transform_ref_errors(v1, transforms_v1, 1))
        errors = errors.unionByName(checked.select("pair_id", "message"))
        named = v2.select("pair_id", F.col("id").alias("var_id"), "transform_ref")
        refs = I.missing_refs(v1, v2, transforms_v2).select("pair_id", "var_id").join(named, ["pair_id", "var_id"])
    missing = ambiguous = none
    if bindings_v2 is not None:
        missing, ambiguous = B.missing_bindings(v2, bindings_v2), B.ambiguous_uses(v2, bindings_v2)
        touched = missing.select("pair_id").union(ambiguous.select("pair_id")).distinct()
        found = stored(B.binding_impact(v2, bindings_v2, found, with_paths=full), "impact")
        # an overlay with any issue takes the impacted out of the unaffected
        unaffected = unaffected.join(found.join(touched, "pair_id", "left_semi").select("pair_id", "var_id"), ["pair_id", "var_id"], "left_anti")
        errors = errors.unionByName(B.binding_errors(v2, bindings_v2).select("pair_id", "message"))
    return Diff(v1, v2, events, found, unaffected, I.unresolved(v1, events), missing, ambiguous, refs, errors, full)


def graph_errors(elements: DataFrame) -> DataFrame:
    """Pairs whose dependency graph cannot be built: pair_id, message."""
    lacking = G.missing_dependencies(elements).groupBy("pair_id").agg(F.concat(F.lit("missing dependencies: "), F.array_join(F.array_sort(F.collect_set("missing_id")), ", ")).alias("message"))
    whole = elements.join(lacking.select("pair_id"), "pair_id", "left_anti")
    cycles = G.cycle_report(G.edges_of(whole)).select("pair_id", F.concat(F.lit("cycle: "), F.array_join("cycle", " -> ")).alias("message"))
    return lacking.unionByName(cycles)


def _docs(spark: SparkSession, artifact: Any, pair: str = "pair") -> DataFrame | None:
    return None if artifact is None else A.documents(spark, {pair: artifact})


def diff(
    spark: SparkSession,
    from_spec: Any,
    to_spec: Any,
    from_registry: Any = None,
    to_registry: Any = None,
    to_bindings: Any = None,
    detail: str = "full",
) -> dict[str, Any]:
    """Compare one pair of specifications (paths, dicts or JSON text); plain values."""
    d1, d2 = _docs(spark, from_spec), _docs(spark, to_spec)
    for d in (d1, d2):
        for r in A.structure_issues(d, "spec").collect():
            raise ArtifactError(f"{r['code']}: {r['message']}")
        for r in A.params_issues(d).collect():
            raise ArtifactError(f"{r['code']}: {r['id']}: {r['message']}")
    v1, v2 = A.elements(d1), A.elements(d2)
    for v in (v1, v2):
        for r in graph_errors(v).collect():
            raise ArtifactError(r["message"])
    t1, t2, b2 = _docs(spark, from_registry), _docs(spark, to_registry), _docs(spark, to_bindings)
    result = diff_tables(
        v1, v2, None if t1 is None else A.transforms(t1), None if t2 is None else A.transforms(t2), None if b2 is None else A.bindings(b2), detail, batch=True
    )
    return result.collected("pair")


def diff_all_details(spark: SparkSession, from_spec: Any, to_spec: Any, from_registry: Any = None, to_registry: Any = None, to_bindings: Any = None, caps: dict[str, int] | None = None) -> dict[str, Any]:
    """The detailed report of one pair: header, input and core digests, core report, indexes, witnesses, summaries."""
    caps = R.CAPS | (caps or {})
    d1, d2 = _docs(spark, from_spec), _docs(spark, to_spec)
    t1, t2, b2 = _docs(spark, from_registry), _docs(spark, to_registry), _docs(spark, to_bindings)
    frames = diff_tables(
        A.elements(d1), A.elements(d2), None if t1 is None else A.transforms(t1), None if t2 is None else A.transforms(t2), None if b2 is None else A.bindings(b2), "full", batch=True
    )
    core = frames.collected("pair")
    found = stored(frames.witnesses(caps), "witnesses")
    shown = found.orderBy("var_id").limit(caps["max_witnesses"]).collect()
    index = R.event_index(frames.events).orderBy("event_seq").collect()
    issues = R.issue_index(frames.missing_bindings, frames.ambiguous_bindings, frames.missing_transform_refs).orderBy("issue_type", "affected_id", "element_id").collect()
    roots = R.top_root_causes(found, caps["max_top_roots"]).collect()
    reasons: dict[str, int] = {}
    for w in shown:
        reasons[w["reason"]] = reasons.get(w["reason"], 0) + 1
    by_type: dict[str, int] = {}
    for e in core["events"]:
        by_type[e["change_type"]] = by_type.get(e["change_type"], 0) + 1
    import json

    given = {"spec_v1": from_spec, "spec_v2": to_spec, "registry_v1": from_registry, "registry_v2": to_registry, "bindings_v2": to_bindings}
    return {
        "report_schema_version": R.SCHEMA_VERSION,
        "verifier_contract_version": R.CONTRACT_VERSION,
        "canonicalization_policy_id": R.POLICY,
        "inputs": {k: None if v is None else {"digest": digest(json.loads(A.text_of(v)))} for k, v in given.items()},
        "core_digest": R.core_digest(core),
        **R.core_report(core),
        "details": {
            "event_index": [{"event_id": e["event_id"], "event_seq": e["event_seq"], **x} for e, x in zip(index, core["events"], strict=True)],
            "issues_index": [{"issue_id": i["issue_id"], "issue_seq": n, "issue_type": i["issue_type"], "element_id": i["element_id"], "affected_id": i["affected_id"]} for n, i in enumerate(issues, 1)],
            "witnesses": {
                w["var_id"]: {k: (list(w[k]) if k.endswith("_ids") else w[k]) for k in ("reason", "root_cause_ids", "distance", "predecessor", "triggering_event_ids", "triggering_issue_ids")}
                for w in shown
            },
            "summaries": {
                "reasons": reasons,
                "events_by_type": by_type,
                "max_distance": max((w["distance"] for w in shown), default=0),
                "top_root_causes": [{"id": r["id"], "impacted_count": r["impacted_count"]} for r in roots],
            },
            "caps": caps,
            "omissions": [r.asDict() for r in R.omissions(found, caps).drop("pair_id").orderBy("path").collect()],
        },
    }


def doctor(spark: SparkSession, report: Any, from_spec: Any, to_spec: Any, from_registry: Any = None, to_registry: Any = None, to_bindings: Any = None) -> dict[str, Any]:
    """Check a detailed report against its inputs, clause by clause; an unreadable report fails the first alone."""
    import json

    clauses: list[dict[str, Any]] = []

    def clause(name: str, details: dict[str, Any]) -> None:
        clauses.append({"id": name, "ok": not details, "details": details})

    try:
        given = json.loads(A.text_of(report))
        clause("report_read", {})
    except (OSError, ValueError) as e:
        clause("report_read", {"error": str(e)})
        return _doctored(clauses)
    head = {"report_schema_version": R.SCHEMA_VERSION, "verifier_contract_version": R.CONTRACT_VERSION, "canonicalization_policy_id": R.POLICY}
    clause("header_contract", {k: given.get(k) for k, v in head.items() if given.get(k) != v})
    try:
        fresh = diff_all_details(spark, from_spec, to_spec, from_registry, to_registry, to_bindings, given.get("details", {}).get("caps"))
    except Exception as e:  # noqa: BLE001  any failure to recompute is a finding
        for name in ("inputs_digest", "core_digest", "witness_invariants", "accounting"):
            clause(name, {"error": str(e)[:500]})
        return _doctored(clauses)
    said, real = given.get("inputs") or {}, fresh["inputs"]
    clause("inputs_digest", {k: {"expected": real[k], "reported": said.get(k)} for k in real if real[k] != said.get(k)})
    clause("core_digest", {} if given.get("core_digest") == fresh["core_digest"] else {"expected": fresh["core_digest"], "reported": given.get("core_digest")})
    seen, right = given.get("details", {}).get("witnesses", {}), fresh["details"]["witnesses"]
    events = {e.get("event_id") for e in given.get("details", {}).get("event_index", [])}
    wrong: dict[str, Any] = {}
    if extra := sorted(set(seen) - set(right)):
        wrong["unexpected_witness_ids"] = extra
    for name, key in (("reason_mismatch", "reason"), ("distance_mismatch", "distance"), ("predecessor_mismatch", "predecessor"), ("invalid_root_cause_id", "root_cause_ids"), ("irrelevant_event", "triggering_event_ids"), ("issue_linkage", "triggering_issue_ids")):
        if bad := sorted(v for v in seen if v in right and seen[v].get(key) != right[v][key]):
            wrong[name] = bad
    if lost := sorted({e for w in seen.values() for e in w.get("triggering_event_ids") or [] if e not in events}):
        wrong["missing_event_ids"] = lost
    clause("witness_invariants", wrong)
    details, whole = given.get("details", {}), fresh["details"]
    clause("accounting", {k: {"expected": whole[k], "reported": details.get(k)} for k in ("event_index", "issues_index", "summaries", "omissions") if json.loads(json.dumps(whole[k])) != details.get(k)})
    return _doctored(clauses)


def _doctored(clauses: list[dict[str, Any]]) -> dict[str, Any]:
    failed = [c["id"] for c in clauses if not c["ok"]]
    return {
        "ok": not failed,
        "clauses": clauses,
        "summary": {"total_clauses": len(clauses), "ok_clauses": len(clauses) - len(failed), "failed_clauses": len(failed), "failed_clause_ids": failed},
    }


def validate(spark: SparkSession, spec: Any, registry: Any = None, bindings: Any = None, raw_schema: Any = None, ambiguity: str = "warning") -> dict[str, Any]:
    """Check one specification: ok, errors, warnings."""
    docs = _docs(spark, spec)
    broken = A.structure_issues(docs, "spec").collect()
    if broken:
        return {"ok": False, "errors": [{"code": "INVALID_STRUCTURE", "message": r["message"]} for r in broken], "warnings": []}
    unfit = A.params_issues(docs).orderBy("id").collect()
    if unfit:
        errors = [{"code": r["code"], "severity": "error", "message": r["message"], "element_id": r["id"]} for r in unfit]
        return {"ok": False, "errors": errors, "warnings": []}
    t, b, r = _docs(spark, registry), _docs(spark, bindings), _docs(spark, raw_schema)
    found = V.issues(
        A.elements(docs),
        None if t is None else A.transforms(t),
        None if b is None else A.bindings(b),
        None if r is None else A.raw_columns(r),
        ambiguity,
        A.params(docs),
    )
    rows = [{k: v for k, v in x.asDict().items() if k != "pair_id" and v is not None} for x in V.sorted_issues(found).collect()]
    errors = [x for x in rows if x["severity"] == "error"]
    return {"ok": not errors, "errors": errors, "warnings": [x for x in rows if x["severity"] == "warning"]}


def verify_registry(spark: SparkSession, registry: Any) -> list[dict[str, Any]]:
    """Entries of a registry that are not acceptable."""
    from rippletrace.functions.ids import bad_timestamp, bad_transform
    from rippletrace.schemas import REGISTRY_DDL

    each = A.parsed(_docs(spark, registry), REGISTRY_DDL).select(F.explode("a.transforms").alias("t"))
    reason = bad_transform(F.col("t.id"), F.col("t.impl_fingerprint.digest"), F.col("t.params_schema_hash"))
    bad = each.select(F.col("t.id").alias("id"), reason.alias("message")).filter("message IS NOT NULL")
    twice = each.groupBy("t.id").count().filter("count > 1").select("id", F.lit("transform ids must be unique").alias("message"))
    times = each.select("t.id", F.explode("t.history").alias("h")).select("id", bad_timestamp(F.col("h.timestamp")).alias("message")).filter("message IS NOT NULL")
    return [r.asDict() for r in bad.union(twice).union(times).orderBy("id", "message").collect()]


def with_history(transforms: DataFrame, entry: DataFrame) -> DataFrame:
    """Append snapshots (pair_id, id, struct ``snapshot``) to the history array of registry entries; the input is untouched."""
    joined = transforms.join(entry, ["pair_id", "id"], "left")
    grown = F.when(F.col("snapshot").isNotNull(), F.array_append(F.coalesce("history", F.array()), F.col("snapshot"))).otherwise(F.col("history"))
    return joined.withColumn("history", grown).drop("snapshot")


def verify_bundles(spark: SparkSession, root: str) -> DataFrame:
    """The first broken rule of each bundle below a folder; bundles without a row are sound."""
    files = S.files(spark, root)
    return Y.first_violations(Y.bundle_violations(files))


def ingest_bundles(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Verified bundles as three tables: run records, registry entries, lineage graphs. Unsound bundles are left out and listed."""
    files = S.files(spark, root)
    bad = stored(Y.first_violations(Y.bundle_violations(files)), "violations")
    sound = files.join(bad.select("bundle"), "bundle", "left_anti")
    return {"violations": bad, "runs": Y.run_fingerprints(sound), "registry": Y.promoted_registry(sound), "graphs": S.lineage_graphs(sound)}


def load_graphs(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Lineage graphs of bundles as steps and edges, and why others have none."""
    files = S.files(spark, root)
    docs = stored(S.lineage_graphs(files), "graphs")
    nodes, edges = A.graph_nodes(docs), A.graph_edges(docs)
    broken = L.first_violation(L.violations(nodes, edges, A.graph_versions(docs)))
    return {"steps": A.graph_steps(docs), "nodes": nodes, "edges": edges, "errors": S.graph_errors(files), "violations": broken, "hashes": docs.select("pair_id", "sha256")}


def graph_diff(steps_a: DataFrame, edges_a: DataFrame, steps_b: DataFrame, edges_b: DataFrame) -> dict[str, DataFrame]:
    """Differences of lineage graphs and their downstream impact on graph B."""
    start = stored(L.seeds(steps_a, steps_b), "seeds")
    reached = L.downstream(edges_b, start)
    return {
        "nodes": L.node_changes(steps_a, steps_b, "step").unionByName(L.node_changes(L.tables_of(edges_a), L.tables_of(edges_b), "table")),
        "changed": L.changed_steps(steps_a, steps_b),
        "rewired": L.rewired_steps(steps_a, steps_b),
        "class_pairs": L.class_pairs(steps_a, steps_b),
        "edges": L.edge_changes(edges_a, edges_b),
        "events": L.event_log(steps_a, steps_b),
        "counts": L.counts(steps_a, steps_b, edges_a, edges_b),
        "seeds": start,
        "reached": reached,
        "touched_tables": L.touched_tables(edges_b, start),
        "impacted_tables": L.impacted_tables(edges_b, reached),
        "subgraph": L.induced_edges(edges_b, reached),
    }


def graph_diff_bundles(spark: SparkSession, root_a: str, root_b: str) -> dict[str, DataFrame]:
    """As :func:`graph_diff`, of the bundles of two folders that have the same name; with both file hashes."""
    a, b = load_graphs(spark, root_a), load_graphs(spark, root_b)
    out = graph_diff(a["steps"], a["edges"], b["steps"], b["edges"])
    out["hashes"] = a["hashes"].withColumnRenamed("sha256", "hash_a").join(b["hashes"].withColumnRenamed("sha256", "hash_b"), "pair_id", "full_outer")
    return out
