"""Comparison of recorded runs: variable graphs of two bundles become specifications and are compared as such."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rippletrace.functions import ids
from rippletrace.functions.canon import canonical_b, normalised_digest, params_hash_of, plain, sha256
from rippletrace.functions.render import rendered_spec, rendered_target
from rippletrace.operators import changes as C
from rippletrace.operators import evidence as E
from rippletrace.operators import impact as I
from rippletrace.schemas import REGISTRY_DDL
from rippletrace.sources import bundles as S

PASS_THROUGH = "pass_through"


def variables(files: DataFrame) -> DataFrame:
    """Nodes of the variable graphs: bundle and their fields, with table and column resolved."""
    v = S.part(files, S.VARIABLES, S.VARIABLES_DDL).select("bundle", F.explode("a.nodes").alias("n")).select("bundle", "n.*")
    return v.withColumns({"table": ids.table_of(F.col("id"), F.col("table_id")), "column": ids.column_of(F.col("id"), F.col("col"))})


def variable_edges(files: DataFrame) -> DataFrame:
    """Edges of the variable graphs with a kind: the given one if it is known, else inferred from the ends."""
    raw = S.part(files, S.VARIABLES, S.VARIABLES_DDL).select("bundle", F.explode("a.edges").alias("e")).select("bundle", "e.*")
    node = variables(files).select("bundle", "id", "origin", "transform_id", "producing_step_id")
    ends = raw.join(node.selectExpr("bundle", "id AS dst", "origin AS d_origin", "transform_id AS d_transform", "producing_step_id AS d_step"), ["bundle", "dst"], "left")
    ends = ends.join(node.selectExpr("bundle", "id AS src", "transform_id AS s_transform", "producing_step_id AS s_step", "true AS s_known"), ["bundle", "src"], "left")
    inferred = (
        F.when(F.col("d_origin").isNull() & F.col("d_transform").isNull() & F.col("d_step").isNull(), "flow")
        .when((F.col("d_origin") == PASS_THROUGH) | F.col("d_transform").isNull(), "flow")
        .when(F.col("s_known") & F.col("s_step").eqNullSafe(F.col("d_step")) & F.col("s_transform").eqNullSafe(F.col("d_transform")), "derivation")
        .when(F.col("d_origin") == "derived", "derivation")
        .otherwise("flow")
    )
    wrong = F.col("kind").isNotNull() & ~F.col("kind").isin("flow", "derivation", "rename")
    kind = F.when(wrong, F.raise_error(F.concat(F.lit("unknown edge kind "), F.col("kind")))).otherwise(F.coalesce("kind", inferred))
    return ends.select("bundle", "src", "dst", kind.alias("kind"))


def graph_errors(files: DataFrame) -> DataFrame:
    """Variable graphs that cannot be compared: bundle, message (duplicate nodes, dangling edges)."""
    v = variables(files)
    twice = v.groupBy("bundle", "id").count().filter("count > 1").select("bundle", F.concat(F.lit("duplicate node "), F.col("id")).alias("message"))
    arcs = S.part(files, S.VARIABLES, S.VARIABLES_DDL).select("bundle", F.explode("a.edges").alias("e")).select("bundle", F.explode(F.array("e.src", "e.dst")).alias("id"))
    loose = arcs.join(v.select("bundle", "id"), ["bundle", "id"], "left_anti").distinct()
    return twice.union(loose.select("bundle", F.concat(F.lit("edge names missing node "), F.col("id"))))


def elements(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """The variable graph of each bundle as derived elements; ``pairs`` maps bundle to pair_id."""
    v = variables(files)
    edges = S.part(files, S.VARIABLES, S.VARIABLES_DDL).select("bundle", F.explode("a.edges").alias("e")).select("bundle", F.col("e.src").alias("src"), F.col("e.dst").alias("id"))
    inputs = edges.groupBy("bundle", "id").agg(F.array_sort(F.collect_set("src")).alias("inputs"))
    steps = S.plan_steps(files).select("bundle", F.col("step_id").alias("producing_step_id"), F.array_sort("inputs").alias("step_inputs"), F.array_sort("outputs").alias("step_outputs"))
    fields = F.to_json(
        F.struct("producing_step_id", "expr_sha256", "payload_sha256", "origin", "transform_id", "step_inputs", "step_outputs", F.col("table").alias("table_id"), F.col("column").alias("col"))
    )
    joined = v.join(inputs, ["bundle", "id"], "left").join(steps, ["bundle", "producing_step_id"], "left").join(pairs, "bundle")
    return joined.select(
        "pair_id",
        F.lit("derived").alias("kind"),
        "id",
        F.when(F.col("table").isNotNull() & F.col("column").isNotNull(), F.concat_ws(".", "table", "column")).otherwise(F.col("id")).alias("name"),
        F.lit("unknown").alias("type"),
        F.concat(F.lit("t:"), F.coalesce("transform_id", F.lit(PASS_THROUGH))).alias("transform_ref"),
        params_hash_of(fields).alias("params_hash"),
        F.coalesce("inputs", F.array().cast("array<string>")).alias("inputs"),
        F.lit(None).cast("string").alias("expression"),
    )


def own_registries(files: DataFrame) -> DataFrame:
    """Registries that bundles bring along, the one at the root before the one among the artifacts: bundle, a."""
    rank = F.array_position(F.array(*(F.lit(p) for p in S.OWN_REGISTRIES)), F.col("path"))
    text = files.filter(F.col("path").isin(*S.OWN_REGISTRIES)).groupBy("bundle").agg(F.min_by("content", rank).alias("content"))
    parsed = F.from_json(F.col("content").cast("string"), REGISTRY_DDL)
    broken = F.raise_error(F.concat(F.lit("no registry in bundle "), F.col("bundle")))
    return text.select("bundle", F.when(parsed["transforms"].isNotNull(), parsed).otherwise(broken).alias("a"))


def transforms(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """A bundle's own registry; without one, an entry per transform that the nodes or steps name, digest from the id."""
    own = own_registries(files)
    given = own.select("bundle", F.explode("a.transforms").alias("e")).select(
        "bundle", "e.id", "e.version", "e.kind", F.lower("e.impl_fingerprint.digest").alias("digest"), "e.impl_fingerprint.source", "e.impl_fingerprint.ref"
    )
    named = variables(files).select("bundle", F.coalesce("transform_id", F.lit(PASS_THROUGH)).alias("t"))
    named = named.union(S.plan_steps(files).select("bundle", "transform_id")).filter("t IS NOT NULL").distinct()
    minimal = named.join(own.select("bundle"), "bundle", "left_anti").select(
        "bundle",
        F.concat(F.lit("t:"), "t").alias("id"),
        F.lit("").alias("version"),
        F.lit("external").alias("kind"),
        normalised_digest(F.col("t")).alias("digest"),
        F.lit("external").alias("source"),
        F.col("t").alias("ref"),
    )
    every = given.unionByName(minimal).join(pairs, "bundle")
    return every.select("pair_id", "id", "version", "kind", "digest", "source", "ref")


def source_tables(files: DataFrame) -> DataFrame:
    """The table that stands for a bundle's sources: the least table name of its plan."""
    named = S.plan_steps(files).select("bundle", F.explode(F.concat("inputs", "outputs")).alias("table"))
    return named.groupBy("bundle").agg(F.min("table").alias("source_table"))


def derived_bindings(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """Columns of the source table bound to their variables."""
    at = variables(files).join(source_tables(files), "bundle").filter("`table` = source_table")
    return at.join(pairs, "bundle").select("pair_id", F.col("column").alias("raw_column"), F.col("id").alias("source_id"), F.lit(0).alias("position"))


def refusals(files: DataFrame) -> DataFrame:
    """Bundles whose run was refused: bundle, code, message. Their pairs are not compared further."""
    return S.reports(files).filter("a.status = 'refused' AND a.primary_error IS NOT NULL").select("bundle", "a.primary_error.code", "a.primary_error.message")


def annotated(events: DataFrame, files_a: DataFrame, files_b: DataFrame, pairs: DataFrame) -> DataFrame:
    """Add what changed transforms say: ``old_text`` and ``new_text``.

    For a changed reference the assignment of the variable's column, else the whole step;
    for added and removed transforms the step.
    """

    def specs(files: DataFrame, side: str) -> DataFrame:
        each = S.candidates(files).select("bundle", F.explode("a.transforms").alias("t")).join(pairs, "bundle")
        return each.select(
            "pair_id",
            F.concat(F.lit("t:"), F.regexp_replace("t.transform_id", "^t:", "")).alias(f"{side}_ref"),
            F.col("t.spec").alias(f"{side}_spec"),
            F.col("t.kind").alias(f"{side}_kind"),
            F.lit(True).alias(f"{side}_found"),
        ).dropDuplicates(["pair_id", f"{side}_ref"])

    by_ref = F.col("change_type") == "DERIVED_TRANSFORM_REF_CHANGED"
    keyed = events.withColumns(
        {
            "old_ref": F.when(by_ref, F.col("old_value")).when(F.col("change_type") == "TRANSFORM_REMOVED", F.col("element_id")),
            "new_ref": F.when(by_ref, F.col("new_value")).when(F.col("change_type") == "TRANSFORM_ADDED", F.col("element_id")),
            "target": F.coalesce(ids.column_of(F.col("element_id")), F.lit("")),
        }
    )
    joined = keyed.join(specs(files_a, "old"), ["pair_id", "old_ref"], "left").join(specs(files_b, "new"), ["pair_id", "new_ref"], "left")

    def text(side: str) -> Column:
        name, found, spec = F.regexp_replace(f"{side}_ref", "^t:", ""), F.coalesce(f"{side}_found", F.lit(False)), F.col(f"{side}_spec")
        assigned = rendered_target(name, found, F.col(f"{side}_kind"), spec, F.col("target"))
        return F.when(by_ref, assigned).otherwise(rendered_spec(name, found, spec))

    return joined.withColumns({"old_text": text("old"), "new_text": text("new")}).select(*events.columns, "old_text", "new_text")


def contract(lock: dict[str, Any]) -> dict[str, Any]:
    """What a schema lock promises, in one order: names, kinds, columns with types, rules; who wrote it when does not count."""
    given = lock.get("datasources")
    if isinstance(given, dict):
        given = [{**d, "name": name} for name, d in given.items() if isinstance(d, dict)]
    rows = []
    for d in given if isinstance(given, list) else []:
        if not isinstance(d, dict) or d.get("name") is None:
            continue
        columns = d.get("columns")
        if isinstance(columns, dict):
            columns = [{"name": n, "type": t} for n, t in columns.items()]
        typed = sorted((str(c["name"]), str(c.get("type", ""))) for c in columns or [] if isinstance(c, dict) and c.get("name") is not None)
        row = {"name": str(d["name"]), "columns": [{"name": n, "type": t} for n, t in typed]}
        if "kind" in d:
            row["kind"] = str(d["kind"])
        if isinstance(d.get("rules"), dict):
            row["rules"] = d["rules"]
        rows.append(row)
    return {"datasources": sorted(rows, key=lambda r: r["name"])}


@F.pandas_udf(StringType())
def contract_hash(locks: pd.Series) -> pd.Series:
    """Hash of each lock's contract."""
    return locks.map(lambda text: sha256(plain(contract(json.loads(text)))))


def lock_hashes(files: DataFrame) -> DataFrame:
    """Hashes of schema locks: contract (see :func:`contract`) and provenance (everything)."""
    lock = files.filter(F.col("path").endswith(S.SCHEMA_LOCK)).select("bundle", F.col("content").cast("string").alias("text"))
    whole = lock.filter(F.get_json_object("text", "$").isNotNull())
    return whole.select("bundle", contract_hash("text").alias("contract_hash"), F.sha2(canonical_b("text"), 256).alias("provenance_hash"))


def lock_changes(files_a: DataFrame, files_b: DataFrame, pairs_a: DataFrame, pairs_b: DataFrame) -> DataFrame:
    """pair_id, the hashes of both sides, contract_changed and provenance_changed (false where a side has no lock)."""
    side = lambda files, pairs, x: lock_hashes(files).join(pairs, "bundle").select(
        "pair_id", F.col("contract_hash").alias(f"contract_{x}"), F.col("provenance_hash").alias(f"provenance_{x}")
    )
    both = side(files_a, pairs_a, "a").join(side(files_b, pairs_b, "b"), "pair_id", "full_outer")
    differ = lambda c: F.coalesce(F.col(f"{c}_a") != F.col(f"{c}_b"), F.lit(False)).alias(f"{c}_changed")
    return both.select("pair_id", "contract_a", "contract_b", differ("contract"), "provenance_a", "provenance_b", differ("provenance"))


def run_diff(files_a: DataFrame, files_b: DataFrame, pairs_a: DataFrame, pairs_b: DataFrame, with_paths: bool = True) -> dict[str, DataFrame]:
    """Compare runs pair by pair: events, impact, unaffected, evidence, schema changes, refusals, missing transforms."""
    refused = refusals(files_a).join(pairs_a, "bundle").unionByName(refusals(files_b).join(pairs_b, "bundle"))
    open_pairs = refused.select("pair_id").distinct()
    live_a, live_b = pairs_a.join(open_pairs, "pair_id", "left_anti"), pairs_b.join(open_pairs, "pair_id", "left_anti")
    v1, v2 = elements(files_a, live_a), elements(files_b, live_b)
    t1, t2 = transforms(files_a, live_a), transforms(files_b, live_b)
    events = C.ordered(C.spec_changes(v1, v2).unionByName(C.registry_changes(t1, t2)))
    found = I.impact(v1, v2, events, t2, with_paths=with_paths, batch=True)
    at = lambda files, pairs: variables(files).join(pairs, "bundle").select("pair_id", F.col("id").alias("var_id"), "table", "column")
    old_at = at(files_a, live_a).withColumnsRenamed({"table": "old_table", "column": "old_column"})
    direct = events.filter(F.col("change_type").isin(*E.DIRECT)).select("pair_id", F.col("element_id").alias("var_id")).distinct()
    changed = direct.join(found.select("pair_id", "var_id"), ["pair_id", "var_id"], "left_semi")
    changed = changed.join(old_at, ["pair_id", "var_id"], "left").join(at(files_b, live_b), ["pair_id", "var_id"], "left")
    told = lambda files, pairs: E.evidence_tables(files).join(pairs, "bundle").select("pair_id", "tables")
    stats = lambda files, pairs: E.bundle_stats(files).join(pairs, "bundle").select("pair_id", "table", "column", "stats")
    columns = lambda files, pairs, f: f(files).withColumnRenamed("pair_id", "bundle").join(pairs, "bundle").drop("bundle")
    cols_a, cols_b = columns(files_a, pairs_a, S.schema_columns), columns(files_b, pairs_b, S.schema_columns)
    return {
        "refusals": refused,
        "events": annotated(events, files_a, files_b, live_a.unionByName(live_b)),
        "impact": found,
        "unaffected": I.unaffected(v1, found),
        "missing_transforms": I.transform_ref_errors(v1, t1, 1).unionByName(I.transform_ref_errors(v2, t2, 2)),
        "value_evidence": E.value_evidence(changed, stats(files_a, live_a), stats(files_b, live_b), cols_b, told(files_a, live_a), told(files_b, live_b)),
        "schema_evidence": C.column_changes(cols_a, cols_b),
        "schema_lock": C.column_changes(columns(files_a, pairs_a, S.lock_columns), columns(files_b, pairs_b, S.lock_columns)),
        "schema_lock_hashes": lock_changes(files_a, files_b, live_a, live_b),
        # kinds of edges come from the first bundle only
        "edge_kinds": variable_edges(files_a).join(live_a, "bundle").drop("bundle"),
    }
