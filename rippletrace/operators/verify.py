"""Integrity of bundles and change chains: every broken rule as a row, ranked as a strict reader meets them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rippletrace.functions.canon import canonical_a, canonical_b, canonical_or_error
from rippletrace.sources import bundles as S


def _row(df: DataFrame, rank: int, code: str, message: Column, position: Column | None = None) -> DataFrame:
    return df.select(
        "bundle",
        F.lit(rank).alias("rule"),
        (F.lit(0) if position is None else position).cast("int").alias("position"),
        F.lit(code).alias("code"),
        message.alias("message"),
    )


def said(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("none")) for p in parts))


def step_id_of(transform_id: Column, inputs: Column, outputs: Column) -> Column:
    """Identity of a step: hash of its transform and its ordered wiring."""
    return F.sha2(canonical_a(F.to_json(F.struct(inputs.alias("inputs"), outputs.alias("outputs"), transform_id.alias("transform_id")))), 256)


def bundle_violations(files: DataFrame) -> DataFrame:
    """All broken rules of bundles: bundle, rule (rank), position, code, message."""
    report = S.reports(files)
    plan = S.artifact(files, S.PLAN, S.PLAN_DDL)
    steps = S.plan_steps(files)
    registry = S.candidates(files)
    listed = S.entries(files)
    held = files.select("bundle", "path", "sha256")

    plan_entry = listed.filter("section = 'artifacts' AND (path LIKE '%plan.ir.json' OR name = 'plan.ir.json')").select("bundle", F.col("sha256").alias("expected"))
    evidence = S.artifact(files, S.EVIDENCE, S.EVIDENCE_DDL).select("bundle", F.col("a.plan_ir.sha256").alias("witnessed"))
    plans = plan.select("bundle", "sha256").join(plan_entry, "bundle", "left").join(evidence, "bundle", "left").withColumn("wanted", F.coalesce("expected", "witnessed"))
    index = registry.select("bundle", F.explode_outer("a.index").alias("position", "indexed")).withColumn("position", F.col("position").cast("int"))
    wired = steps.join(index, ["bundle", "position"], "left")
    known = registry.select("bundle", F.explode("a.transforms").alias("t")).select("bundle", "t.transform_id", "t.spec")
    recomputed = step_id_of(F.col("transform_id"), F.col("inputs"), F.col("outputs"))
    entry = listed.join(held.withColumnRenamed("sha256", "actual"), ["bundle", "path"], "left")
    tables, artifacts = entry.filter("section <> 'artifacts'"), entry.filter("section = 'artifacts'")
    order = F.when(F.col("section") == "inputs", F.col("position")).otherwise(F.col("position") + 100_000)
    checked = known.withColumn("canonical", canonical_or_error("spec"))
    thin = report.filter("a.bundle_mode = 'thin'")
    sources = thin.select("bundle", F.posexplode("a.datasource_inputs").alias("position", "d"))
    named = F.transform(F.col("a.datasource_inputs"), lambda d: d["datasource"])

    found = [
        _row(plans.filter("wanted IS NULL"), 10, "INVALID_STRUCTURE", F.lit("no hash of the plan is recorded")),
        _row(plans.filter("wanted <> sha256"), 11, "HASH_MISMATCH", said("plan hash is ", F.col("sha256"), ", recorded ", F.col("wanted"))),
        _row(wired.filter("indexed IS NULL"), 20, "REGISTRY_INDEX_INCOMPLETE", said("step ", F.col("position"), " is not in the index"), F.col("position")),
        _row(wired.filter("indexed <> transform_id"), 30, "STEP_ID_CONFLICT", said("step ", F.col("position"), " has another transform than the index"), F.col("position")),
        _row(steps.filter(F.col("step_id") != recomputed), 40, "STEP_ID_CONFLICT", said("step ", F.col("position"), " has an id that its wiring does not give"), F.col("position")),
        _row(tables.filter("actual IS NULL"), 50, "FILE_NOT_FOUND", said("missing file ", F.col("path")), order),
        _row(tables.filter("actual <> sha256"), 50, "HASH_MISMATCH", said("hash of ", F.col("path"), " differs"), order),
        _row(artifacts.filter("actual IS NULL"), 55, "FILE_NOT_FOUND", said("missing artifact ", F.col("path")), F.col("position")),
        _row(artifacts.filter("actual <> sha256"), 55, "HASH_MISMATCH", said("hash of artifact ", F.col("path"), " differs"), F.col("position")),
        _row(
            wired.filter("indexed IS NOT NULL").join(known.select("bundle", F.col("transform_id").alias("indexed")), ["bundle", "indexed"], "left_anti"),
            60,
            "TRANSFORM_NOT_FOUND",
            said("transform ", F.col("indexed"), " is not in the registry"),
            F.col("position"),
        ),
        _row(checked.filter("spec IS NULL OR spec IN ('', '{}', 'null')"), 70, "INVALID_STRUCTURE", said("transform ", F.col("transform_id"), " has no spec")),
        _row(checked.filter("canonical LIKE '!%'"), 70, "INVALID_STRUCTURE", said("transform ", F.col("transform_id"), ": ", F.col("canonical"))),
        _row(
            checked.filter("canonical NOT LIKE '!%' AND spec NOT IN ('', '{}', 'null') AND sha2(canonical, 256) <> transform_id"),
            71,
            "STEP_ID_CONFLICT",
            said("transform ", F.col("transform_id"), " has an id that its spec does not give"),
        ),
        _row(thin.filter("a.datasource_inputs IS NULL OR size(a.datasource_inputs) = 0"), 80, "INVALID_STRUCTURE", F.lit("a thin bundle must list its data sources")),
        _row(
            thin.withColumn("lacking", F.array_except(F.coalesce("a.settings.datasources", F.array().cast("array<string>")), F.coalesce(named, F.array().cast("array<string>")))).filter("size(lacking) > 0"),
            81,
            "INVALID_STRUCTURE",
            F.lit("a thin bundle must cover all its data sources"),
        ),
        _row(sources.filter("d.embedded"), 82, "INVALID_STRUCTURE", said("data source ", F.col("d.datasource"), " is embedded"), F.col("position")),
        _row(sources.filter("trim(coalesce(d.sha256, '')) = ''"), 83, "INVALID_STRUCTURE", said("data source ", F.col("d.datasource"), " has no hash"), F.col("position")),
        _row(sources.filter("coalesce(d.size_bytes, 0) <= 0"), 84, "INVALID_STRUCTURE", said("data source ", F.col("d.datasource"), " is empty"), F.col("position")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def first_violations(found: DataFrame) -> DataFrame:
    """What a reader that stops at the first failure raises, per bundle."""
    return found.groupBy("bundle").agg(F.min_by(F.struct("rule", "code", "message"), F.struct("rule", "position", "message")).alias("v")).select("bundle", "v.*")


@F.pandas_udf(StringType())
def _fingerprint(plan: pd.Series, steps: pd.Series, inputs: pd.Series, outputs: pd.Series) -> pd.Series:
    from rippletrace.functions.canon import digest

    def one(p: str, s: str, i: str, o: str) -> str:
        payload = {"plan_sha256": p, "steps": json.loads(s), "input_canonical_hashes": json.loads(i), "output_canonical_hashes": json.loads(o)}
        return digest(payload).removeprefix("sha256:")

    return pd.Series([one(*x) for x in zip(plan, steps, inputs, outputs, strict=True)], dtype=object)


def run_fingerprints(files: DataFrame) -> DataFrame:
    """Identity of a run: hash over its plan, ordered steps and table hashes; when and under which id it ran does not count.

    bundle, fingerprint, run_id, created_at. A table's canonical hash from the evidence
    goes before the report's, that before the hash of its bytes.
    """
    plan = S.artifact(files, S.PLAN, S.PLAN_DDL).select("bundle", F.col("sha256").alias("plan"))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("position", "step_id", "transform_id"))), lambda s: F.array(s["step_id"], s["transform_id"]))
    steps = S.plan_steps(files).groupBy("bundle").agg(F.to_json(pairs).alias("steps"))
    evidence = S.artifact(files, S.EVIDENCE, S.EVIDENCE_DDL)
    report = S.reports(files)

    def hashes(section: str) -> DataFrame:
        seen = evidence.select("bundle", F.explode(f"a.{section}").alias("e")).select("bundle", F.coalesce("e.name", F.element_at(F.split("e.path", "/"), -1)).alias("name"), "e.canonical_sha256", "e.bytes_sha256")
        mine = S.entries(files).filter(F.col("section") == section).select("bundle", F.coalesce("name", F.element_at(F.split("path", "/"), -1)).alias("name"), "sha256")
        rows = mine.join(seen.dropDuplicates(["bundle", "name"]), ["bundle", "name"], "left").select("bundle", "name", F.coalesce("canonical_sha256", "sha256", "bytes_sha256").alias("hash"))
        if section == "inputs":
            thin = report.filter("a.bundle_mode = 'thin'").select("bundle", F.explode("a.datasource_inputs").alias("d"))
            rows = rows.unionByName(thin.select("bundle", F.col("d.datasource").alias("name"), F.col("d.sha256").alias("hash")))
        last = rows.filter("hash IS NOT NULL").groupBy("bundle", "name").agg(F.max("hash").alias("hash"))
        return last.groupBy("bundle").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "hash"))))).alias(section))

    ids = report.join(evidence.select("bundle", F.col("a.run_id").alias("r"), F.col("a.created_at").alias("c")), "bundle", "left").select(
        "bundle", F.coalesce("r", "a.run_id").alias("run_id"), F.coalesce("c", "a.created_at").alias("created_at")
    )
    joined = plan.join(steps, "bundle", "left").join(hashes("inputs"), "bundle", "left").join(hashes("outputs"), "bundle", "left").join(ids, "bundle", "left")
    none, empty = F.lit("[]"), F.lit("{}")
    return joined.select(
        "bundle",
        _fingerprint("plan", F.coalesce("steps", none), F.coalesce("inputs", empty), F.coalesce("outputs", empty)).alias("fingerprint"),
        "run_id",
        "created_at",
    )


def promoted_registry(files: DataFrame) -> DataFrame:
    """Candidate transforms as registry entries: bundle, transform_id, kind, version (0.1 if none), spec."""
    each = S.candidates(files).select("bundle", F.explode("a.transforms").alias("t"))
    return each.select("bundle", "t.transform_id", "t.kind", F.coalesce("t.version", F.lit("0.1")).alias("version"), "t.spec")


def table_facts(files: DataFrame) -> DataFrame:
    """What runs and plans say of tables: bundle, id, row_count, columns (of the last step that tells), sorted_by (JSON)."""
    told = S.artifact(files, S.EVIDENCE, S.EVIDENCE_DDL).select("bundle", F.posexplode("a.step_evidence").alias("at", "e"))
    rows = told.select("bundle", "at", F.explode("e.row_counts").alias("id", "n")).groupBy("bundle", "id").agg(F.max_by("n", "at").alias("row_count"))
    columns = told.select("bundle", "at", F.explode("e.columns").alias("id", "c")).groupBy("bundle", "id").agg(F.max_by("c", "at").alias("columns"))
    plan = S.artifact(files, S.PLAN, S.PLAN_DDL).select("bundle", F.explode(F.from_json("a.table_facts", "MAP<STRING, STRING>")).alias("id", "fact"))
    order = plan.select("bundle", "id", F.get_json_object("fact", "$.sorted_by").alias("sorted_by")).filter("sorted_by IS NOT NULL")
    return rows.join(columns, ["bundle", "id"], "full_outer").join(order, ["bundle", "id"], "full_outer")


def legacy_graph_nodes(files: DataFrame) -> DataFrame:
    """Nodes of the older graph form: steps, and tables and artifacts once each, with merged evidence and facts.

    bundle, id, kind (step, table, artifact), sha256, row_count, columns, sorted_by.
    """
    steps = S.plan_steps(files).select("bundle", F.col("step_id").alias("id"), F.lit("step").alias("kind"), F.lit(None).cast("string").alias("sha256"))
    tables = S.plan_steps(files).select("bundle", F.explode(F.concat("inputs", "outputs")).alias("id")).distinct()
    listed = S.entries(files).select("bundle", F.coalesce("name", F.element_at(F.split("path", "/"), -1)).alias("id"), "sha256", "section")
    best = listed.groupBy("bundle", "id").agg(F.min_by("sha256", F.when(F.col("section") == "artifacts", 1).otherwise(0)).alias("sha256"))
    as_tables = tables.join(best, ["bundle", "id"], "left").select("bundle", "id", F.lit("table").alias("kind"), "sha256")
    rest = best.join(tables, ["bundle", "id"], "left_anti").select("bundle", "id", F.lit("artifact").alias("kind"), "sha256")
    facts = table_facts(files).withColumn("kind", F.lit("table"))
    return steps.unionByName(as_tables).unionByName(rest).join(facts, ["bundle", "id", "kind"], "left")


def legacy_graph_edges(files: DataFrame) -> DataFrame:
    """Edges of the older graph form in plan order: bundle, position, src, dst."""
    s = S.plan_steps(files)
    into = s.select("bundle", "position", F.explode("inputs").alias("src"), F.col("step_id").alias("dst"))
    out = s.select("bundle", "position", F.col("step_id").alias("src"), F.explode("outputs").alias("dst"))
    return into.unionByName(out)


@F.pandas_udf(StringType())
def _without_hash(texts: pd.Series) -> pd.Series:
    from rippletrace.functions.canon import plain, sha256

    return texts.map(lambda t: sha256(plain({k: v for k, v in json.loads(t).items() if k != "content_hash"})))


def change_chain(changes: DataFrame) -> DataFrame:
    """Check stored changes (ws_id, text): change_id, content_hash_ok, parent_exists, parent_hash_ok (null without a parent)."""
    field = lambda n: F.get_json_object("text", f"$.{n}")
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "^sha256:", "")
    c = changes.select(
        "ws_id",
        field("change_id").alias("change_id"),
        bare(field("content_hash")).alias("content_hash"),
        F.regexp_replace(field("parent_change_id"), "^chg:", "").alias("parent"),
        bare(field("parent_hash")).alias("parent_hash"),
        _without_hash("text").alias("recomputed"),
    )
    parents = c.select("ws_id", F.regexp_replace("change_id", "^chg:", "").alias("parent"), F.col("content_hash").alias("of_parent"))
    joined = c.join(parents, ["ws_id", "parent"], "left")
    return joined.select(
        "ws_id",
        "change_id",
        (F.col("content_hash") == F.col("recomputed")).alias("content_hash_ok"),
        F.col("of_parent").isNotNull().alias("parent_exists"),
        F.when(F.col("of_parent").isNotNull(), F.col("of_parent") == F.col("parent_hash")).alias("parent_hash_ok"),
    )


def chain_of_rows(rows: DataFrame, group: str, order: str, content: Column) -> DataFrame:
    """Give each row of a group a hash over its content and its parent's hash-free content: group, order, hash, parent_hash.

    The parent is the row before, found by an equi-join on the order number.
    """
    own = rows.select(group, order, F.sha2(content, 256).alias("hash"))
    parent = own.select(group, (F.col(order) + 1).alias(order), F.col("hash").alias("parent_hash"))
    return own.join(parent, [group, order], "left")


def canonical_equal(a: Column, b: Column) -> Column:
    """Whether two JSON texts have the same canonical form."""
    return canonical_b(a).eqNullSafe(canonical_b(b))
