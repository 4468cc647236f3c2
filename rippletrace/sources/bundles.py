"""Run bundles: folders of JSON witnesses, read as one table of files.

Bundles are addressed by (bundle, path); every lookup is a join on that pair, so a job
reads any number of bundles at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rippletrace.functions.canon import file_hash_of
from rippletrace.functions.ids import unsafe_path

# Names of a bundle's files.
REPORT, PLAN, REGISTRY, GRAPH = "report.json", "artifacts/plan.ir.json", "artifacts/registry.candidate.json", "artifacts/graph.json"
EVIDENCE, SCHEMA_EVIDENCE, SCHEMA_LOCK, VARIABLES = (
    "artifacts/runtime.evidence.json",
    "artifacts/schema.evidence.json",
    "schema.lock.json",
    "artifacts/vars.graph.json",
)
OWN_REGISTRIES = ("transform_registry.json", "artifacts/transform_registry.json")
REPORT_VERSIONS = ("0.2", "0.3")

ENTRY = "STRUCT<role: STRING, name: STRING, path: STRING, sha256: STRING>"
REPORT_DDL = (
    "report_schema_version STRING, status STRING, primary_error STRUCT<code: STRING, message: STRING>, "
    f"inputs ARRAY<{ENTRY}>, artifacts ARRAY<{ENTRY}>, outputs ARRAY<{ENTRY}>, plan_path STRING, bundle_mode STRING, "
    "datasource_inputs ARRAY<STRUCT<datasource: STRING, name: STRING, embedded: BOOLEAN, sha256: STRING, size_bytes: LONG, ref: STRING>>, "
    "settings STRUCT<datasources: ARRAY<STRING>>, run_id STRING, created_at STRING"
)
PLAN_DDL = (
    "steps ARRAY<STRUCT<kind: STRING, op: STRING, inputs: ARRAY<STRING>, outputs: ARRAY<STRING>, params: STRING, "
    "transform_id: STRING, transform_class_id: STRING, step_id: STRING>>, tables ARRAY<STRING>, table_facts STRING, "
    "datasources MAP<STRING, STRING>"
)
CANDIDATES_DDL = (
    "registry_version STRING, transforms ARRAY<STRUCT<transform_id: STRING, kind: STRING, version: STRING, spec: STRING>>, "
    "index MAP<STRING, STRING>"
)
VARIABLES_DDL = (
    "nodes ARRAY<STRUCT<id: STRING, table_id: STRING, col: STRING, origin: STRING, expr_sha256: STRING, payload_sha256: STRING, "
    "producing_step_id: STRING, transform_id: STRING>>, edges ARRAY<STRUCT<src: STRING, dst: STRING, kind: STRING>>"
)
EVIDENCE_DDL = (
    "run_id STRING, created_at STRING, plan_ir STRUCT<path: STRING, sha256: STRING>, "
    "inputs ARRAY<STRUCT<name: STRING, path: STRING, bytes_sha256: STRING, canonical_sha256: STRING>>, "
    "outputs ARRAY<STRUCT<name: STRING, path: STRING, bytes_sha256: STRING, canonical_sha256: STRING, column_stats: MAP<STRING, STRING>>>, "
    "tables MAP<STRING, STRUCT<columns: MAP<STRING, STRING>>>, column_stats MAP<STRING, MAP<STRING, STRING>>, "
    "step_evidence ARRAY<STRUCT<row_counts: MAP<STRING, LONG>, columns: MAP<STRING, ARRAY<STRING>>>>"
)


def files(spark: SparkSession, root: str) -> DataFrame:
    """All files of all bundles below ``root``: bundle, path, content, sha256 (canonical for .json)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(root)
    whole = at.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
    inner = F.substr("path", F.lit(len(whole) + 2))  # every path starts with the qualified root
    parted = found.select(
        F.regexp_extract(inner, "^([^/]+)/", 1).alias("bundle"), F.regexp_extract(inner, "^[^/]+/(.*)$", 1).alias("path"), "content"
    )
    return parted.filter("bundle <> '' AND path <> ''").withColumn("sha256", file_hash_of(F.col("path"), F.col("content")))


def part(bundle_files: DataFrame, path: str | Column, ddl: str) -> DataFrame:
    """One parsed file of each bundle: bundle, a; null if it is no such JSON."""
    return bundle_files.filter(F.col("path") == path).select("bundle", F.from_json(F.col("content").cast("string"), ddl).alias("a"))


def reports(bundle_files: DataFrame) -> DataFrame:
    return part(bundle_files, REPORT, REPORT_DDL)


def report_errors(bundle_files: DataFrame) -> DataFrame:
    """Bundles whose report has an unknown version or names a path outside the bundle: bundle, code, message."""
    r = reports(bundle_files)
    version = F.col("a.report_schema_version")
    bad = r.filter(version.isNull() | ~version.isin(*REPORT_VERSIONS)).select(
        "bundle", F.lit("INVALID_SCHEMA_VERSION").alias("code"), F.concat(F.lit("report version "), F.coalesce(version, F.lit("none"))).alias("message")
    )
    outside = entries(bundle_files).filter(unsafe_path(F.col("path"))).select(
        "bundle", F.lit("INVALID_STRUCTURE").alias("code"), F.concat(F.lit("path leaves the bundle: "), F.col("path")).alias("message")
    )
    return bad.unionByName(outside)


def entries(bundle_files: DataFrame) -> DataFrame:
    """What reports list: bundle, section, position, name, path (forward slashes), sha256."""
    r = reports(bundle_files)
    out = None
    for section in ("inputs", "artifacts", "outputs"):
        rows = r.select("bundle", F.lit(section).alias("section"), F.posexplode(f"a.{section}").alias("position", "e")).select(
            "bundle", "section", "position", "e.name", F.regexp_replace("e.path", r"\\", "/").alias("path"), "e.sha256"
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def located(bundle_files: DataFrame, name: str, default: str) -> DataFrame:
    """Where each bundle has an artifact: bundle, path. A report's own list decides if it is not empty."""
    listed = entries(bundle_files).filter("section = 'artifacts'")
    short = name.split("/")[-1]
    mine = listed.filter((F.col("name") == short) | F.col("path").endswith(short)).groupBy("bundle").agg(F.min_by("path", "position").alias("listed"))
    has_list = listed.select("bundle").distinct().withColumn("has_list", F.lit(True))
    bundles = bundle_files.filter(F.col("path") == REPORT).select("bundle")
    return (
        bundles.join(mine, "bundle", "left")
        .join(has_list, "bundle", "left")
        .select("bundle", F.when(F.coalesce("has_list", F.lit(False)), F.col("listed")).otherwise(F.lit(default)).alias("path"))
        .filter("path IS NOT NULL")
    )


def artifact(bundle_files: DataFrame, name: str, ddl: str) -> DataFrame:
    """The parsed artifact of each bundle that has it: bundle, path, sha256, a."""
    at = located(bundle_files, name, name)
    return bundle_files.join(at, ["bundle", "path"]).select("bundle", "path", "sha256", F.from_json(F.col("content").cast("string"), ddl).alias("a"))


def plan_steps(bundle_files: DataFrame) -> DataFrame:
    """Steps of the plans: bundle, position and the step's fields."""
    p = artifact(bundle_files, PLAN, PLAN_DDL)
    return p.select("bundle", F.posexplode("a.steps").alias("position", "e")).select("bundle", "position", "e.*")


def candidates(bundle_files: DataFrame) -> DataFrame:
    return artifact(bundle_files, REGISTRY, CANDIDATES_DDL)


def lineage_graphs(bundle_files: DataFrame) -> DataFrame:
    """Graphs that a report lists under exactly ``artifacts/graph.json`` with a matching hash: pair_id, text.

    Bundles that fail this are not returned; :func:`graph_errors` says why.
    """
    listed = entries(bundle_files).filter((F.col("section") == "artifacts") & (F.col("path") == GRAPH))
    same = bundle_files.join(listed.select("bundle", "path", F.col("sha256").alias("expected")), ["bundle", "path"]).filter("sha256 = expected")
    return same.select(F.col("bundle").alias("pair_id"), F.col("content").cast("string").alias("text"), "sha256")


def graph_errors(bundle_files: DataFrame) -> DataFrame:
    """bundle, code, message for bundles without a usable lineage graph."""
    listed = entries(bundle_files).filter((F.col("section") == "artifacts") & (F.col("path") == GRAPH)).select("bundle", "path", F.col("sha256").alias("expected"))
    bundles = bundle_files.filter(F.col("path") == REPORT).select("bundle")
    held = bundle_files.select("bundle", "path", "sha256")
    state = bundles.join(listed, "bundle", "left").join(held, ["bundle", "path"], "left")
    code = (
        F.when(F.col("expected").isNull(), "INVALID_STRUCTURE").when(F.col("sha256").isNull(), "FILE_NOT_FOUND").when(F.col("sha256") != F.col("expected"), "HASH_MISMATCH")
    )
    return state.select("bundle", code.alias("code"), F.concat(F.lit("lineage graph: "), F.lower(code)).alias("message")).filter("code IS NOT NULL")


def schema_columns(bundle_files: DataFrame, name: str = SCHEMA_EVIDENCE) -> DataFrame:
    """Columns of schema evidence in either shape: bundle as pair_id, table, column, type.

    A table maps columns to types, or lists {name, type}; what parses as neither gives no rows.
    """
    text = bundle_files.join(located(bundle_files, name, name), ["bundle", "path"]).select("bundle", F.get_json_object(F.col("content").cast("string"), "$.tables").alias("t"))
    tables = text.select("bundle", F.explode(F.from_json("t", "MAP<STRING, STRING>")).alias("table", "cols"))
    as_map = F.map_entries(F.from_json("cols", "MAP<STRING, STRING>"))
    as_list = F.transform(F.from_json("cols", "ARRAY<STRUCT<name: STRING, type: STRING>>"), lambda c: F.struct(c["name"].alias("key"), c["type"].alias("value")))
    chosen = F.when(F.ltrim("cols").startswith("["), as_list).otherwise(as_map)
    return tables.select(F.col("bundle").alias("pair_id"), "table", F.explode(chosen).alias("e")).select("pair_id", "table", F.col("e.key").alias("column"), F.col("e.value").alias("type"))


def lock_columns(bundle_files: DataFrame) -> DataFrame:
    """Columns of schema locks in either shape: pair_id, table (the data source), column, type."""
    lock = bundle_files.filter(F.col("path").endswith(SCHEMA_LOCK)).select("bundle", F.get_json_object(F.col("content").cast("string"), "$.datasources").alias("d"))
    as_map = F.transform(F.map_entries(F.from_json("d", "MAP<STRING, STRING>")), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("body")))
    as_list = F.transform(F.from_json("d", "ARRAY<STRING>"), lambda s: F.struct(F.get_json_object(s, "$.name").alias("name"), s.alias("body")))
    each = lock.select("bundle", F.explode(F.when(F.ltrim("d").startswith("["), as_list).otherwise(as_map)).alias("e"))
    columns = F.get_json_object("e.body", "$.columns")
    typed = F.when(
        F.ltrim(columns).startswith("["),
        F.transform(F.from_json(columns, "ARRAY<STRUCT<name: STRING, type: STRING>>"), lambda c: F.struct(c["name"].alias("key"), c["type"].alias("value"))),
    ).otherwise(F.map_entries(F.from_json(columns, "MAP<STRING, STRING>")))
    return each.select(F.col("bundle").alias("pair_id"), F.col("e.name").alias("table"), F.explode(typed).alias("c")).select("pair_id", "table", F.col("c.key").alias("column"), F.col("c.value").alias("type"))
