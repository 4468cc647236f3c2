"""JSON artifacts as tables: specifications, registries, bindings, raw schemas, lineage graphs.

A batch of documents is a table (pair_id, text). Explicit schemas read them; free
parameters stay JSON text. Nothing is inferred, and what does not parse is an issue row,
not a failed job.
"""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rippletrace.functions.canon import HASH_PREFIX, PARAMS_MOST, canonical_or_error, plain, strict
from rippletrace.schemas import BINDINGS_DDL, GRAPH_DDL, RAW_SCHEMA_DDL, REGISTRY_DDL, SPEC_DDL

# Top-level fields of each artifact, and the versions of versioned ones.
KNOWN_FIELDS = {
    "spec": ("spec_version", "study_id", "source_table", "sources", "derived", "constraints", "review"),
    "registry": ("registry_version", "transforms"),
    "bindings": ("table", "bindings"),
    "raw_schema": ("table", "columns"),
    "change": ("change_id", "parent_change_id", "parent_hash", "content_hash", "created_at", "author", "message", "changes"),
}
LEGACY_VERSION, CURRENT_VERSION = "0.6", "0.7"


def text_of(artifact: Any) -> str:
    """JSON text of a path, a dict or JSON text."""
    if isinstance(artifact, dict):
        return json.dumps(artifact, ensure_ascii=False)
    if isinstance(artifact, Path) or not str(artifact).lstrip().startswith("{"):
        return Path(artifact).read_text(encoding="utf-8")
    return str(artifact)


def documents(spark: SparkSession, artifacts: dict[str, Any]) -> DataFrame:
    """A batch of a few artifacts given by value or local path: pair_id, text."""
    return spark.createDataFrame([(k, text_of(v)) for k, v in artifacts.items()], "pair_id string, text string")


def scan(spark: SparkSession, path: str, pair_pattern: str = r"([^/]+)/[^/]+$") -> DataFrame:
    """A batch of files that Spark reads: pair_id (from the path by pattern), path, text."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.regexp_extract("path", pair_pattern, 1).alias("pair_id"), "path", F.col("content").cast("string").alias("text")
    )


def parsed(docs: DataFrame, ddl: str) -> DataFrame:
    """pair_id and the artifact as a struct ``a``; null where the text is no such JSON."""
    return docs.select("pair_id", F.from_json("text", ddl, {"mode": "PERMISSIVE"}).alias("a"))


def structure_issues(docs: DataFrame, artifact: str) -> DataFrame:
    """Documents that are no JSON object or have unknown top-level fields: pair_id, code, message."""
    keys = F.json_object_keys("text")
    known = F.array(*(F.lit(k) for k in KNOWN_FIELDS[artifact]))
    extra = F.array_except(keys, known)
    return docs.select(
        "pair_id",
        F.when(keys.isNull(), F.lit("INVALID_STRUCTURE")).when(F.size(extra) > 0, F.lit("UNKNOWN_FIELD")).alias("code"),
        F.when(keys.isNull(), F.lit("not a JSON object")).otherwise(F.concat(F.lit("unknown fields: "), F.array_join(F.array_sort(extra), ", "))).alias("message"),
    ).filter("code IS NOT NULL")


def versioned(docs: DataFrame, artifact: str, unknown_fields: str = "preserve") -> DataFrame:
    """Read documents with or without a schema_version: pair_id, text, schema_version, warnings, extra.

    Without a version a document counts as the legacy one, with a warning; any other
    version but the current one is an error; the result always reports the current one.
    Unknown fields are kept in ``extra`` with a warning, or fail the query, as asked.
    """
    version = F.get_json_object("text", "$.schema_version")
    known = F.array(*(F.lit(k) for k in (*KNOWN_FIELDS[artifact], "schema_version")))
    extra = F.array_sort(F.array_except(F.json_object_keys("text"), known))
    wrong = version.isNotNull() & ~version.isin(LEGACY_VERSION, CURRENT_VERSION)
    refused = (F.size(extra) > 0) & F.lit(unknown_fields == "reject")
    checked = (
        F.when(wrong, F.raise_error(F.concat(F.lit("unsupported schema_version "), version)))
        .when(refused, F.raise_error(F.concat(F.lit("unknown fields: "), F.array_join(extra, ", "))))
        .otherwise(F.lit(CURRENT_VERSION))
    )
    legacy = F.when(version.isNull(), F.lit("no schema_version: read as legacy"))
    kept = F.when(F.size(extra) > 0, F.concat(F.lit("unknown fields kept: "), F.array_join(extra, ", ")))
    warnings = F.array_compact(F.array(legacy, kept))
    return docs.select("pair_id", "text", checked.alias("schema_version"), warnings.alias("warnings"), extra.alias("extra"))


def elements(docs: DataFrame) -> DataFrame:
    """The elements of specifications, inputs sorted: the table that the operators compare.

    Parameters without a canonical form get no hash; :func:`params_issues` lists them.
    """
    spec = parsed(docs, SPEC_DDL)
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")

    def rows(field: str, kind: str, **given: Column) -> DataFrame:
        e = spec.select("pair_id", F.explode(f"a.{field}").alias("e"))
        return e.select(
            "pair_id",
            F.lit(kind).alias("kind"),
            F.col("e.id").alias("id"),
            F.col("e.name").alias("name"),
            given.get("type", none).alias("type"),
            given.get("transform_ref", none).alias("transform_ref"),
            given.get("params_hash", none).alias("params_hash"),
            given.get("inputs", F.lit(None).cast("array<string>")).alias("inputs"),
            given.get("expression", none).alias("expression"),
        )

    inputs = F.array_sort(F.coalesce("e.inputs", empty))
    canonical = canonical_or_error(F.coalesce("e.params", F.lit("{}")))
    return (
        rows("sources", "source", type=F.col("e.type"))
        .unionByName(
            rows(
                "derived",
                "derived",
                type=F.col("e.type"),
                transform_ref=F.col("e.transform_ref"),
                params_hash=F.when(~canonical.startswith("!"), F.concat(F.lit(HASH_PREFIX), F.sha2(canonical, 256))),
                inputs=inputs,
            )
        )
        .unionByName(rows("constraints", "constraint", inputs=inputs, expression=F.col("e.expression")))
    )


def params_issues(docs: DataFrame) -> DataFrame:
    """Parameters without a canonical form or beyond the size limit: pair_id, id, code, message."""
    c = params(docs).withColumn("canonical", canonical_or_error("params"))
    bad = F.col("canonical").startswith("!")
    large = F.length("canonical") > PARAMS_MOST
    return c.filter(bad | large).select(
        "pair_id",
        "id",
        F.when(bad, "INVALID_STRUCTURE").otherwise("PARAMS_TOO_LARGE").alias("code"),
        F.when(bad, F.expr("substr(canonical, 2)")).otherwise(F.format_string("parameters have %d characters", F.length("canonical"))).alias("message"),
    )


def params(docs: DataFrame) -> DataFrame:
    """pair_id, id and the parameters as JSON text, where a derived variable has any."""
    each = parsed(docs, SPEC_DDL).select("pair_id", F.explode("a.derived").alias("e"))
    return each.select("pair_id", "e.id", "e.params").filter("params IS NOT NULL")


def transforms(docs: DataFrame) -> DataFrame:
    """The entries of registries."""
    each = parsed(docs, REGISTRY_DDL).select("pair_id", F.explode("a.transforms").alias("e"))
    return each.select(
        "pair_id",
        "e.id",
        "e.version",
        "e.kind",
        F.lower("e.impl_fingerprint.digest").alias("digest"),
        "e.impl_fingerprint.source",
        "e.impl_fingerprint.ref",
    )


def bindings(docs: DataFrame) -> DataFrame:
    """The column bindings: pair_id, raw_column, source_id, position."""
    a = parsed(docs, BINDINGS_DDL)
    return a.select("pair_id", F.posexplode(F.map_entries("a.bindings")).alias("position", "e")).select(
        "pair_id", F.col("e.key").alias("raw_column"), F.col("e.value").alias("source_id"), "position"
    )


def raw_columns(docs: DataFrame) -> DataFrame:
    """The columns of raw schemas: pair_id, table, name, type."""
    a = parsed(docs, RAW_SCHEMA_DDL)
    return a.select("pair_id", F.col("a.table").alias("table"), F.explode("a.columns").alias("e")).select(
        "pair_id", "table", "e.name", "e.type"
    )


def graph_nodes(docs: DataFrame) -> DataFrame:
    """Steps and tables of lineage graphs."""
    each = parsed(docs, GRAPH_DDL).select("pair_id", F.explode("a.nodes").alias("e"))
    return each.select("pair_id", "e.*")


def graph_steps(docs: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return graph_nodes(docs).filter("kind = 'step'").select(
        "pair_id", "id", "op", "transform_class_id", "transform_id", "payload_sha256", F.coalesce("inputs", none).alias("inputs"), F.coalesce("outputs", none).alias("outputs")
    )


def graph_edges(docs: DataFrame) -> DataFrame:
    return parsed(docs, GRAPH_DDL).select("pair_id", F.explode("a.edges").alias("e")).select("pair_id", "e.*")


def graph_versions(docs: DataFrame) -> DataFrame:
    return parsed(docs, GRAPH_DDL).select("pair_id", "a.schema_version")


def write_canonical(value: Any, path: str) -> None:
    """One result as canonical JSON with a final newline."""
    Path(path).write_text(plain(value) + "\n", encoding="utf-8")


def write_pretty(value: Any, path: str) -> None:
    """One result as indented JSON."""
    Path(path).write_text(json.dumps(value, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


def write_canonical_lines(df: DataFrame, path: str) -> None:
    """Many results, one canonical JSON text a line (column ``text``), written by Spark."""
    df.select("text").write.mode("overwrite").text(path)


def strict_text(value: Any) -> str:
    return strict(value)
