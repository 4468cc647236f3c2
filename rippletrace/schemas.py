"""Explicit schemas of all artifacts; nothing is inferred."""

from __future__ import annotations

SPEC_DDL = (
    "spec_version STRING, study_id STRING, source_table STRING, "
    "sources ARRAY<STRUCT<id: STRING, name: STRING, type: STRING>>, "
    "derived ARRAY<STRUCT<id: STRING, name: STRING, type: STRING, transform_ref: STRING, inputs: ARRAY<STRING>, "
    "params: STRING, notes: STRING>>, "
    "constraints ARRAY<STRUCT<id: STRING, name: STRING, inputs: ARRAY<STRING>, expression: STRING, notes: STRING>>"
)
REGISTRY_DDL = (
    "registry_version STRING, transforms ARRAY<STRUCT<id: STRING, version: STRING, kind: STRING, "
    "signature: STRUCT<inputs: ARRAY<STRING>, output: STRING>, params_schema_hash: STRING, "
    "impl_fingerprint: STRUCT<algo: STRING, source: STRING, ref: STRING, digest: STRING>, "
    "history: ARRAY<STRUCT<timestamp: STRING, change_type: STRING, digest: STRING>>>>"
)
BINDINGS_DDL = "table STRING, bindings MAP<STRING, STRING>"
RAW_SCHEMA_DDL = "table STRING, columns ARRAY<STRUCT<name: STRING, type: STRING>>"
GRAPH_DDL = (
    "schema_version INT, producer STRUCT<name: STRING, version: STRING>, "
    "nodes ARRAY<STRUCT<id: STRING, kind: STRING, op: STRING, transform_class_id: STRING, transform_id: STRING, "
    "inputs: ARRAY<STRING>, outputs: ARRAY<STRING>, payload_sha256: STRING, producer: STRING, "
    "consumers: ARRAY<STRING>>>, edges ARRAY<STRUCT<src: STRING, dst: STRING, kind: STRING>>"
)

# Tables that the operators exchange: a batch of comparisons, keyed by pair_id and side (1 or 2).
ELEMENTS_DDL = (
    "pair_id STRING, kind STRING, id STRING, name STRING, type STRING, transform_ref STRING, params_hash STRING, "
    "inputs ARRAY<STRING>, expression STRING"
)
TRANSFORMS_DDL = (
    "pair_id STRING, id STRING, version STRING, kind STRING, digest STRING, source STRING, ref STRING"
)
BINDING_ROWS_DDL = "pair_id STRING, raw_column STRING, source_id STRING, position INT"
EVENTS_DDL = (
    "pair_id STRING, change_type STRING, element_id STRING, old_value STRING, new_value STRING, details STRING"
)
IMPACT_DDL = "pair_id STRING, var_id STRING, reason STRING, event_seq LONG, path ARRAY<STRING>"


def json_schemas() -> dict[str, str]:
    """The schemas as JSON text, for snapshots."""
    named = {
        "spec": SPEC_DDL,
        "registry": REGISTRY_DDL,
        "bindings": BINDINGS_DDL,
        "raw_schema": RAW_SCHEMA_DDL,
        "graph": GRAPH_DDL,
        "elements": ELEMENTS_DDL,
        "transforms": TRANSFORMS_DDL,
        "events": EVENTS_DDL,
        "impact": IMPACT_DDL,
    }
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    return {k: spark.createDataFrame([], v).schema.json() for k, v in named.items()}
