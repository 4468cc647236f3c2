"""Mapping specifications projected from the star-schema tables, as SQL that Spark and DuckDB share.

Version 1: regions and parts are sources; nations, customers, suppliers and orders are
derived; every tenth supplier has a constraint that its orders also depend on. Version 2
edits it by modulo: parts go or are renamed, transforms, parameters, types and inputs
change, customers go together with their use, new elements come.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippletrace.plans.bundle_workload import SPEC_VIEWS, bundle_views
from rippletrace.runtime import by_measured_size, stored

PAIR = "tpch"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations", "documents")

_REF_CUSTOMER = "concat('t:', lower(c_mktsegment))"
_REF_ORDER = "concat('t:', lower(replace(replace(o_orderpriority, ' ', '_'), '-', '_')))"

#: Common table expressions by name, in order of dependence.
VIEWS: dict[str, str] = {
    "v1_elements": f"""
        SELECT 'source' AS kind, concat('s:R', CAST(r_regionkey AS STRING)) AS id, r_name AS name, 'string' AS type,
               CAST(NULL AS STRING) AS transform_ref, CAST(NULL AS STRING) AS params, CAST(NULL AS STRING) AS expression FROM region
        UNION ALL SELECT 'source', concat('s:P', CAST(p_partkey AS STRING)), p_name, 'string', NULL, NULL, NULL FROM part
        UNION ALL SELECT 'derived', concat('d:N', CAST(n_nationkey AS STRING)), n_name, 'string', 't:geo', '{{}}', NULL FROM nation
        UNION ALL SELECT 'derived', concat('d:C', CAST(c_custkey AS STRING)), c_name,
               CASE WHEN c_custkey % 3 = 0 THEN 'int' ELSE 'string' END, {_REF_CUSTOMER},
               concat('{{"k":', CAST(c_custkey % 7 AS STRING), '}}'), NULL FROM customer
        UNION ALL SELECT 'derived', concat('d:S', CAST(s_suppkey AS STRING)), s_name, 'string', 't:supply',
               concat('{{"k":', CAST(s_suppkey % 5 AS STRING), '}}'), NULL FROM supplier
        UNION ALL SELECT 'derived', concat('d:O', CAST(o_orderkey AS STRING)), concat('order ', CAST(o_orderkey AS STRING)),
               'int', {_REF_ORDER}, concat('{{"k":', CAST(o_orderkey % 11 AS STRING), '}}'), NULL FROM orders
        UNION ALL SELECT 'constraint', concat('c:L', CAST(s_suppkey AS STRING)), concat('limit ', CAST(s_suppkey AS STRING)),
               NULL, NULL, NULL, concat('x < ', CAST(s_suppkey % 4 AS STRING)) FROM supplier WHERE s_suppkey % 10 = 0""",
    "v1_inputs": """
        SELECT concat('d:N', CAST(n_nationkey AS STRING)) AS id, concat('s:R', CAST(n_regionkey AS STRING)) AS input FROM nation
        UNION ALL SELECT concat('d:C', CAST(c_custkey AS STRING)), concat('d:N', CAST(c_nationkey AS STRING)) FROM customer
        UNION ALL SELECT concat('d:S', CAST(s_suppkey AS STRING)), concat('d:N', CAST(s_nationkey AS STRING)) FROM supplier
        UNION ALL SELECT concat('c:L', CAST(s_suppkey AS STRING)), concat('d:S', CAST(s_suppkey AS STRING)) FROM supplier
               WHERE s_suppkey % 10 = 0
        UNION ALL SELECT concat('d:O', CAST(o_orderkey AS STRING)), concat('d:C', CAST(o_custkey AS STRING)) FROM orders
        UNION ALL (SELECT DISTINCT concat('d:O', CAST(l_orderkey AS STRING)), concat('d:S', CAST(l_suppkey AS STRING)) FROM lineitem)
        UNION ALL (SELECT DISTINCT concat('d:O', CAST(l_orderkey AS STRING)), concat('s:P', CAST(l_partkey AS STRING)) FROM lineitem)
        UNION ALL (SELECT DISTINCT concat('d:O', CAST(l_orderkey AS STRING)), concat('c:L', CAST(l_suppkey AS STRING)) FROM lineitem
               WHERE l_suppkey % 10 = 0)""",
    "v2_elements": f"""
        SELECT 'source' AS kind, concat('s:R', CAST(r_regionkey AS STRING)) AS id, r_name AS name, 'string' AS type,
               CAST(NULL AS STRING) AS transform_ref, CAST(NULL AS STRING) AS params, CAST(NULL AS STRING) AS expression FROM region
        UNION ALL SELECT 'source', concat('s:P', CAST(p_partkey AS STRING)),
               CASE WHEN p_partkey % 53 = 0 THEN concat(p_name, ' v2') ELSE p_name END, 'string', NULL, NULL, NULL
               FROM part WHERE p_partkey % 101 <> 0
        UNION ALL SELECT 'source', concat('s:P', CAST(1000000 + p_partkey AS STRING)), concat('new ', p_name), 'string', NULL, NULL, NULL
               FROM part WHERE p_partkey % 97 = 1
        UNION ALL SELECT 'derived', concat('d:N', CAST(n_nationkey AS STRING)), n_name, 'string', 't:geo', '{{}}', NULL FROM nation
        UNION ALL SELECT 'derived', concat('d:C', CAST(c_custkey AS STRING)), c_name,
               CASE WHEN c_custkey % 89 = 0 THEN 'decimal' WHEN c_custkey % 3 = 0 THEN 'int' ELSE 'string' END,
               CASE WHEN c_custkey % 97 = 0 THEN 't:rewritten' ELSE {_REF_CUSTOMER} END,
               concat('{{"k":', CAST(c_custkey % 7 AS STRING), '}}'), NULL FROM customer WHERE c_custkey % 211 <> 0
        UNION ALL SELECT 'derived', concat('d:S', CAST(s_suppkey AS STRING)), s_name, 'string', 't:supply',
               CASE WHEN s_suppkey % 17 = 0 THEN concat('{{"k":', CAST(s_suppkey % 5 AS STRING), ',"new":1}}')
                    ELSE concat('{{"k":', CAST(s_suppkey % 5 AS STRING), '}}') END, NULL FROM supplier
        UNION ALL SELECT 'derived', concat('d:O', CAST(o_orderkey AS STRING)), concat('order ', CAST(o_orderkey AS STRING)),
               'int', {_REF_ORDER}, concat('{{"k":', CAST(o_orderkey % 11 AS STRING), '}}'), NULL FROM orders
        UNION ALL SELECT 'constraint', concat('c:L', CAST(s_suppkey AS STRING)),
               CASE WHEN s_suppkey % 30 = 0 THEN concat('bound ', CAST(s_suppkey AS STRING)) ELSE concat('limit ', CAST(s_suppkey AS STRING)) END,
               NULL, NULL, NULL,
               CASE WHEN s_suppkey % 40 = 0 THEN concat('x <= ', CAST(s_suppkey % 4 AS STRING)) ELSE concat('x < ', CAST(s_suppkey % 4 AS STRING)) END
               FROM supplier WHERE s_suppkey % 10 = 0""",
    "v2_inputs": """
        SELECT i.id AS id, i.input AS input FROM v1_inputs i
        WHERE i.id IN (SELECT id FROM v2_elements) AND i.input IN (SELECT id FROM v2_elements)
          AND NOT (i.id LIKE 'd:O%' AND i.input LIKE 's:P%' AND CAST(substr(i.id, 4) AS BIGINT) % 61 = 0
                   AND CAST(substr(i.input, 4) AS BIGINT) % 2 = 0)""",
    "v1_transforms": """
        SELECT DISTINCT transform_ref AS id, '1' AS version, sha256(concat(transform_ref, '1')) AS digest FROM v1_elements
        WHERE transform_ref IS NOT NULL
        UNION ALL SELECT 't:retired', '1', sha256('t:retired1')""",
    "v2_transforms": """
        SELECT DISTINCT transform_ref AS id,
               CASE WHEN transform_ref IN ('t:machinery', 't:building') THEN '2' ELSE '1' END AS version,
               sha256(concat(transform_ref, CASE WHEN transform_ref IN ('t:machinery') THEN '2' ELSE '1' END)) AS digest
        FROM v2_elements WHERE transform_ref IS NOT NULL AND transform_ref <> 't:furniture'""",
    "v1_bindings": """
        SELECT concat('RAW_', CAST(p_partkey AS STRING)) AS raw_column, concat('s:P', CAST(p_partkey AS STRING)) AS source_id FROM part
        UNION ALL SELECT concat('REG_', r_name), concat('s:R', CAST(r_regionkey AS STRING)) FROM region""",
    "v2_bindings": """
        SELECT CASE WHEN p_partkey % 31 = 0 THEN concat('NEW_', CAST(p_partkey AS STRING)) ELSE concat('RAW_', CAST(p_partkey AS STRING)) END AS raw_column,
               CASE WHEN p_partkey % 43 = 0 THEN concat('s:P', CAST(p_partkey + 1 AS STRING)) ELSE concat('s:P', CAST(p_partkey AS STRING)) END AS source_id
        FROM part WHERE p_partkey % 29 <> 0
        UNION ALL SELECT concat('ALT_', CAST(p_partkey AS STRING)), concat('s:P', CAST(p_partkey AS STRING)) FROM part WHERE p_partkey % 37 = 0
        UNION ALL SELECT concat('REG_', r_name), concat('s:R', CAST(r_regionkey AS STRING)) FROM region""",
    "raw_columns": """
        SELECT concat('RAW_', CAST(p_partkey AS STRING)) AS name FROM part WHERE p_partkey % 23 <> 0
        UNION ALL SELECT concat('REG_', r_name) FROM region""",
    # lineage graphs: orders and customers are steps, suppliers and regions are tables
    "g1_steps": """
        SELECT concat('s:O', CAST(o_orderkey AS STRING)) AS id, concat('op', CAST(o_orderkey % 5 AS STRING)) AS op,
               concat('class', CAST(o_orderkey % 997 AS STRING)) AS transform_class_id,
               concat('tr', CAST(o_orderkey % 499 AS STRING)) AS transform_id, concat('pay', CAST(o_orderkey % 301 AS STRING)) AS payload FROM orders
        UNION ALL SELECT concat('s:S', CAST(s_suppkey AS STRING)), 'load', concat('load', CAST(s_suppkey AS STRING)), 'tl', 'pl' FROM supplier""",
    "g1_edges": """
        SELECT concat('s:S', CAST(s_suppkey AS STRING)) AS src, concat('t:S', CAST(s_suppkey AS STRING)) AS dst, 'produces' AS kind FROM supplier
        UNION ALL (SELECT DISTINCT concat('t:S', CAST(l_suppkey AS STRING)), concat('s:O', CAST(l_orderkey AS STRING)), 'consumes' FROM lineitem)
        UNION ALL SELECT concat('s:O', CAST(o_orderkey AS STRING)), concat('t:O', CAST(o_orderkey AS STRING)), 'produces' FROM orders
        UNION ALL SELECT concat('t:O', CAST(o_orderkey AS STRING)), concat('s:O', CAST(o_orderkey * 2 + 1 AS STRING)), 'consumes' FROM orders
               WHERE o_orderkey > 0 AND o_orderkey * 2 + 1 IN (SELECT o_orderkey FROM orders)""",
    "g2_steps": """
        SELECT CASE WHEN o_orderkey % 701 = 0 THEN concat('s:X', CAST(o_orderkey AS STRING)) ELSE concat('s:O', CAST(o_orderkey AS STRING)) END AS id,
               concat('op', CAST(o_orderkey % 5 AS STRING)) AS op,
               concat('class', CAST(o_orderkey % 997 AS STRING)) AS transform_class_id,
               CASE WHEN o_orderkey % 1402 = 0 THEN 'trx' ELSE concat('tr', CAST(o_orderkey % 499 AS STRING)) END AS transform_id,
               CASE WHEN o_orderkey % 503 = 0 THEN 'changed' ELSE concat('pay', CAST(o_orderkey % 301 AS STRING)) END AS payload
        FROM orders WHERE o_orderkey % 809 <> 5
        UNION ALL SELECT concat('s:S', CAST(s_suppkey AS STRING)), 'load', concat('load', CAST(s_suppkey AS STRING)),
               CASE WHEN s_suppkey % 41 = 0 THEN 'tl2' ELSE 'tl' END, 'pl' FROM supplier""",
    "g2_edges": """
        SELECT x.src AS src, x.dst AS dst, x.kind AS kind FROM (
          SELECT CASE WHEN e.src LIKE 's:O%' AND CAST(substr(e.src, 4) AS BIGINT) % 701 = 0 THEN concat('s:X', substr(e.src, 4)) ELSE e.src END AS src,
                 CASE WHEN e.dst LIKE 's:O%' AND CAST(substr(e.dst, 4) AS BIGINT) % 701 = 0 THEN concat('s:X', substr(e.dst, 4)) ELSE e.dst END AS dst,
                 e.kind AS kind
          FROM g1_edges e
          WHERE NOT (e.kind = 'consumes' AND e.src LIKE 't:S%' AND CAST(substr(e.dst, 4) AS BIGINT) % 607 = 0
                     AND CAST(substr(e.src, 4) AS BIGINT) % 2 = 0)) x
        WHERE (x.src LIKE 't:%' OR x.src IN (SELECT id FROM g2_steps)) AND (x.dst LIKE 't:%' OR x.dst IN (SELECT id FROM g2_steps))""",
}


VIEWS |= SPEC_VIEWS | bundle_views(1) | bundle_views(2)


def with_views(*names: str) -> str:
    """A WITH clause for DuckDB that defines the named views and what they rest on."""
    need: list[str] = []

    def visit(name: str) -> None:
        for other in VIEWS:
            if other != name and re.search(rf"\b{other}\b", VIEWS[name]):
                visit(other)
        if name not in need:
            need.append(name)

    for n in names:
        visit(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in need).replace("AS STRING", "AS VARCHAR")


def _lists(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Sorted distinct values by key. Rows go to their key before they are gathered: few share one, so that
    gathering on both sides of a shuffle would sort them twice."""
    return rows.repartition(key).groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(name))


class Workload:
    """The projected artifacts of a folder as DataFrames in the operators' form."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = by_measured_size(spark), sf_dir
        self.written: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def base(self, name: str) -> DataFrame:
        """A view that others rest on, written once."""
        if name not in self.written:
            self.written[name] = stored(self.view(name), name)
        return self.written[name]

    def view(self, name: str) -> DataFrame:
        """A projected view. What it reads are temporary views only until the plan is resolved."""
        if name in self.written:
            return self.written[name]
        text = VIEWS[name].replace("sha256(", "sha(")
        text = re.sub(r"\bsha\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)", r"sha2(\1, 256)", text)
        mark = f"rippletrace_{uuid.uuid4().hex[:8]}"
        used = {t: t for t in (*TABLES, *VIEWS) if t != name and re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", text)}
        for t in used:
            used[t] = f"{mark}_{t}"
            (self.base(t) if t in VIEWS else self.table(t)).createOrReplaceTempView(used[t])
            text = re.sub(rf"\b(FROM|JOIN)(\s+){t}\b", rf"\1\2{used[t]}", text)
        try:
            return self.spark.sql(text)
        finally:
            for t in used.values():
                self.spark.catalog.dropTempView(t)

    def elements(self, side: int, kind: str | None = None, wired: bool = True) -> DataFrame:
        """Elements with sorted inputs: pair_id, kind, id, name, type, transform_ref, params_hash, inputs, expression.

        Of one kind only those elements' inputs are gathered; not wired, what has inputs has an empty list of them.
        """
        elements = self.view(f"v{side}_elements")
        if kind:
            elements = elements.filter(F.col("kind") == kind)
        if wired and kind != "source":
            # version 2's inputs rest on version 1's
            inputs = self.base("v1_inputs") if side == 1 else self.view("v2_inputs")
            if kind == "constraint":  # few; nearly all inputs are those of derived variables, which the join below picks out
                inputs = inputs.join(elements.select("id"), "id", "left_semi")
            elements = elements.join(_lists(inputs, "id", "input", "inputs"), "id", "left")
        else:
            elements = elements.withColumn("inputs", F.array().cast("array<string>"))
        return elements.select(
            F.lit(PAIR).alias("pair_id"),
            "kind",
            "id",
            "name",
            "type",
            "transform_ref",
            F.concat(F.lit("sha256:"), F.sha2("params", 256)).alias("params_hash"),
            F.when(F.col("kind") != "source", F.coalesce("inputs", F.array().cast("array<string>"))).alias("inputs"),
            "expression",
        )

    def edges(self, side: int) -> DataFrame:
        return self.view(f"v{side}_inputs").select(
            F.lit(PAIR).alias("pair_id"), F.col("input").alias("src"), F.col("id").alias("dst")
        )

    def transforms(self, side: int) -> DataFrame:
        return self.view(f"v{side}_transforms").select(
            F.lit(PAIR).alias("pair_id"),
            "id",
            "version",
            F.lit("builtin").alias("kind"),
            "digest",
            F.lit("code").alias("source"),
            F.col("id").alias("ref"),
        )

    def bindings(self, side: int) -> DataFrame:
        return self.view(f"v{side}_bindings").select(
            F.lit(PAIR).alias("pair_id"), "raw_column", "source_id", F.lit(0).alias("position")
        )

    def raw_columns(self) -> DataFrame:
        return self.view("raw_columns").select(F.lit(PAIR).alias("pair_id"), F.col("name"))

    def steps(self, side: int) -> DataFrame:
        edges = self.base(f"g{side}_edges")
        ins = _lists(edges.filter("kind = 'consumes'").select(F.col("dst").alias("id"), "src"), "id", "src", "inputs")
        outs = _lists(edges.filter("kind = 'produces'").select(F.col("src").alias("id"), "dst"), "id", "dst", "outputs")
        none = F.array().cast("array<string>")
        return (
            self.view(f"g{side}_steps")
            .join(ins, "id", "left")
            .join(outs, "id", "left")
            .select(
                F.lit(PAIR).alias("pair_id"),
                "id",
                "op",
                "transform_class_id",
                "transform_id",
                F.col("payload").alias("payload_sha256"),
                F.coalesce("inputs", none).alias("inputs"),
                F.coalesce("outputs", none).alias("outputs"),
            )
        )

    def graph_edges(self, side: int) -> DataFrame:
        return self.base(f"g{side}_edges").select(F.lit(PAIR).alias("pair_id"), "src", "dst", "kind")
