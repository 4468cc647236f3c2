"""Validation of specifications: one rule per kind of issue, errors and warnings together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippletrace.functions import ids
from rippletrace.functions.canon import PARAMS_LARGE, canonical_a
from rippletrace.operators.bindings import ambiguous_bindings, invalid_bindings, missing_bindings
from rippletrace.operators.graph import cycle_report, edges_of, missing_dependencies
from rippletrace.operators.impact import transform_ref_errors

# The issue codes.
CODES = (
    "INVALID_STRUCTURE", "INVALID_SCHEMA_VERSION", "UNKNOWN_FIELD", "DUPLICATE_ID", "DUPLICATE_INPUT", "INVALID_ID",
    "MISSING_INPUT", "CYCLE_DETECTED", "DEPENDENCY_GRAPH_ERROR", "MISSING_TRANSFORM_REF", "REGISTRY_LOAD_ERROR",
    "MISSING_BINDING", "AMBIGUOUS_BINDING", "INVALID_RAW_COLUMN", "BINDINGS_LOAD_ERROR", "RAW_SCHEMA_LOAD_ERROR",
    "PARAMS_LARGE", "PARAMS_TOO_LARGE",
)


def issue(
    df: DataFrame, code: str, severity: str, message: Column, element: Column | None = None, missing: Column | None = None, raw: Column | None = None
) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        "pair_id",
        F.lit(code).alias("code"),
        F.lit(severity).alias("severity"),
        message.alias("message"),
        (none if element is None else element).alias("element_id"),
        (none if missing is None else missing).alias("missing_id"),
        (none if raw is None else raw).alias("raw_column"),
    )


def duplicates(elements: DataFrame) -> DataFrame:
    """Ids that several elements have: pair_id, element_id, n."""
    return elements.groupBy("pair_id", F.col("id").alias("element_id")).agg(F.count("*").alias("n")).filter("n > 1")


def issues(
    elements: DataFrame,
    transforms: DataFrame | None = None,
    bindings: DataFrame | None = None,
    raw_columns: DataFrame | None = None,
    ambiguity: str = "warning",
    params: DataFrame | None = None,
) -> DataFrame:
    """All issues of specifications: pair_id, code, severity, message, element_id, missing_id, raw_column.

    Errors block, warnings do not; an ambiguous binding is a warning unless the caller
    verifies bindings on their own. ``params`` (pair_id, id, params as JSON) adds the size check.
    """
    quoted = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    lacking = missing_dependencies(elements)
    found = [
        issue(duplicates(elements), "DUPLICATE_ID", "error", quoted("duplicate id ", F.col("element_id")), F.col("element_id")),
        issue(
            elements.filter((F.col("kind") != "source") & ids.bad_inputs(F.col("inputs")).isNotNull()),
            "INVALID_STRUCTURE",
            "error",
            ids.bad_inputs(F.col("inputs")),
            F.col("id"),
        ),
        issue(
            elements.filter((F.col("kind") == "constraint") & ~F.col("id").rlike(ids.CONSTRAINT_ID)),
            "INVALID_STRUCTURE",
            "error",
            F.lit("constraint ids must start with c:"),
            F.col("id"),
        ),
        issue(
            elements.filter((F.col("kind") == "derived") & ~F.col("transform_ref").rlike(ids.TRANSFORM_ID)),
            "INVALID_STRUCTURE",
            "error",
            F.lit("transform references must start with t:"),
            F.col("id"),
        ),
        issue(
            lacking,
            "MISSING_INPUT",
            "error",
            quoted("input ", F.col("missing_id"), " is not in the specification"),
            # derived variables before constraints
            F.coalesce(F.filter("users", lambda u: ~u.startswith("c:"))[0], F.col("users")[0]),
            F.col("missing_id"),
        ),
    ]
    whole = elements.join(lacking.select("pair_id").distinct(), "pair_id", "left_anti")
    found.append(issue(cycle_report(edges_of(whole)), "CYCLE_DETECTED", "error", F.concat(F.lit("cycle: "), F.array_join("cycle", " -> "))))
    if params is not None:
        sized = params.withColumn("size", F.length(canonical_a("params")))
        found.append(
            issue(
                sized.filter(F.col("size") > PARAMS_LARGE),
                "PARAMS_LARGE",
                "warning",
                quoted("parameters of ", F.col("id"), " have ", F.col("size").cast("string"), " characters"),
                F.col("id"),
            )
        )
    if transforms is not None:
        found.append(issue(transform_ref_errors(elements, transforms, 1), "MISSING_TRANSFORM_REF", "error", F.col("message"), F.col("element_id")))
    if bindings is not None:
        each = missing_bindings(elements, bindings).select("pair_id", "var_id", F.explode("sources").alias("source_id"))
        found.append(issue(each, "MISSING_BINDING", "warning", quoted(F.col("var_id"), " needs ", F.col("source_id"), ", which nothing binds"), F.col("source_id")))
        found.append(
            issue(
                ambiguous_bindings(bindings),
                "AMBIGUOUS_BINDING",
                ambiguity,
                quoted(F.col("source_id"), " is bound to several raw columns: ", F.array_join("raw_columns", ", ")),
                F.col("source_id"),
            )
        )
        if raw_columns is not None:
            wrong = invalid_bindings(raw_columns, bindings).filter("issue = 'BINDING_INVALID'")
            found.append(
                issue(wrong, "INVALID_RAW_COLUMN", "warning", quoted("raw column ", F.col("raw_column"), " is not in the schema"), F.col("source_id"), None, F.col("raw_column"))
            )
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def sorted_issues(found: DataFrame) -> DataFrame:
    """Issues in report order."""
    return found.orderBy("pair_id", "severity", "code", *(F.coalesce(c, F.lit("")) for c in ("element_id", "missing_id", "raw_column")))
