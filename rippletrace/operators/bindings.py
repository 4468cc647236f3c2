"""Column bindings: missing, ambiguous and invalid ones, and what they do to an impact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippletrace.operators.graph import edges_of, propagate


def missing_bindings(elements: DataFrame, bindings: DataFrame) -> DataFrame:
    """Derived variables and their direct ``s:`` inputs that no column binds: pair_id, var_id, sources (sorted)."""
    bound = bindings.select("pair_id", F.col("source_id").alias("src"))
    return (
        edges_of(elements.filter("kind = 'derived'"))
        .filter(F.col("src").startswith("s:"))
        .join(bound, ["pair_id", "src"], "left_anti")
        .groupBy("pair_id", F.col("dst").alias("var_id"))
        .agg(F.array_sort(F.collect_set("src")).alias("sources"))
    )


def ambiguous_bindings(bindings: DataFrame) -> DataFrame:
    """Sources that several raw columns bind: pair_id, source_id, raw_columns (sorted)."""
    return (
        bindings.groupBy("pair_id", "source_id")
        .agg(F.array_sort(F.collect_set("raw_column")).alias("raw_columns"))
        .filter(F.size("raw_columns") > 1)
    )


def ambiguous_uses(elements: DataFrame, bindings: DataFrame) -> DataFrame:
    """Derived variables and their direct inputs that are ambiguous: pair_id, var_id, sources (sorted)."""
    several = ambiguous_bindings(bindings).select("pair_id", F.col("source_id").alias("src"))
    return (
        edges_of(elements.filter("kind = 'derived'"))
        .join(several, ["pair_id", "src"])
        .groupBy("pair_id", F.col("dst").alias("var_id"))
        .agg(F.array_sort(F.collect_set("src")).alias("sources"))
    )


def invalid_bindings(raw_columns: DataFrame, bindings: DataFrame) -> DataFrame:
    """Bound columns that the raw schema lacks (BINDING_INVALID) and schema columns that nothing binds (UNMAPPED)."""
    known = raw_columns.select("pair_id", F.col("name").alias("raw_column"))
    return (
        bindings.join(known, ["pair_id", "raw_column"], "left_anti")
        .select("pair_id", F.lit("BINDING_INVALID").alias("issue"), "raw_column", "source_id")
        .unionByName(
            known.join(bindings, ["pair_id", "raw_column"], "left_anti").select(
                "pair_id", F.lit("UNMAPPED").alias("issue"), "raw_column", F.lit(None).cast("string").alias("source_id")
            )
        )
    )


def binding_impact(elements_v2: DataFrame, bindings: DataFrame, base: DataFrame, with_paths: bool = True) -> DataFrame:
    """Lay binding issues of version 2 over an impact: pair_id, var_id, reason, event_seq, path.

    A missing and then an ambiguous binding override any reason; what depends on such a
    variable becomes transitive only if it had no reason.
    """
    lack = missing_bindings(elements_v2, bindings).select("pair_id", "var_id", F.lit("MISSING_BINDING").alias("reason"), F.lit(1).alias("p"), "sources")
    amb = ambiguous_uses(elements_v2, bindings).select("pair_id", "var_id", F.lit("AMBIGUOUS_BINDING").alias("reason"), F.lit(0).alias("p"), "sources")
    both = lack.unionByName(amb)
    own = both.select("pair_id", "var_id", "reason", "p", F.lit(0).cast("long").alias("event_seq"), F.array(F.col("sources")[0], F.col("var_id")).alias("path"))
    seeds = both.select("pair_id", F.col("var_id").alias("node"), F.lit(0).cast("long").alias("seq")).distinct()
    derived = elements_v2.filter("kind = 'derived'").select("pair_id", F.col("id").alias("var_id"))
    below = (
        propagate(edges_of(elements_v2), seeds, with_paths=with_paths)
        .select("pair_id", F.col("node").alias("var_id"), F.lit("TRANSITIVE_DEPENDENCY").alias("reason"), F.lit(3).alias("p"), F.lit(0).cast("long").alias("event_seq"), "path")
        .join(derived, ["pair_id", "var_id"], "left_semi")
    )
    had = base.select("pair_id", "var_id", "reason", F.lit(2).alias("p"), "event_seq", "path")
    rows = own.unionByName(had).unionByName(below)
    best = rows.groupBy("pair_id", "var_id").agg(
        F.min_by(F.struct("reason", "event_seq", "path"), F.struct("p", "event_seq", "path")).alias("best")
    )
    out = best.select("pair_id", "var_id", "best.*")
    return out if with_paths else out.withColumn("path", F.array().cast("array<string>"))


def binding_errors(elements_v2: DataFrame, bindings: DataFrame) -> DataFrame:
    """Messages for ambiguous sources: all of a pair's, if any derived variable of it uses one."""
    using = ambiguous_uses(elements_v2, bindings).select("pair_id").distinct()
    return (
        ambiguous_bindings(bindings)
        .join(using, "pair_id", "left_semi")
        .select(
            "pair_id",
            F.col("source_id").alias("element_id"),
            F.concat(F.lit("source "), F.col("source_id"), F.lit(" is bound to several raw columns: "), F.array_join("raw_columns", ", ")).alias("message"),
        )
    )
