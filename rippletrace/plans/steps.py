"""Execution of described plan steps on DataFrames."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippletrace.functions.render import _first, _names, assigned, branches, call_name, dropped, family, grouping, pairs, sort_keys

BINARY = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: a / b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "==": lambda a, b: a == b,
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "and": lambda a, b: a & b,
    "or": lambda a, b: a | b,
}
STATISTICS = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "n": F.count, "count": F.count, "std": F.stddev, "median": F.median}


def column(node: Any) -> Column:
    """An expression tree as a column."""
    if not isinstance(node, dict):
        return F.lit(node)
    kind = family(node)
    if kind == "literal":
        return F.lit(node.get("value"))
    if kind == "column":
        return F.col(_first(node, "name", "id", "value"))
    if kind == "call":
        return F.call_function(call_name(node), *(column(a) for a in node.get("args") or []))
    if kind == "if":
        condition, then, other = (*branches(node), None, None, None)[:3]
        return F.when(column(condition), column(then)).otherwise(column(other))
    if kind == "binary":
        return BINARY[_first(node, "op", "operator")](column(node["left"]), column(node["right"]))
    if kind == "lookup":
        base = _first(node, "name", "base", "map")
        return (F.col(base) if isinstance(base, str) else column(base))[column(_first(node, "key", "index"))]
    raise ValueError(f"no execution for expressions of type {kind}")


def run(df: DataFrame, op: str, params: dict[str, Any]) -> DataFrame:
    """Apply one step."""
    if op == "compute":
        return df.withColumns({name: column(expr) for name, expr in assigned(params)})
    if op == "filter":
        return df.filter(column(params["predicate"]))
    if op == "rename":
        return df.withColumnsRenamed(dict(pairs(params)))
    if op == "select":
        keep = _first(params, "cols", "keep")
        return df.select(*_names(keep)) if keep else df.drop(*_names(params.get("drop")))
    if op == "drop":
        return df.drop(*dropped(params))
    if op == "sort":
        keys = [F.col(c).desc() if way == "desc" else F.col(c).asc() for c, way in sort_keys(params)]
        if params.get("nodupkey"):
            # the first row of each key by input order; ties by all columns where there is none
            by = [c for c, _ in sort_keys(params)]
            order = [F.col(params["order_by"])] if params.get("order_by") else [F.col(c) for c in df.columns if c not in by]
            first = Window.partitionBy(*by).orderBy(*order)
            df = df.withColumn("_first", F.row_number().over(first)).filter("_first = 1").drop("_first")
        return df.orderBy(*keys)
    if op == "aggregate":
        by, what, stats = (_names(x) for x in grouping(params).values())
        return df.groupBy(*by).agg(*(STATISTICS[s](v).alias(f"{v}_{s}") for v in what for s in stats))
    if op == "datasource":
        spark = df.sparkSession
        return spark.read.csv(params["path"], header=True, schema=params.get("schema"))
    if op == "save":
        df.write.mode("overwrite").parquet(params["path"])
        return df
    if op == "identity":
        return df
    raise ValueError(f"no execution for step {op}")


def run_all(df: DataFrame, steps: list[tuple[str, dict[str, Any]]]) -> DataFrame:
    """Apply steps one after the other; Catalyst sees one plan."""
    for op, params in steps:
        df = run(df, op, params)
    return df
