"""Predicates and parts of ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INPUT_ID = "^[sdvc]:"
TRANSFORM_ID = "^t:"
CONSTRAINT_ID = "^c:"
HEX_64 = "^[0-9a-fA-F]{64}$"
#: ``sha256:`` and 64 digits
HASH_LENGTH = 71


def bad_inputs(inputs: Column) -> Column:
    """Why a list of inputs is not acceptable; null if it is."""
    return (
        F.when(F.exists(inputs, lambda i: ~i.rlike(INPUT_ID)), F.lit("inputs must start with s:, d:, v: or c:"))
        .when(F.size(F.array_distinct(inputs)) < F.size(inputs), F.lit("inputs must be unique"))
    )


def bad_transform(id_: Column, digest: Column, params_schema_hash: Column) -> Column:
    """Why a registry entry is not acceptable; null if it is."""
    return (
        F.when(~id_.rlike(TRANSFORM_ID), F.lit("transform ids must start with t:"))
        .when(id_ != F.lower(id_), F.lit("transform ids must be lower case"))
        .when(~digest.rlike(HEX_64), F.lit("digests must have 64 hex digits"))
        .when(F.length(params_schema_hash) != HASH_LENGTH, F.lit("params_schema_hash must have 71 characters"))
    )


def bad_timestamp(value: Column) -> Column:
    """Why a history time is not acceptable; null if it is."""
    iso = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
    return F.when(~value.rlike(iso) | F.try_to_timestamp(value).isNull(), F.lit("timestamps must be ISO 8601"))


def kind_of(id_: Column) -> Column:
    """What an id names."""
    first = F.substring(id_, 1, 2)
    return (
        F.when(first == "s:", F.lit("source"))
        .when(first.isin("d:", "v:"), F.lit("derived"))
        .when(first == "c:", F.lit("constraint"))
        .otherwise(F.lit("unknown"))
    )


def table_of(variable: Column, given: Column) -> Column:
    """Table of a variable: its field, or what stands before the first dot of ``v:table.column``."""
    part = F.regexp_extract(variable, r"^v:([^.]*)\.(.*)$", 1)
    return F.coalesce(given, F.when(part != "", part))


def column_of(variable: Column, given: Column | None = None) -> Column:
    """Column of a variable: its field, or what stands after the first dot."""
    part = F.regexp_extract(variable, r"^[^.]*\.(.*)$", 1)
    return F.coalesce(given if given is not None else F.lit(None).cast("string"), F.when(part != "", part))


def safe_path(path: Column) -> Column:
    """A bundle-relative path with forward slashes; absolute paths and parent folders fail the query."""
    clean = F.regexp_replace(path, r"\\", "/")
    bad = clean.startswith("/") | clean.rlike(r"^[A-Za-z]:") | clean.rlike(r"(^|/)\.\.(/|$)")
    return F.when(bad, F.raise_error(F.concat(F.lit("path leaves the bundle: "), path))).otherwise(clean)


def unsafe_path(path: Column) -> Column:
    """Whether a bundle-relative path is absolute or leaves the bundle."""
    clean = F.regexp_replace(path, r"\\", "/")
    return clean.startswith("/") | clean.rlike(r"^[A-Za-z]:") | clean.rlike(r"(^|/)\.\.(/|$)")


def json_list(values: Column) -> Column:
    """``["a", "b"]``: a list of ids as JSON with a space after each comma."""
    return F.when(F.size(values) == 0, F.lit("[]")).otherwise(
        F.concat(F.lit('["'), F.array_join(values, '", "'), F.lit('"]'))
    )
