"""Column profiles and value evidence: what a direct change did to a column's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippletrace.sources import bundles as S

MOST_TOP = 5
DIRECT = ("DERIVED_TRANSFORM_REF_CHANGED", "DERIVED_TRANSFORM_PARAMS_CHANGED", "DERIVED_TYPE_CHANGED", "DERIVED_INPUTS_CHANGED")
STATS = (
    "struct<unique_count:bigint,null_count:bigint,row_count:bigint,min:string,max:string,constant_value:string,"
    "top_values:array<string>,top_counts:array<bigint>>"
)


def column_profile(df: DataFrame, columns: list[str], group: str) -> DataFrame:
    """Per group and column: unique_count, null_count, row_count, min, max (as text) and the five most frequent values.

    Rows are first counted per (group, column, value), which combines before the shuffle;
    ranks run over distinct values only. Ties go to the least value.
    """
    cells = df.select(F.col(group).alias("group"), F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("e"))
    counted = cells.groupBy("group", F.col("e.column").alias("column"), F.col("e.value").alias("value")).agg(F.count("*").alias("n"))
    summary = counted.groupBy("group", "column").agg(
        F.count("value").alias("unique_count"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.sum("n").alias("row_count"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    # the k best of each part first, then the best of those: no task sees all values of a column
    salt = F.pmod(F.xxhash64("value"), F.lit(64))
    part = Window.partitionBy("group", "column", "salt").orderBy(F.desc("n"), "value")
    best = counted.filter("value IS NOT NULL").withColumn("salt", salt).withColumn("r", F.row_number().over(part)).filter(F.col("r") <= MOST_TOP)
    whole = Window.partitionBy("group", "column").orderBy(F.desc("n"), "value")
    top = (
        best.withColumn("r", F.row_number().over(whole))
        .filter(F.col("r") <= MOST_TOP)
        .groupBy("group", "column")
        .agg(F.array_sort(F.collect_list(F.struct("r", "value", "n"))).alias("t"))
        .select("group", "column", F.transform("t", lambda x: x["value"]).alias("top_values"), F.transform("t", lambda x: x["n"]).alias("top_counts"))
    )
    return summary.join(top, ["group", "column"], "left")


def constant(stats: Column) -> Column:
    """The one value of a column: as given, or shown by its counts; null if it is not constant."""
    single = (stats["unique_count"] == 1) & (F.coalesce(stats["null_count"], F.lit(0)) == 0)
    shown = F.when(F.size(stats["top_values"]) == 1, stats["top_values"][0]).when(stats["min"] == stats["max"], stats["min"])
    return F.coalesce(stats["constant_value"], F.when(single, shown))


def quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def summary(old: Column, new: Column) -> Column:
    """What changed, as text: constants, or counts of unique values and nulls and the most frequent values."""
    known = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    top = lambda s: F.array_join(
        F.transform(
            F.arrays_zip(F.coalesce(s["top_values"], F.array().cast("array<string>")).alias("v"), F.coalesce(s["top_counts"], F.array().cast("array<bigint>")).alias("n")),
            lambda x: F.concat(quoted(x["v"]), F.coalesce(F.concat(F.lit("("), x["n"].cast("string"), F.lit(")")), F.lit(""))),
        ),
        "; ",
    )
    a, b = constant(old), constant(new)
    counts = F.concat(
        F.lit("unique "), known(old["unique_count"]), F.lit("->"), known(new["unique_count"]),
        F.lit(", nulls "), known(old["null_count"]), F.lit("->"), known(new["null_count"]),
        F.when((top(old) != "") | (top(new) != ""), F.concat(F.lit(", top: "), top(old), F.lit(" -> "), top(new))).otherwise(""),
    )
    return (
        F.when(a.isNotNull() & b.isNotNull(), F.concat(quoted(a), F.lit(" -> "), quoted(b)))
        .when(a.isNotNull(), F.concat(F.lit("constant "), quoted(a), F.lit(" -> non-constant (unique="), known(new["unique_count"]), F.lit(")")))
        .when(b.isNotNull(), F.concat(F.lit("non-constant (unique="), known(old["unique_count"]), F.lit(") -> constant "), quoted(b)))
        .otherwise(counts)
    )


def kind(old: Column, new: Column) -> Column:
    return F.when(constant(old).isNotNull() & constant(new).isNotNull(), "column_constant").otherwise("column_stats")


def bundle_stats(files: DataFrame) -> DataFrame:
    """Column statistics of the runtime evidence, the best of its sections: bundle, table, column, section, stats.

    ``tables`` goes before top-level ``column_stats`` and that before an output's own.
    """
    e = S.artifact(files, S.EVIDENCE, S.EVIDENCE_DDL)
    from_tables = e.select("bundle", F.explode("a.tables").alias("table", "t")).select("bundle", "table", F.explode("t.columns").alias("column", "text"), F.lit(1).alias("p"), F.lit("tables").alias("section"))
    from_stats = e.select("bundle", F.explode("a.column_stats").alias("table", "c")).select("bundle", "table", F.explode("c").alias("column", "text"), F.lit(2).alias("p"), F.lit("outputs").alias("section"))
    from_outputs = e.select("bundle", F.explode("a.outputs").alias("o")).select("bundle", F.col("o.name").alias("table"), F.explode("o.column_stats").alias("column", "text"), F.lit(3).alias("p"), F.lit("outputs").alias("section"))
    every = from_tables.unionByName(from_stats).unionByName(from_outputs)
    best = every.groupBy("bundle", "table", "column").agg(F.min_by(F.struct("section", "text"), "p").alias("b"))
    raw = "STRUCT<unique_count: BIGINT, null_count: BIGINT, row_count: BIGINT, min: STRING, max: STRING, constant_value: STRING, top_values: ARRAY<STRING>, top_counts: ARRAY<BIGINT>>"
    parsed = F.from_json("b.text", raw)
    # an element {value, count} gives a value and a count; any other is the value itself
    values = F.slice(F.transform(parsed["top_values"], lambda v: F.coalesce(F.get_json_object(v, "$.value"), v)), 1, MOST_TOP)
    inner = F.transform(parsed["top_values"], lambda v: F.get_json_object(v, "$.count").cast("bigint"))
    counts = F.slice(F.coalesce(parsed["top_counts"], F.when(F.exists(inner, lambda c: c.isNotNull()), inner)), 1, MOST_TOP)
    return best.select("bundle", "table", "column", "b.section", parsed.withField("top_values", values).withField("top_counts", counts).alias("stats"))


def evidence_tables(files: DataFrame) -> DataFrame:
    """What each bundle with runtime evidence describes: bundle, tables (names; null without that section)."""
    return S.artifact(files, S.EVIDENCE, S.EVIDENCE_DDL).select("bundle", F.map_keys("a.tables").alias("tables"))


def value_evidence(
    changed: DataFrame,
    stats_a: DataFrame,
    stats_b: DataFrame,
    columns_b: DataFrame | None = None,
    told_a: DataFrame | None = None,
    told_b: DataFrame | None = None,
) -> DataFrame:
    """Evidence for directly changed variables (pair_id, var_id, table, column, and old_table, old_column where they differ).

    pair_id, var_id, available, kind, summary, failure_reason, attempted, old, new. Schema
    evidence of the new side decides first: a column that its table no longer has is
    reported as gone. ``stats`` are (pair_id, table, column, stats); ``told`` the tables of
    each side's evidence (pair_id, tables), by default those of the statistics.
    """
    if "old_table" not in changed.columns:
        changed = changed.withColumns({"old_table": F.col("table"), "old_column": F.col("column")})
    key = ["pair_id", "table", "column"]
    told = lambda stats, given: stats.groupBy("pair_id").agg(F.collect_set("table").alias("tables")) if given is None else given
    old_key = {"table": "old_table", "column": "old_column", "stats": "old"}
    joined = (
        changed.join(stats_a.withColumnsRenamed(old_key), ["pair_id", "old_table", "old_column"], "left")
        .join(stats_b.withColumnRenamed("stats", "new"), key, "left")
        .join(told(stats_a, told_a).select("pair_id", F.col("tables").alias("told_a"), F.lit(True).alias("any_a")), "pair_id", "left")
        .join(told(stats_b, told_b).select("pair_id", F.col("tables").alias("told_b"), F.lit(True).alias("any_b")), "pair_id", "left")
    )
    if columns_b is not None:
        has = columns_b.select(*key).distinct().withColumn("present", F.lit(True))
        tables = columns_b.select("pair_id", "table").distinct().withColumn("described", F.lit(True))
        joined = joined.join(has, key, "left").join(tables, ["pair_id", "table"], "left")
        gone = F.coalesce("described", F.lit(False)) & F.col("present").isNull()
    else:
        gone = F.lit(False)

    def lack(stats: str, side: str, table: str) -> Column:
        return F.when(
            F.col(stats).isNull(),
            F.when(F.col(f"any_{side}").isNull(), "runtime_evidence_missing")
            .when(F.col(f"told_{side}").isNull(), "tables_section_missing")
            .when(~F.array_contains(f"told_{side}", F.col(table)), "table_not_found")
            .otherwise("column_not_found"),
        )

    no_table = F.col("table").isNull() | F.col("old_table").isNull()
    no_column = F.col("column").isNull() | F.col("old_column").isNull()
    failure = F.coalesce(
        F.when(no_table, "table_not_found").when(no_column, "column_not_found").when(gone, "column_no_longer_exists"),
        lack("old", "a", "old_table"),
        lack("new", "b", "table"),
    )
    available = failure.isNull()
    looked = F.col("any_a").isNotNull() | F.col("any_b").isNotNull() | no_table | no_column
    attempted = (
        F.when(available, F.lit(None))
        .when(failure == "column_no_longer_exists", F.array(F.lit("schema_evidence")))
        .when(looked, F.array(F.lit("tables"), F.lit("outputs")))
        .otherwise(F.array().cast("array<string>"))
    )
    return joined.select(
        "pair_id",
        "var_id",
        available.alias("available"),
        F.when(available, kind(F.col("old"), F.col("new"))).otherwise("unknown").alias("kind"),
        F.when(available, summary(F.col("old"), F.col("new"))).alias("summary"),
        failure.alias("failure_reason"),
        attempted.alias("attempted"),
        F.when(available, F.col("old")).alias("old"),
        F.when(available, F.col("new")).alias("new"),
    )
