"""Session helpers: tables in the shared folder, and numbering without a single-task sort."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="rippletrace-"))
        found = sc._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def by_measured_size(spark: SparkSession) -> SparkSession:
    """A session beside the caller's whose joins broadcast only what was measured while running.

    Before a run Spark takes a table's compressed bytes for its size. Written ids shrink to a
    hundredth, so that millions of rows pass for a few MB and are built in the driver. Here
    the caller's threshold holds for the bytes of rows that a shuffle has counted. Lists are
    gathered from sorted rows: the other way sorts too, after its first 128 groups, and loses
    the order that the joins after it need. All other settings are the caller's.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.get(key, None) != value:
            own.conf.set(key, value)
    most = "spark.sql.autoBroadcastJoinThreshold"
    measured = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    own.conf.set(measured, spark.conf.get(measured, None) or spark.conf.get(most))
    own.conf.set(most, "-1")
    own.conf.set("spark.sql.execution.useObjectHashAggregateExec", "false")
    return own


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rippletrace-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`stored` that nothing will read again."""
    path = getattr(df, "_stored_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def numbered(df: DataFrame, groups: list[str], order: list[Column | str], name: str) -> DataFrame:
    """Add ``name``: the row's number (from 1) in its group by ``order``, which must decide ties.

    Rows are range-partitioned and sorted; a row's number is its place in its partition
    plus the group's rows in earlier partitions, so even one huge group is spread out.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # range partitioning reads its input twice, once for a sample: let it read a table
    df = df if hasattr(df, "_stored_path") else stored(df, "unnumbered")
    keys = [*(F.col(g) for g in groups), *(F.col(o) if isinstance(o, str) else o for o in order)]
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = stored(
        ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "numbered"
    )
    counts = placed.groupBy("_part", *groups).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(
        "_part",
        *(F.col(g).alias(f"_{g}") for g in groups),
        "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    same = [placed["_part"] == base["_part"], *(placed[g].eqNullSafe(base[f"_{g}"]) for g in groups)]
    joined = placed.join(base, same)
    return joined.select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias(name))
