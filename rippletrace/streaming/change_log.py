"""A change-event log as a stream: windowed counts, and re-evaluation of touched pairs per micro-batch.

An extension; batch comparison needs none of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rippletrace.operators import graph as G

LOG_DDL = "pair_id STRING, change_type STRING, element_id STRING, event_seq LONG, ts TIMESTAMP"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Events appended as Parquet files."""
    return spark.readStream.schema(LOG_DDL).parquet(path)


def counts_by_window(log: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events by type in tumbling windows; what comes later than ``late`` is dropped by the watermark."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", window), "change_type").agg(F.count("*").alias("n"))


def on_touched(log: DataFrame, edges: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """For each micro-batch close the touched pairs' graphs from the new events and hand the labels to ``sink``.

    A replayed batch has the same id, so an idempotent sink gives exactly-once results.
    """

    def batch(events: DataFrame, number: int) -> None:
        touched = events.select("pair_id").distinct()
        seeds = events.select("pair_id", F.col("element_id").alias("node"), F.col("event_seq").alias("seq"))
        sink(G.propagate(edges.join(touched, "pair_id", "left_semi"), seeds), number)

    return log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
