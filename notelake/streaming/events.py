"""Weekly counts and deduplication over an event stream, drained by one available-now trigger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch

LATENESS = "3 days"


def read_events(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def week_counts(events: DataFrame) -> DataFrame:
    """week, event_type, n: Sunday-based tumbling weeks in event time, closed three days after they end."""
    week = F.window("ts", "7 days", "7 days", "3 days")
    return events.withWatermark("ts", LATENESS).groupBy(week.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("week"), "event_type", "n")


def first_of_each(events: DataFrame, keys: list[str], lateness: str = LATENESS) -> DataFrame:
    """Each key once within the lateness: what has been shown is not shown again. The state holds the keys of that time."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None] | None = None, checkpoint: str | None = None) -> DataFrame | None:
    """Runs a stream over all that is there, once. Without a sink its rows are written to the shared folder and returned."""
    spark = stream.sparkSession
    out = scratch(spark, "stream")
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{out}/state")
    query = (writer.foreachBatch(sink) if sink else writer.outputMode("append").format("parquet").option("path", f"{out}/rows")).start()
    query.awaitTermination()
    return None if sink else spark.read.schema(stream.schema).parquet(f"{out}/rows")
