"""Activity as a stream: counts by window, sessions and first sightings, equal to their batch forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.storage import shared_dir


def source(spark: SparkSession, folder: str, names: str = "*.parquet", late: str = "1 hour") -> DataFrame:
    """The Parquet files of a folder with such names as a stream with a watermark on ts."""
    schema = spark.read.option("pathGlobFilter", names).parquet(folder).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", names).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def hourly(events: DataFrame) -> DataFrame:
    """Events by hour and type; an hour is given out once the watermark has passed it."""
    w = F.window("ts", "1 hour")
    return events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("hour"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of a user's events no further apart than the gap."""
    w = F.session_window("ts", gap)
    return events.groupBy(w.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def distinct_events(events: DataFrame) -> DataFrame:
    return events.dropDuplicatesWithinWatermark(["event_id"])


def finish(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and gives its result as a table."""
    base = f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out")
