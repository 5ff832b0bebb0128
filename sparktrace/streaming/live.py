"""Logs as they arrive: the same parser on a stream of files, and counts per minute with late events up to a bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktrace.sources import tj

FILES = "path string, modificationTime timestamp, length long, content binary"


def live_events(spark: SparkSession, root: str) -> DataFrame:
    """Events of the log files that appear below root, each file read once when complete."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.log").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    found = files.select(F.regexp_replace("path", "^.*?" + base + "/", "").alias("logical"), "content", F.lit("").alias("problem"))
    return tj.events(tj.records(found))


def minute_counts(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events, their time and the longest per minute, data set and type; events later than the bound are left out."""
    timed = events.where("ts is not null").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 minute").alias("minute"), "dataset_id", "event_type").agg(F.count("*").alias("count"), F.sum("duration_us").alias("duration_us"), F.max("duration_us").alias("max_us"))
