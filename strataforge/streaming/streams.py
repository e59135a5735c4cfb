"""Structured Streaming operators. Each run takes what is there (available now) and resumes from its checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.operators.state import touches

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, pattern: str = "events.parquet", per_batch: int = 100) -> DataFrame:
    """A stream over the event files of a folder (or, of a table in several files, of its own folder)."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", pattern).parquet(folder)


def run(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    q = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def watch(spark: SparkSession, folder: str, checkpoint: str, reindex: Callable[[DataFrame], None], pattern: str = "*.{ts,tsx,js,jsx,py}") -> None:
    """Hands new and changed files (path, modificationTime, content) to ``reindex`` once each. A stream never tells of deleted files: see reconcile()."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    run(raw, checkpoint, lambda df, _: reindex(df))


def reconcile(spark: SparkSession, stored: DataFrame, folder: str) -> DataFrame:
    """The stored files (path) that are gone."""
    now = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    return stored.join(now, "path", "left_anti")


def touch_counts(stream: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Running counters for each key; state is one row a key."""
    return touches(stream.select(F.col("user_id").alias("key"), "ts", F.col("event_type").alias("type")), kinds)


def tumbling(stream: DataFrame, width: str = "1 hour", late: str = "6 hours") -> DataFrame:
    """Counts and sums by window and type, with late events up to a limit. (An addition of this engine.)"""
    x = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return x.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(df: DataFrame, gap: str = "30 minutes", late: str = "6 hours") -> DataFrame:
    """Sessions of each user: events no further apart than the gap. (An addition of this engine.)"""
    x = df.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return x.select("user_id", F.col("session_window.start").alias("start"), "n")
