"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in spark.checkpoint.dir; only a local session without it gets a folder of its own."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None) or os.environ.get("STRATAFORGE_SHARED_DIR")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = os.environ["STRATAFORGE_SHARED_DIR"] = "file://" + tempfile.mkdtemp(prefix="strataforge-")
        spark.sparkContext.setCheckpointDir(base)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, *order: Column, name: str = "rank0") -> DataFrame:
    """df with places from 0 by order: sorted by ranges, then numbered from each range's start, so no task sees all rows."""
    at = cut(df.orderBy(*order)).withColumn("_at", F.monotonically_increasing_id())
    # One number for each range.
    held = {r["p"]: r["count"] for r in at.groupBy(F.shiftright("_at", 33).alias("p")).count().collect()}
    starts, before = [], 0
    for p in range(max(held, default=0) + 1):
        starts.append(before)
        before += held.get(p, 0)
    start = F.element_at(F.lit(starts).cast("array<long>"), F.shiftright("_at", 33).cast("int") + 1)
    return at.withColumn(name, start + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")
