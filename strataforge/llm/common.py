"""Shared helpers of the training-data operators: tables, shared scratch folders, lineage cuts."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import PySparkAttributeError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words everywhere in this package: blank and the ASCII controls 9 to 13.
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (tests only) a local one set here."""
    base = spark.conf.get("spark.checkpoint.dir", None) or os.environ.get("STRATAFORGE_SHARED_DIR")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.environ["STRATAFORGE_SHARED_DIR"] = "file://" + tempfile.mkdtemp(prefix="strataforge-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: Rows and bytes of an Arrow batch where whole texts go through Python: some MB, whatever the default.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def small_batches(df: DataFrame) -> DataFrame:
    """df, after the session's Arrow batches are bounded for rows with long texts. Smaller bounds that the session has stay."""
    for name, most in BATCHES.items():
        now = df.sparkSession.conf.get(name, "1000000000").lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            df.sparkSession.conf.set(name, str(most))
    return df


def tidy(run: Callable) -> Callable:
    """A function over Arrow batches that gives its task's memory back when it ends: workers live on, and what one stage held would add to the next one's."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return inner


def relieve(spark: SparkSession) -> None:
    """Has the driver's JVM collect its garbage and give freed memory back to the system: what the planning of one step took would add to the next one's.

    JVMs without the command for the latter, and sessions without access to one, keep it.
    """
    try:
        jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
        jvm.System.gc()
        kind = jvm.java.lang.Class.forName
        kinds, args = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = kind(name)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # By reflection, since the server's own class is not open to Py4J.
        kind("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except (Py4JError, PySparkAttributeError):
        return


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of this package's own in the shared folder, once nothing reads it any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are in the shared folder, so lost executors cost nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    out = df.write
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key is hot with so many rows, or with this share of all: so at most HOT_KEYS keys are hot, whatever the size.
HOT_ROWS, HOT_KEYS = 2000, 50_000


def join_hot(left: DataFrame, right: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """left.join(right, key, how) for a right side with one row for each key and the number of left rows that have it.

    Hot keys, at most HOT_KEYS by their definition, are broadcast, so their rows stay where they are; the others are joined
    by shuffle. The count column is not returned.
    """
    least = max(HOT_ROWS, total // HOT_KEYS)
    hot = F.broadcast(right.where(F.col(count) >= least).drop(count))
    cold = right.where(F.col(count) < least).drop(count)
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(cold, key, how))


#: Bits of a filter of ids, at most: 16 MB that are broadcast, whatever the rows.
FILTER_BITS = 1 << 27


def maybe_in(df: DataFrame, key: str, ids: DataFrame, n: int) -> DataFrame:
    """df with ``_maybe``: false only for rows whose key (long) is not among the n ``ids`` (one column of that name).

    A bitmap of the ids' hashes, 16 bits for each up to FILTER_BITS in all, is broadcast, so rows are told apart where they
    stand. With far more ids than bits all rows may be in, which is right, though of no use.
    """
    bits = min(FILTER_BITS, 1 << max(15, (16 * n).bit_length()))
    if n > FILTER_BITS:
        return df.withColumn("_maybe", F.lit(True))
    at = F.pmod(F.xxhash64(key), F.lit(bits)).cast("long")
    maps = ids.select(at.alias("at")).groupBy(F.shiftright("at", 15).alias("_page")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit((1 << 15) - 1))).alias("_map"))
    low = F.col("_at").bitwiseAND(F.lit((1 << 15) - 1))
    byte = F.conv(F.hex(F.substr("_map", (F.shiftright(low, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    seen = F.getbit(byte, low.bitwiseAND(F.lit(7)).cast("int")) == 1
    x = df.withColumn("_at", at).withColumn("_page", F.shiftright("_at", 15)).join(F.broadcast(maps), "_page", "left")
    return x.withColumn("_maybe", F.coalesce(seen, F.lit(False))).select(*df.columns, "_maybe")


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """One table for each run of equal, non-null values of a column by which the rows come sorted."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, b in zip(edges, edges[1:], strict=False):
            if held and k[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = k[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
