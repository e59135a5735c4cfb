"""Activity, ledgers, incremental updates, hash chains and dictionary encoding."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataforge.functions.decay import intent
from strataforge.lineage import numbered


def touches(events: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """key, opened, pulled, edited, last of events (key, ts, type); kinds maps types to open, pull or edit."""
    of = lambda k: F.count_if(F.col("type").isin([t for t, x in kinds.items() if x == k]))
    return events.where(F.col("type").isin(list(kinds))).groupBy("key").agg(of("open").alias("opened"), of("pull").alias("pulled"), of("edit").alias("edited"), F.max("ts").alias("last"))


def intent_scores(counts: DataFrame, now: Column) -> DataFrame:
    """key, intent from touches() and the time now."""
    days = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 86_400_000_000.0
    return counts.select("key", intent(F.col("opened"), F.col("pulled"), F.col("edited"), days).alias("intent"))


def latest_by(events: DataFrame, by: str, value: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The latest value of each key, by time and then id."""
    return events.groupBy(by).agg(F.count("*").alias("n"), F.max_by(F.col(value), F.struct(ts, tie)).alias(value), F.max(ts).alias(ts))


def diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, status: new, changed, same or removed, of tables (key, hash)."""
    x = old.select(F.col(key), F.col("hash").alias("h1")).join(new.select(F.col(key), F.col("hash").alias("h2")), key, "full")
    return x.select(key, F.when(F.col("h1").isNull(), "new").when(F.col("h2").isNull(), "removed").when(F.col("h1") == F.col("h2"), "same").otherwise("changed").alias("status"))


def needs_index(files: DataFrame, stored: DataFrame) -> DataFrame:
    """The scanned files (path, hash, has_imports) that must be indexed again: new ones, changed ones, and ones whose stored row looks incomplete (symbols, blindspots, imports)."""
    s = stored.select("path", F.col("hash").alias("old"), "symbols", "blindspots", "imports")
    fine = F.col("old").eqNullSafe(F.col("hash")) & ((F.col("symbols") > 0) | (F.col("blindspots") == 0)) & (~F.col("has_imports") | (F.col("imports") > 0))
    return files.join(s, "path", "left").where(~F.coalesce(fine, F.lit(False))).select(files.columns)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of both by key, new ones instead of old ones; keys are unique on each side."""
    return old.join(new.select(key), key, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def stale(stored: DataFrame, scanned: DataFrame, key: str) -> DataFrame:
    return stored.join(scanned.select(key), key, "left_anti")


def chain(events: DataFrame, by: str, order: list[str], core: Column) -> DataFrame:
    """Each row with prev and hash: hash = sha256(prev hash, core), in order within a key, the first prev empty.

    A chain needs its rows one after another, so keys are the unit of parallel work; each key's rows stream through one task,
    sorted, with the last hash as the only state.
    """
    import hashlib

    rows = events.withColumn("core", core).repartition(by).sortWithinPartitions(by, *order)
    schema = rows.schema
    at = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, ""
        for p in batches:
            prev, hashes = [], []
            for k, c in zip(p[by], p["core"], strict=True):
                if k != key:
                    key, last = k, ""
                prev.append(last)
                last = hashlib.sha256((last + c).encode()).hexdigest()
                hashes.append(last)
            yield p[at].assign(prev=prev, hash=hashes)

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return rows.mapInPandas(run, names + ", prev string, hash string")


def verify_chain(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """by, rows, first_broken (the place, from 1, of a key's first row whose link or hash is wrong; null: none)."""
    w = Window.partitionBy(by).orderBy(*order)
    before = F.coalesce(F.lag("hash").over(w), F.lit(""))
    x = rows.withColumns({"_n": F.row_number().over(w), "_ok": (before == F.col("prev")) & (F.sha2(F.concat("prev", "core"), 256) == F.col("hash"))})
    return x.groupBy(by).agg(F.count("*").alias("rows"), F.min(F.when(~F.col("_ok"), F.col("_n"))).cast("long").alias("first_broken"))


def savings(calls: DataFrame, by: str, baseline: int = 1800) -> DataFrame:
    """by, calls, tokens, saved of calls (by, tokens): what each returns below the baseline."""
    return calls.groupBy(by).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.sum(F.greatest(F.lit(0), baseline - F.col("tokens"))).cast("long").alias("saved"))


def dictionary(rows: DataFrame, value: str, position: str) -> DataFrame:
    """value, id, n: dense ids from 0 in the order of first appearance. Values are reduced, then sorted by ranges and numbered from each range's start."""
    x = rows.groupBy(value).agg(F.min(position).alias("_p"), F.count("*").alias("n"))
    return numbered(x, F.col("_p"), F.col(value), name="id").select(value, "id", "n")


def encoded(rows: DataFrame, columns: list[str], position: str) -> DataFrame:
    """Rows with each named column replaced by its dictionary id (column_id)."""
    out = rows
    for c in columns:
        out = out.join(dictionary(rows, c, position).select(F.col(c), F.col("id").alias(f"{c}_id")), c, "left").drop(c)
    return out
