"""Lookups and dependency queries over nodes (id, name, ...) and edges (src, dst)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def any_like(c: Column, patterns: list[str]) -> Column:
    """Case-insensitive LIKE of any pattern."""
    return reduce(lambda a, b: a | b, (F.lower(c).like(p.lower()) for p in patterns))


def symbol_lookup(nodes: DataFrame, name: str, *, ignore_case: bool = False, limit: int = 10) -> DataFrame:
    """Nodes of a name, by id, ``limit`` at most (a report of the feature, not of the data)."""
    same = F.lower("name") == name.lower() if ignore_case else F.col("name") == name
    return nodes.where(same).orderBy("id").limit(limit)


def path_suffix(files: DataFrame, suffix: str) -> DataFrame:
    """The file with the shortest path that ends so; of equally short ones the first."""
    return files.where(F.endswith("path", F.lit(suffix))).orderBy(F.length("path"), "path").limit(1)


def substring_search(df: DataFrame, cols: list[str], query: str, limit: int = 50) -> DataFrame:
    """Rows of which a column contains the query, whatever the case; an empty query matches all. By id."""
    hit = reduce(lambda a, b: a | b, (F.lower(c).contains(query.lower()) for c in cols))
    return df.where(hit).orderBy("id").limit(limit)


def neighbours(nodes: DataFrame, edges: DataFrame, target: int, *, incoming: bool) -> DataFrame:
    """id, name of the nodes that the target points to, or that point to it. The filter reaches the scan before any join."""
    near, far = ("dst", "src") if incoming else ("src", "dst")
    ids = edges.where(F.col(near) == target).select(F.col(far).alias("id")).distinct()
    return nodes.join(ids, "id", "left_semi").select("id", "name")


def left_counts(left: DataFrame, right: DataFrame, left_key: str, right_key: str, name: str = "n") -> DataFrame:
    """Every left row with the number of right rows, which are counted before they are joined."""
    counts = right.groupBy(F.col(right_key).alias("_k")).agg(F.count("*").alias(name))
    return left.join(counts, left[left_key] == counts["_k"], "left").drop("_k").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def without_match(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    return left.join(right.select(F.col(right_key).alias("_k")), left[left_key] == F.col("_k"), "left_anti")


def with_match(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    return left.join(right.select(F.col(right_key).alias("_k")), left[left_key] == F.col("_k"), "left_semi")


def name_collisions(nodes: DataFrame) -> DataFrame:
    """name (lower case), n of names that more than one node has."""
    return nodes.groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("n")).where("n > 1")


def rename_safe(nodes: DataFrame, edges: DataFrame, current: str, new: str) -> DataFrame:
    """One row: collision (whether the new name is taken), dependents, verdict."""
    taken = nodes.agg(F.count_if(F.lower("name") == new.lower()).alias("collisions"))
    ids = nodes.where(F.col("name") == current).select(F.col("id").alias("dst"))
    users = edges.join(ids, "dst", "left_semi").agg(F.count("*").alias("dependents"))
    verdict = F.when(F.col("collisions") > 0, "COLLISION").when(F.col("dependents") > 0, "NEEDS_UPDATES").otherwise("SAFE")
    return taken.crossJoin(users).select("collisions", "dependents", verdict.alias("verdict"))


def delete_safe(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, incoming, safe of every node."""
    return left_counts(nodes.select("id"), edges, "id", "dst", "incoming").withColumn("safe", F.col("incoming") == 0)


def resolve_names(calls: DataFrame, symbols: DataFrame, reserved: list[str], most: int = 8) -> DataFrame:
    """Distinct edges (src, dst) from calls (src, name, file_id) to symbols (id, name, file_id).

    A name binds to the symbols of the caller's own file, else to all of that name unless more than ``most`` share it;
    no self edges, no reserved names. Names with too many symbols are dropped before the join, so it can't explode.
    """
    calls, symbols = (x.where(~F.col("name").isin(reserved)) for x in (calls, symbols))
    local = calls.join(symbols.withColumnRenamed("id", "dst"), ["file_id", "name"]).select("src", "name", "file_id", "dst")
    few = symbols.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("name")
    rest = calls.join(local.select("src", "name", "file_id").distinct(), ["src", "name", "file_id"], "left_anti")
    wide = rest.join(symbols.join(few, "name", "left_semi").select("name", F.col("id").alias("dst")), "name").select("src", "dst")
    return local.select("src", "dst").unionByName(wide).where("src <> dst").distinct()


def capsule(nodes: DataFrame, edges: DataFrame, most: int = 25) -> DataFrame:
    """id, name, callers, deps: each node with the names of up to ``most`` neighbours each way, by name."""
    def side(near: str, far: str, out: str) -> DataFrame:
        x = edges.join(nodes.select(F.col("id").alias(far), "name"), far).select(F.col(near).alias("id"), "name").distinct()
        place = F.row_number().over(Window.partitionBy("id").orderBy("name"))
        return x.withColumn("p", place).where(F.col("p") <= most).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias(out))
    return nodes.select("id", "name").join(side("dst", "src", "callers"), "id", "left").join(side("src", "dst", "deps"), "id", "left").na.fill("", ["callers", "deps"])


def contains_join(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name) where a text contains a name, whatever the case; texts (id, text), names (name) of one word.

    Names are looked up among the text's own words and their parts' positions are not: a name of letters and digits that a text
    contains stands inside one of its words, so words (fewer, distinct) are matched and then joined back by equality.
    """
    words = texts.select("id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+"))).alias("word")).where("word <> ''")
    lower = names.select(F.lower("name").alias("name")).distinct()
    # One row: the lengths that names have, no more than the longest name has letters.
    lengths = lower.agg(F.collect_set(F.length("name")).alias("lengths"))
    # Pieces of the distinct words with those lengths: an equality join in place of a nested loop.
    sized = words.select("word").distinct().crossJoin(F.broadcast(lengths)).select("word", F.explode("lengths").alias("n")).where(F.length("word") >= F.col("n"))
    pieces = sized.select("word", F.explode(F.sequence(F.lit(1), F.length("word") - F.col("n") + 1)).alias("at"), "n")
    hit = pieces.select("word", F.substr("word", F.col("at").cast("int"), F.col("n").cast("int")).alias("name")).join(lower, "name").distinct()
    return words.join(hit, "word").select("id", "name").distinct()
