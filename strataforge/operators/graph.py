"""Graph analytics over nodes (id) and edges (src, dst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.lineage import cut
from strataforge.operators.decisions import dynamic_folder, entry_point, test_or_config

DAMPING = 0.85


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 20, tolerance: float | None = None) -> DataFrame:
    """id, rank; ranks add up to 1. Self loops and repeated edges don't count; what nodes without links hold is spread over all.

    With a tolerance it stops when no rank changes by more, after 100 rounds at most. Edges are laid out by source once;
    lineage is cut every fourth round.
    """
    nodes = cut(nodes.select("id").distinct())
    n = nodes.count()
    if n == 0:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    e = edges.select("src", "dst").where("src <> dst").distinct().join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi")
    out = e.groupBy("src").agg(F.count("*").alias("out"))
    # Edges lie by source and ranks by node in the same partitions, so a round moves only what edges give.
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = cut(e.join(out, "src").repartition(parts, "src"))
    linked = cut(nodes.join(out.withColumnRenamed("src", "id"), "id", "left").select("id", F.col("out").isNull().alias("dangling")).repartition(parts, "id"))
    rank = linked.select("id", "dangling", F.lit(1.0 / n).alias("rank"))
    for i in range(100 if tolerance else iterations):
        gain = e.join(rank.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("out")).alias("gain"))
        loose = rank.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("loose"))
        new = linked.join(gain, "id", "left").crossJoin(F.broadcast(loose)).select("id", "dangling", ((1 - DAMPING) / n + DAMPING * (F.coalesce("gain", F.lit(0.0)) + F.col("loose") / n)).alias("rank"))
        if tolerance:
            new = cut(new)
            change = new.alias("a").join(rank.alias("b"), "id").agg(F.max(F.abs(F.col("a.rank") - F.col("b.rank")))).first()[0]
            rank = new
            if change <= tolerance:
                break
        else:
            rank = cut(new) if i % 4 == 3 else new
    return rank.select("id", "rank")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, in_degree (edges), out_degree (different targets)."""
    ins = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    outs = edges.select("src", "dst").distinct().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    return nodes.select("id").join(ins, "id", "left").join(outs, "id", "left").na.fill(0, ["in_degree", "out_degree"])


def connectivity(ins: Column, outs: Column, symbols: Column) -> Column:
    """The class of a node from its degrees and symbols."""
    return F.when((ins > 0) & (outs > 0), "connected").when(ins > 0, "leaf").when(outs > 0, "root").when(symbols > 0, "isolated").otherwise("empty")


def importance(degree: DataFrame, rank: DataFrame, legacy: DataFrame | None = None) -> DataFrame:
    """id, importance: 10 for each edge in, 1000 times the rank, and twice the legacy score (id, score) where there is one."""
    value = 10.0 * F.col("in_degree") + 1000.0 * F.col("rank")
    x = degree.join(rank, "id")
    if legacy is not None:
        x, value = x.join(legacy.select("id", "score"), "id", "left"), value + 2.0 * F.coalesce("score", F.lit(0.0))
    return x.select("id", value.alias("importance"))


def god_objects(edges: DataFrame, threshold: int = 20) -> DataFrame:
    """id, fan_in of the nodes with more edges in than the threshold."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in")).where(F.col("fan_in") > threshold)


def traverse(edges: DataFrame, start: int, depth: int = 2, *, incoming: bool = False) -> DataFrame:
    """id, depth of the nodes reached from the start in so many steps, each at its least depth; a node is expanded once."""
    near, far = ("dst", "src") if incoming else ("src", "dst")
    e = edges.select(F.col(near).alias("a"), F.col(far).alias("b")).distinct()
    seen = e.where(F.col("a") == start).select(F.col("b").alias("id"), F.lit(1).alias("depth")).where(F.col("id") != start)
    frontier = seen
    for k in range(2, depth + 1):
        new = e.join(frontier.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct().where(F.col("id") != start)
        frontier = new.join(seen, "id", "left_anti").select("id", F.lit(k).alias("depth"))
        seen = seen.unionByName(frontier)
    return seen


def scc(edges: DataFrame) -> DataFrame:
    """id, component: the strongly connected components of more than one node (or with a self loop), named by their smallest node.

    Nodes that can't be on a cycle (no edge in or none out) are trimmed, then colours (the smallest node that reaches one) spread
    forward and, from each colour's node, membership spreads back within the colour; what is found is taken out, and so on.
    """
    spark = edges.sparkSession
    loops = edges.where("src = dst").select(F.col("src").alias("id")).distinct()
    e = cut(edges.where("src <> dst").select("src", "dst").distinct())
    found = spark.createDataFrame([], f"id {e.schema['src'].dataType.simpleString()}, component {e.schema['src'].dataType.simpleString()}")
    while True:
        size = e.count()
        while size:
            e = cut(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            now = e.count()
            if now == size:
                break
            size = now
        if not size:
            break
        nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
        colour = cut(nodes.withColumn("colour", F.col("id")))
        while True:
            low = e.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("c"))
            new = cut(colour.join(low, "id", "left").select("id", F.least("colour", F.coalesce("c", "colour")).alias("colour"), (F.col("c") < F.col("colour")).alias("moved")))
            colour, moved = new.select("id", "colour"), not new.where("moved").isEmpty()
            if not moved:
                break
        inside = e.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("c1")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("c2")), "dst").where("c1 = c2").select("src", "dst", F.col("c1").alias("colour"))
        inside = cut(inside)
        member = cut(colour.where("id = colour"))
        frontier = member
        while True:
            back = inside.join(frontier.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"), "colour").distinct().join(member.select("id"), "id", "left_anti")
            frontier = cut(back)
            if frontier.isEmpty():
                break
            member = cut(member.unionByName(frontier))
        big = member.groupBy("colour").count().where("count > 1").select("colour")
        found = cut(found.unionByName(member.join(big, "colour", "left_semi").select("id", F.col("colour").alias("component"))))
        gone = member.select("id")
        e = cut(e.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"))
    single = loops.join(found, "id", "left_anti").select("id", F.col("id").alias("component"))
    return found.unionByName(single)


def health(n: Column, cycles: Column, gods: Column, longs: Column, dead: Column) -> tuple[Column, Column]:
    """The score from 0 to 100 and its grade."""
    score = F.greatest(F.lit(0.0), F.floor(100 - (10 * cycles + 8 * gods + 4 * longs + dead) / F.greatest(F.lit(1.0), n / 50.0) + 0.5))
    grade = F.when(score >= 85, "A").when(score >= 70, "B").when(score >= 50, "C").otherwise("D")
    return score, grade


def legacy_score(importers: Column, route: Column, component: Column) -> tuple[Column, Column]:
    """The capped score and liveness of a file."""
    score = F.least(F.lit(100), 10 + F.when(route, 40).otherwise(0) + F.when(component, 15).otherwise(0) + 12 * importers)
    live = F.when(route, "alive").when(importers > 1, "bonded").when(importers == 0, "dead").otherwise("sleeping")
    return score, live


def common_root(paths: DataFrame) -> DataFrame:
    """One row, root: the folder that all paths (path) share. Smallest and largest path decide."""
    x = paths.agg(F.split(F.min("path"), "/").alias("a"), F.split(F.max("path"), "/").alias("b"))
    same = F.aggregate(F.zip_with("a", "b", lambda p, q: F.struct(p.alias("p"), q.alias("q"))), F.struct(F.lit(True).alias("on"), F.array().cast("array<string>").alias("r")), lambda acc, z: F.struct((acc.on & z.p.eqNullSafe(z.q)).alias("on"), F.when(acc.on & z.p.eqNullSafe(z.q), F.array_append(acc.r, z.p)).otherwise(acc.r).alias("r")), lambda acc: F.array_join(acc.r, "/"))
    return x.select(same.alias("root"))


def file_graph(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """src, dst: different files that edges between their symbols (id, file) connect, once."""
    a, b = symbols.select(F.col("id").alias("src"), F.col("file").alias("a")), symbols.select(F.col("id").alias("dst"), F.col("file").alias("b"))
    return edges.join(a, "src").join(b, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def long_files(files: DataFrame, most: int = 500) -> DataFrame:
    """Files (..., text) with more lines than that, and how many, in place of the text."""
    return files.withColumn("lines", F.size(F.split("text", "\n", -1)).cast("long")).where(F.col("lines") > most).drop("text")


def dead_files(files: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """Files (key, path) that nothing names, but for entry points, tests, settings and folders loaded by name."""
    p = F.col("path")
    return files.where(~entry_point(p) & ~test_or_config(p) & ~dynamic_folder(p)).join(named.select(key), key, "left_anti")
