"""Queries of graph analytics over the graph of consecutive parts and of nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataforge.operators import graph as G
from strataforge.operators.relational import left_counts
from strataforge.plans import adapters as A
from strataforge.plans.catalogue import register
from strataforge.plans.tabular import read

E = A.DISTINCT_EDGES


def _pagerank_sql(rounds: int = 20) -> str:
    out = [f"e AS MATERIALIZED (SELECT src, dst, count(*) OVER (PARTITION BY src) AS o FROM ({E}))", "n AS MATERIALIZED (SELECT p_partkey AS id, p_partkey NOT IN (SELECT src FROM e) AS loose, (SELECT count(*) FROM part) AS n FROM part)", "r0 AS MATERIALIZED (SELECT id, loose, n, 1.0::DOUBLE / n AS r FROM n)"]
    for i in range(rounds):
        out.append(f"r{i + 1} AS MATERIALIZED (SELECT n.id, n.loose, n.n, 0.15::DOUBLE / n.n + 0.85::DOUBLE * (coalesce(g, 0) + (SELECT coalesce(sum(r), 0) FROM r{i} WHERE loose) / n.n) AS r FROM n LEFT JOIN (SELECT dst, sum(r / o) AS g FROM e JOIN r{i} ON id = src GROUP BY 1) ON dst = n.id)")
    return "WITH " + ", ".join(out) + " "


PR = _pagerank_sql()


def _rank(spark, d):
    return G.pagerank(A.parts(spark, d), A.part_edges(spark, d))


@register("pagerank_k", PR + "SELECT id, round(r, 6) AS rank FROM r20")
def pagerank_k(spark, d):
    return _rank(spark, d).select("id", F.round("rank", 6).alias("rank"))


DEGREES = f"(SELECT p_partkey AS id, (SELECT count(*) FROM ({E}) WHERE dst = p_partkey) AS i, (SELECT count(DISTINCT dst) FROM ({E}) WHERE src = p_partkey) AS o FROM part)"


@register("importance", PR + f", g AS (SELECT dst, count(*) AS i FROM e GROUP BY 1) SELECT id, round(10.0::DOUBLE * coalesce(i, 0) + 1000.0::DOUBLE * r, 4) AS importance FROM r20 LEFT JOIN g ON dst = id")
def importance(spark, d):
    return G.importance(G.degrees(A.parts(spark, d), A.part_edges(spark, d)), _rank(spark, d)).select("id", F.round("importance", 4).alias("importance"))


@register("importance_with_legacy", PR + f", g AS (SELECT dst, count(*) AS i FROM e GROUP BY 1) SELECT id, round(10.0::DOUBLE * coalesce(i, 0) + 1000.0::DOUBLE * r + 2.0::DOUBLE * p_size, 4) AS importance FROM r20 JOIN part ON p_partkey = id LEFT JOIN g ON dst = id")
def importance_with_legacy(spark, d):
    legacy = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("score"))
    return G.importance(G.degrees(A.parts(spark, d), A.part_edges(spark, d)), _rank(spark, d), legacy).select("id", F.round("importance", 4).alias("importance"))


HOT = PR + f", g AS (SELECT dst, count(*) AS i FROM e GROUP BY 1), imp AS (SELECT id, 10.0::DOUBLE * coalesce(i, 0) + 1000.0::DOUBLE * r AS v FROM r20 LEFT JOIN g ON dst = id), o AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS commits FROM lineitem GROUP BY 1)"


@register("hotspots", HOT + " SELECT id, commits::BIGINT AS commits, round(v + 5 * commits, 4) AS risk FROM (SELECT id, v FROM imp ORDER BY round(v, 4) DESC, id LIMIT 20) JOIN o ON l_partkey = id ORDER BY risk DESC, id LIMIT 10")
def hotspots(spark, d):
    """The twenty most important nodes, by importance and number of orders, the first ten."""
    imp = G.importance(G.degrees(A.parts(spark, d), A.part_edges(spark, d)), _rank(spark, d))
    top = imp.orderBy(F.desc(F.round("importance", 4)), "id").limit(20)
    orders = read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count_distinct("l_orderkey").alias("commits"))
    return orders.join(F.broadcast(top), "id").select("id", "commits", F.round(F.col("importance") + 5 * F.col("commits"), 4).alias("risk")).orderBy(F.desc("risk"), "id").limit(10)


@register("degree_classes", f"WITH e AS MATERIALIZED ({E}), d AS (SELECT p_partkey AS id, coalesce(i, 0) AS i, coalesce(o, 0) AS o, p_size AS s FROM part LEFT JOIN (SELECT dst, count(*) AS i FROM e GROUP BY 1) ON dst = p_partkey LEFT JOIN (SELECT src, count(DISTINCT dst) AS o FROM e GROUP BY 1) ON src = p_partkey) SELECT id, i::BIGINT AS in_degree, o::BIGINT AS out_degree, CASE WHEN i > 0 AND o > 0 THEN 'connected' WHEN i > 0 THEN 'leaf' WHEN o > 0 THEN 'root' WHEN s > 0 THEN 'isolated' ELSE 'empty' END AS class FROM d")
def degree_classes(spark, d):
    x = G.degrees(A.parts(spark, d), A.part_edges(spark, d)).join(read(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size"), "id")
    return x.select("id", "in_degree", "out_degree", G.connectivity(F.col("in_degree"), F.col("out_degree"), F.col("p_size")).alias("class"))


@register("connectivity_counts", "SELECT CASE WHEN n > 0 THEN 'root' ELSE 'empty' END AS class, count(*)::BIGINT AS n FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) GROUP BY 1")
def connectivity_counts(spark, d):
    x = left_counts(read(spark, d, "orders").select("o_orderkey"), read(spark, d, "lineitem").select("l_orderkey"), "o_orderkey", "l_orderkey", "outs")
    return x.groupBy(G.connectivity(F.lit(0), F.col("outs"), F.lit(0)).alias("class")).agg(F.count("*").alias("n"))


@register("god_objects", f"SELECT dst AS id, count(*)::BIGINT AS fan_in FROM ({E}) GROUP BY 1 HAVING count(*) > 20")
def god_objects(spark, d):
    return G.god_objects(A.part_edges(spark, d))


for _name, _in in (("call_hierarchy", False), ("call_hierarchy_callers", True)):
    _a, _b = ("dst", "src") if _in else ("src", "dst")
    register(_name, f"WITH e AS MATERIALIZED (SELECT {_a} AS a, {_b} AS b FROM ({E})), one AS (SELECT DISTINCT b AS id FROM e WHERE a = 1), two AS (SELECT DISTINCT b AS id FROM e WHERE a IN (SELECT id FROM one)) SELECT id, min(depth)::INTEGER AS depth FROM (SELECT id, 1 AS depth FROM one UNION ALL SELECT id, 2 FROM two) WHERE id <> 1 GROUP BY 1")(lambda s, d, i=_in: G.traverse(A.part_edges(s, d), 1, 2, incoming=i))


@register("scc")
def scc(spark, d):
    return G.scc(A.part_edges(spark, d))


NATIONS = "SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"
CYCLES = f"WITH RECURSIVE e AS ({NATIONS}), r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b), s AS (SELECT x.a AS id, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"


@register("scc_nations", CYCLES + " SELECT id, component FROM s")
def scc_nations(spark, d):
    return G.scc(A.nation_edges(spark, d))


@register("health_with_long_files", CYCLES + ", f AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(DISTINCT component) FROM s) AS cycles, (SELECT count(*) FROM (SELECT dst FROM e GROUP BY 1 HAVING count(*) > 20)) AS gods, (SELECT count(*) FROM documents WHERE len(string_split(text, chr(10))) > 40) AS longs, (SELECT count(*) FROM documents WHERE text IS NULL OR text = '') AS dead) SELECT n, longs, greatest(0.0::DOUBLE, floor(100 - (10 * cycles + 8 * gods + 4 * longs + dead) / greatest(1.0::DOUBLE, n / 50.0::DOUBLE) + 0.5)) AS score, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 50 THEN 'C' ELSE 'D' END AS grade FROM f")
def health_with_long_files(spark, d):
    """Documents as files: long ones count, too."""
    e, docs = A.nation_edges(spark, d), read(spark, d, "documents")
    files = docs.agg(F.count("*").alias("n"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("dead"))
    longs = G.long_files(docs.select("doc_id", "text"), 40).agg(F.count("*").alias("longs"))
    x = files.crossJoin(longs).crossJoin(G.scc(e).agg(F.count_distinct("component").alias("cycles"))).crossJoin(G.god_objects(e).agg(F.count("*").alias("gods")))
    score, grade = G.health(F.col("n"), F.col("cycles"), F.col("gods"), F.col("longs"), F.col("dead"))
    return x.select("n", "longs", score.alias("score"), grade.alias("grade"))


@register("health_score", CYCLES + ", f AS (SELECT (SELECT count(*) FROM nation) AS n, (SELECT count(DISTINCT component) FROM s) AS cycles, (SELECT count(*) FROM (SELECT dst FROM e GROUP BY 1 HAVING count(*) > 20)) AS gods, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS dead) SELECT n, cycles, gods, dead, greatest(0.0::DOUBLE, floor(100 - (10 * cycles + 8 * gods + dead) / greatest(1.0::DOUBLE, n / 50.0::DOUBLE) + 0.5)) AS score, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 50 THEN 'C' ELSE 'D' END AS grade FROM f")
def health_score(spark, d):
    e = A.nation_edges(spark, d)
    n = read(spark, d, "nation").agg(F.count("*").alias("n"))
    cycles = G.scc(e).agg(F.count_distinct("component").alias("cycles"))
    gods = G.god_objects(e).agg(F.count("*").alias("gods"))
    dead = read(spark, d, "orders").join(read(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").agg(F.count("*").alias("dead"))
    x = n.crossJoin(cycles).crossJoin(gods).crossJoin(dead)
    score, grade = G.health(F.col("n"), F.col("cycles"), F.col("gods"), F.lit(0), F.col("dead"))
    return x.withColumn("score", score).withColumn("grade", G.health(F.col("n"), F.col("cycles"), F.col("gods"), F.lit(0), F.col("dead"))[1])


@register("legacy_scores", f"WITH g AS (SELECT p_partkey AS id, count(src) AS i, p_type = 'ECONOMY' AS route, p_size > 25 AS comp FROM part LEFT JOIN ({E}) ON dst = p_partkey GROUP BY ALL) SELECT id, least(100, 10 + CASE WHEN route THEN 40 ELSE 0 END + CASE WHEN comp THEN 15 ELSE 0 END + 12 * i)::BIGINT AS score, CASE WHEN route THEN 'alive' WHEN i > 1 THEN 'bonded' WHEN i = 0 THEN 'dead' ELSE 'sleeping' END AS liveness FROM g")
def legacy_scores(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_type") == "ECONOMY").alias("route"), (F.col("p_size") > 25).alias("comp"))
    x = left_counts(p, A.part_edges(spark, d), "id", "dst", "i")
    score, live = G.legacy_score(F.col("i"), F.col("route"), F.col("comp"))
    return x.select("id", score.cast("long").alias("score"), live.alias("liveness"))


@register("common_root", "SELECT '/data/example' AS root")
def common_root(spark, d):
    paths = read(spark, d, "pages").select(F.concat(F.lit("/data/example/"), F.col("page_id").cast("string"), F.lit("/index.html")).alias("path"))
    return G.common_root(paths)


@register("dead_code_scan", f"WITH g AS (SELECT p_partkey AS id, count(src) AS i, CASE WHEN p_type = 'PROMO' THEN 1 WHEN p_type = 'ECONOMY' THEN 3 WHEN p_type = 'STANDARD' THEN 8 ELSE 5 END AS w FROM part LEFT JOIN ({E}) ON dst = p_partkey GROUP BY ALL) SELECT status, count(*)::BIGINT AS n, min(id) AS first FROM (SELECT id, CASE WHEN i = 0 THEN 'dead' WHEN i <= 1 OR 10 * i + w < 15 THEN 'sleeping' ELSE 'alive' END AS status FROM g) GROUP BY 1")
def dead_code_scan(spark, d):
    w = F.when(F.col("p_type") == "PROMO", 1).when(F.col("p_type") == "ECONOMY", 3).when(F.col("p_type") == "STANDARD", 8).otherwise(5)
    x = left_counts(read(spark, d, "part").select(F.col("p_partkey").alias("id"), w.alias("w")), A.part_edges(spark, d), "id", "dst", "i")
    status = F.when(F.col("i") == 0, "dead").when((F.col("i") <= 1) | (10 * F.col("i") + F.col("w") < 15), "sleeping").otherwise("alive")
    return x.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.min("id").alias("first"))
