"""Views of the tables as the shapes that the operators take: nodes, edges, files, diagnostics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataforge.plans.tabular import read


def part_edges(spark, d, distinct: bool = True, where: str | None = None):
    """src, dst: consecutive parts of an order."""
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    if where:
        li = li.join(read(spark, d, "orders").where(where).select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    e = li.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst")).where("dst IS NOT NULL AND src <> dst")
    return e.distinct() if distinct else e


EDGES = "SELECT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem{where}) WHERE dst IS NOT NULL AND src <> dst"
DISTINCT_EDGES = "SELECT DISTINCT src, dst FROM (" + EDGES.format(where="") + ")"


def parts(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


def nation_edges(spark, d):
    """customer nation to supplier nation of the orders: a small, dense graph."""
    li = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("src"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst"))
    return li.join(o, "l_orderkey").join(c, "o_custkey").join(s, "l_suppkey").select("src", "dst").distinct()


def hrefs(spark, d):
    """page_id, spec of every link."""
    return read(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("spec"))


HREFS = "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS spec FROM pages"
