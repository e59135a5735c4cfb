"""Queries of lookups, joins and grouped counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataforge.functions.numbers import half_up
from strataforge.functions.text import reason, specifier_kind, split_reason
from strataforge.operators import relational as R
from strataforge.plans import adapters as A
from strataforge.plans.catalogue import register
from strataforge.plans.tabular import read


@register("repo_map_left_count", "SELECT p_partkey, count(l_partkey)::BIGINT AS n FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1")
def repo_map_left_count(spark, d):
    return R.left_counts(read(spark, d, "part").select("p_partkey"), read(spark, d, "lineitem").select("l_partkey"), "p_partkey", "l_partkey")


@register("repo_map_orders", "SELECT o_orderkey, count(l_orderkey)::BIGINT AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def repo_map_orders(spark, d):
    return R.left_counts(read(spark, d, "orders").select("o_orderkey"), read(spark, d, "lineitem").select("l_orderkey"), "o_orderkey", "l_orderkey")


@register("dead_nodes_orders", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def dead_nodes_orders(spark, d):
    return R.without_match(read(spark, d, "orders").select("o_orderkey"), read(spark, d, "lineitem"), "o_orderkey", "l_orderkey")


for _name, _in in (("forward_deps", False), ("reverse_deps", True)):
    _near, _far = ("dst", "src") if _in else ("src", "dst")
    register(_name, f"SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey IN (SELECT {_far} FROM ({A.DISTINCT_EDGES}) WHERE {_near} = 1)")(lambda s, d, i=_in: R.neighbours(A.parts(s, d), A.part_edges(s, d), 1, incoming=i))


@register("find_references", f"SELECT src, p_name AS name, count(*)::BIGINT AS uses FROM ({A.EDGES.format(where='')}) JOIN part ON p_partkey = src WHERE dst = 1 GROUP BY ALL")
def find_references(spark, d):
    e = A.part_edges(spark, d, distinct=False).where("dst = 1").groupBy("src").agg(F.count("*").alias("uses"))
    return e.join(A.parts(spark, d).withColumnRenamed("id", "src"), "src").select("src", "name", "uses")


@register("delete_safe_anti", f"SELECT p_partkey AS id, count(src)::BIGINT AS incoming, count(src) = 0 AS safe FROM part LEFT JOIN ({A.DISTINCT_EDGES}) ON dst = p_partkey GROUP BY 1")
def delete_safe_anti(spark, d):
    return R.delete_safe(A.parts(spark, d), A.part_edges(spark, d))


@register("rename_collision", "SELECT lower(p_name) AS name, count(*)::BIGINT AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def rename_collision(spark, d):
    return R.name_collisions(A.parts(spark, d))


@register("rename_safe", f"SELECT collisions, dependents, CASE WHEN collisions > 0 THEN 'COLLISION' WHEN dependents > 0 THEN 'NEEDS_UPDATES' ELSE 'SAFE' END AS verdict FROM (SELECT (SELECT count(*) FROM part WHERE lower(p_name) = 'no such name') AS collisions, (SELECT count(*) FROM ({A.DISTINCT_EDGES}) WHERE dst IN (SELECT p_partkey FROM part WHERE p_name = 'red widget')) AS dependents)")
def rename_safe(spark, d):
    return R.rename_safe(A.parts(spark, d), A.part_edges(spark, d), "red widget", "no such name")


@register("union_edges", " UNION ".join(A.EDGES.format(where=f" WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = '{x}')") for x in "FO"))
def union_edges(spark, d):
    return A.part_edges(spark, d, False, "o_orderstatus = 'F'").unionByName(A.part_edges(spark, d, False, "o_orderstatus = 'O'")).distinct()


@register("bag_union_edges", f"SELECT src AS id, 'caller' AS relation FROM ({A.DISTINCT_EDGES}) WHERE dst = 1 UNION ALL SELECT dst, 'callee' FROM ({A.DISTINCT_EDGES}) WHERE src = 1")
def bag_union_edges(spark, d):
    e = A.part_edges(spark, d)
    return e.where("dst = 1").select(F.col("src").alias("id"), F.lit("caller").alias("relation")).unionByName(e.where("src = 1").select(F.col("dst").alias("id"), F.lit("callee").alias("relation")))


@register("set_difference", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49")
def set_difference(spark, d):
    return read(spark, d, "part").select("p_partkey").exceptAll(read(spark, d, "lineitem").where("l_quantity > 49").select("l_partkey").distinct())


@register("semi_exists", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')")
def semi_exists(spark, d):
    return R.with_match(read(spark, d, "customer").select("c_custkey", "c_name"), read(spark, d, "orders").where("o_orderpriority LIKE '1%'"), "c_custkey", "o_custkey")


@register("unresolved_left_anti", f"SELECT spec, count(*)::BIGINT AS n FROM ({A.HREFS}) WHERE spec NOT IN (SELECT url FROM pages) GROUP BY 1 ORDER BY n DESC, spec LIMIT 20")
def unresolved_left_anti(spark, d):
    left = R.without_match(A.hrefs(spark, d), read(spark, d, "pages"), "spec", "url")
    return left.groupBy("spec").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "spec").limit(20)


@register("specifier_kind", f"SELECT CASE WHEN spec LIKE '@/%' OR spec LIKE '#%' THEN 'unresolved_alias' WHEN spec LIKE '.%' THEN 'unresolved_relative' WHEN spec LIKE '/%' THEN 'unresolved_absolute' ELSE 'external_package' END AS kind, count(*)::BIGINT AS n FROM ({A.HREFS}) GROUP BY 1")
def specifier_kinds(spark, d):
    return A.hrefs(spark, d).groupBy(specifier_kind(F.col("spec")).alias("kind")).agg(F.count("*").alias("n"))


@register("path_suffix_lookup", "SELECT page_id, url FROM pages WHERE ends_with(url, '.html') ORDER BY length(url), url LIMIT 1")
def path_suffix_lookup(spark, d):
    return R.path_suffix(read(spark, d, "pages").select("page_id", F.col("url").alias("path")), ".html").select("page_id", F.col("path").alias("url"))


@register("ci_lookup", "SELECT p_partkey AS id, p_name AS name FROM part WHERE lower(p_name) = 'red widget' ORDER BY 1 LIMIT 10")
def ci_lookup(spark, d):
    return R.symbol_lookup(A.parts(spark, d), "RED Widget", ignore_case=True)


@register("symbol_lookup", "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_name = 'red widget' ORDER BY 1 LIMIT 10")
def symbol_lookup(spark, d):
    return R.symbol_lookup(A.parts(spark, d), "red widget")


ROUTES = ["%/en/%", "%/de/1%", "%.html", "%ref=x%"]


@register("route_filter", "SELECT page_id, url FROM pages WHERE " + " OR ".join(f"lower(url) LIKE '{p}'" for p in ROUTES))
def route_filter(spark, d):
    return read(spark, d, "pages").select("page_id", "url").where(R.any_like(F.col("url"), ROUTES))


@register("substring_search", "SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(lower(p_name), 'ring') ORDER BY 1 LIMIT 50")
def substring_search(spark, d):
    return R.substring_search(A.parts(spark, d), ["name"], "Ring")


@register("outline_sorted", "SELECT l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey = 7 ORDER BY ALL")
def outline_sorted(spark, d):
    return read(spark, d, "lineitem").where("l_orderkey = 7").select("l_linenumber", "l_partkey", "l_suppkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")


TYPES = ["view", "click", "purchase", "signup", "error"]


@register("conditional_counts", "SELECT count(*)::BIGINT AS n, " + ", ".join(f"count_if(event_type = '{t}')::BIGINT AS n_{t}" for t in TYPES) + ", floor(avg(value) * 1000 + 0.5) / 1000 AS avg_value FROM events")
def conditional_counts(spark, d):
    return read(spark, d, "events").agg(F.count("*").alias("n"), *(F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in TYPES), half_up(F.avg("value")).alias("avg_value"))


@register("group_two_keys_avg", "SELECT lang, source, count(*)::BIGINT AS n, floor(avg(n_chars) * 1000 + 0.5) / 1000 AS avg_chars FROM documents GROUP BY ALL")
def group_two_keys_avg(spark, d):
    return read(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), half_up(F.avg("n_chars")).alias("avg_chars"))


@register("distinct_rates", "SELECT count(DISTINCT user_id)::BIGINT AS users, count(DISTINCT CASE WHEN event_type = 'error' THEN user_id END)::BIGINT AS error_users, round(count(DISTINCT CASE WHEN event_type = 'error' THEN user_id END) / count(DISTINCT user_id), 6) AS user_rate, round(count_if(event_type = 'error') / count(*), 6) AS event_rate FROM events")
def distinct_rates(spark, d):
    per_user = read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("e"))
    one = per_user.agg(F.count("*").alias("users"), F.count_if(F.col("e") > 0).alias("error_users"), F.sum("n").alias("n"), F.sum("e").alias("e"))
    return one.select("users", "error_users", F.round(F.col("error_users") / F.col("users"), 6).alias("user_rate"), F.round(F.col("e") / F.col("n"), 6).alias("event_rate"))


@register("top_unresolved", f"SELECT page_id, count(*)::BIGINT AS n FROM ({A.HREFS}) GROUP BY 1 ORDER BY n DESC, page_id LIMIT 10")
def top_unresolved(spark, d):
    return A.hrefs(spark, d).groupBy("page_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "page_id").limit(10)


@register("correlated_counts", "SELECT s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey)::BIGINT AS n FROM supplier")
def correlated_counts(spark, d):
    return R.left_counts(read(spark, d, "supplier").select("s_suppkey"), read(spark, d, "lineitem").select("l_suppkey"), "s_suppkey", "l_suppkey")


@register("stats_row", "SELECT (SELECT count(*) FROM orders)::BIGINT AS orders, (SELECT count(*) FROM lineitem)::BIGINT AS lines, (SELECT count(*) FROM part)::BIGINT AS parts, (SELECT floor(avg(o_totalprice) * 1000 + 0.5) / 1000 FROM orders) AS avg_price, (SELECT epoch_us(max(ts)) FROM events) AS last_event")
def stats_row(spark, d):
    one = lambda t, *a: read(spark, d, t).agg(*a)
    return one("orders", F.count("*").alias("orders"), half_up(F.avg("o_totalprice")).alias("avg_price")).crossJoin(one("lineitem", F.count("*").alias("lines"))).crossJoin(one("part", F.count("*").alias("parts"))).crossJoin(one("events", F.unix_micros(F.max("ts").cast("timestamp")).alias("last_event")))


@register("diagnostic_groups", "SELECT CASE WHEN toxic = 1 THEN 'TOXIC' WHEN quality = 0 THEN 'LOW_QUALITY' ELSE 'OK' END AS code, CASE WHEN toxic = 1 THEN 'error' WHEN quality = 0 THEN 'warn' ELSE 'info' END AS severity, count(*)::BIGINT AS n, min(doc_id) AS first_doc FROM labels GROUP BY ALL")
def diagnostic_groups(spark, d):
    bad, low = F.col("toxic") == 1, F.col("quality") == 0
    r = reason(F.when(bad, "TOXIC").when(low, "LOW_QUALITY").otherwise("OK"), F.when(bad, "error").when(low, "warn").otherwise("info"), F.concat(F.lit("document "), F.col("doc_id").cast("string")), F.lit("inspect"))
    x = read(spark, d, "labels").select("doc_id", split_reason(r).alias("r"))
    return x.groupBy("r.code", "r.severity").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@register("name_resolution", """
WITH sym AS (SELECT p_partkey AS id, p_name AS name, p_size AS file_id FROM part),
few AS (SELECT name FROM sym GROUP BY 1 HAVING count(*) <= 40),
call AS (SELECT DISTINCT p_partkey AS src, 'red ' || split_part(p_name, ' ', 2) AS name, p_size AS file_id FROM part),
loc AS (SELECT c.src, c.name, c.file_id, s.id AS dst FROM call c JOIN sym s ON c.name = s.name AND c.file_id = s.file_id),
wide AS (SELECT c.src, s.id AS dst FROM call c JOIN sym s ON c.name = s.name WHERE c.name IN (SELECT name FROM few) AND NOT EXISTS (SELECT 1 FROM loc l WHERE l.src = c.src AND l.name = c.name AND l.file_id = c.file_id))
SELECT DISTINCT src, dst FROM (SELECT src, dst FROM loc UNION ALL SELECT src, dst FROM wide) WHERE src <> dst""")
def name_resolution(spark, d):
    p = read(spark, d, "part")
    symbols = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("file_id"))
    calls = p.select(F.col("p_partkey").alias("src"), F.concat(F.lit("red "), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("name"), F.col("p_size").alias("file_id")).distinct()
    return R.resolve_names(calls, symbols, ["if", "for", "while"], most=40)


@register("symbol_capsule", f"""WITH e AS ({A.DISTINCT_EDGES}), n AS (SELECT p_partkey AS id, p_name AS name FROM part),
c AS (SELECT id, string_agg(name, ',' ORDER BY name) AS callers FROM (SELECT dst AS id, name, row_number() OVER (PARTITION BY dst ORDER BY name) AS p FROM (SELECT DISTINCT dst, name FROM e JOIN n ON n.id = src)) WHERE p <= 25 GROUP BY 1),
x AS (SELECT id, string_agg(name, ',' ORDER BY name) AS deps FROM (SELECT src AS id, name, row_number() OVER (PARTITION BY src ORDER BY name) AS p FROM (SELECT DISTINCT src, name FROM e JOIN n ON n.id = dst)) WHERE p <= 25 GROUP BY 1)
SELECT n.id, n.name, coalesce(callers, '') AS callers, coalesce(deps, '') AS deps FROM n LEFT JOIN c ON c.id = n.id LEFT JOIN x ON x.id = n.id""")
def symbol_capsule(spark, d):
    return R.capsule(A.parts(spark, d), A.part_edges(spark, d))


@register("theta_contains", "SELECT DISTINCT doc_id AS id, w AS name FROM documents JOIN (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS w FROM part) ON contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), w)")
def theta_contains(spark, d):
    names = read(spark, d, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name"))
    return R.contains_join(read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), names)
