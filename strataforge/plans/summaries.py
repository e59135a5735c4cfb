"""Queries of filters, summaries and session reports that need no operator of their own size."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataforge.functions import text as X
from strataforge.functions import vectors as V
from strataforge.functions.decay import intent
from strataforge.operators import decisions as D
from strataforge.operators import graph as G
from strataforge.operators import relational as R
from strataforge.operators import reports as P
from strataforge.operators import state as S
from strataforge.operators import tabular as T
from strataforge.plans import adapters as A
from strataforge.plans.catalogue import register
from strataforge.plans.decisions import FILES, GATE, LEDGER, _gate, files
from strataforge.plans.sources import _scratch
from strataforge.plans.tabular import read


@register("test_file_filter", f"SELECT file_id, path FROM ({FILES}) WHERE path LIKE '%/tests/%' OR path LIKE '%.test.%' OR path LIKE '%.spec.%' OR path LIKE '%\\_test.%' ESCAPE '\\'")
def test_file_filter(spark, d):
    return files(spark, d).where(P.test_file(F.col("path"))).select("file_id", "path")


@register("excluded_names", "SELECT p_partkey, p_name FROM part WHERE p_name NOT IN ('red widget', 'blue ring', 'small gear', 'green bolt', 'steel nut')")
def excluded_names(spark, d):
    return P.without_names(read(spark, d, "part"), "p_name", ["red widget", "blue ring", "small gear", "green bolt", "steel nut"]).select("p_partkey", "p_name")


@register("glob_exclusions", "SELECT p_partkey FROM part WHERE NOT (p_type GLOB 'ECONOMY*' OR p_brand GLOB '*1?') AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)")
def glob_exclusions(spark, d):
    kept = read(spark, d, "part").where(~(P.glob(F.col("p_type"), "ECONOMY*") | P.glob(F.col("p_brand"), "*1?")))
    return R.with_match(kept.select("p_partkey"), read(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "p_partkey")


@register("visible_tools", "SELECT p_partkey AS id, p_name AS name, left(p_type, 10) AS summary FROM part WHERE p_brand <> 'Brand#11' AND p_size >= 25")
def visible_tools(spark, d):
    """Parts as tools: those of a hidden group or a lower tier are left out, the rest are projected to a compact form."""
    p = read(spark, d, "part")
    return P.visible(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("summary"), F.col("p_brand").alias("group"), F.col("p_size").alias("tier")), hidden=["Brand#11"], least=25, width=10)


@register("fossils", "WITH n AS (SELECT l_partkey AS id, count(DISTINCT l_suppkey) AS n FROM lineitem WHERE l_quantity >= 49 GROUP BY 1) SELECT p_partkey AS id, CASE WHEN coalesce(n, 0) = 0 THEN 'dead' ELSE 'sleeping' END AS status, coalesce(n, 0)::BIGINT AS score FROM part LEFT JOIN n ON p_partkey = id WHERE coalesce(n, 0) <= 1")
def fossils(spark, d):
    """Dead and sleeping nodes, least used first: parts by the suppliers that sell many of them at once."""
    used = read(spark, d, "lineitem").where("l_quantity >= 49").groupBy(F.col("l_partkey").alias("id")).agg(F.count_distinct("l_suppkey").alias("n"))
    x = A.parts(spark, d).select("id").join(used, "id", "left").na.fill(0, ["n"]).where("n <= 1")
    return x.select("id", F.when(F.col("n") == 0, "dead").otherwise("sleeping").alias("status"), F.col("n").alias("score")).sort("score", "id")


@register("unresolved_kinds", f"SELECT CASE WHEN starts_with(spec, '@/') OR starts_with(spec, '#') THEN 'unresolved_alias' WHEN starts_with(spec, '.') THEN 'unresolved_relative' WHEN starts_with(spec, '/') THEN 'unresolved_absolute' ELSE 'external_package' END AS kind, count(*)::BIGINT AS n FROM ({A.HREFS}) WHERE spec NOT IN (SELECT url FROM pages) GROUP BY 1")
def unresolved_kinds(spark, d):
    loose = A.hrefs(spark, d).join(read(spark, d, "pages").select(F.col("url").alias("spec")), "spec", "left_anti")
    return loose.groupBy(X.specifier_kind(F.col("spec")).alias("kind")).agg(F.count("*").alias("n"))


@register("unresolved_top", f"SELECT spec, count(*)::BIGINT AS n FROM ({A.HREFS}) WHERE spec NOT IN (SELECT url FROM pages) GROUP BY 1 ORDER BY n DESC, spec LIMIT 20")
def unresolved_top(spark, d):
    loose = A.hrefs(spark, d).join(read(spark, d, "pages").select(F.col("url").alias("spec")), "spec", "left_anti")
    return loose.groupBy("spec").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "spec").limit(20)


@register("completeness", "SELECT round(greatest(0, 100 - 100.0::DOUBLE * count_if(toxic = 1 OR quality = 0) / count(*)), 3) AS completeness FROM labels")
def completeness(spark, d):
    return P.completeness(read(spark, d, "labels").agg(F.count("*").alias("symbols"), F.count_if((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("blindspots")))


@register("token_savings", "SELECT sum(length(html) // 4)::BIGINT AS whole, sum(length(left(html, 400)) // 4)::BIGINT AS snippets, round(100.0::DOUBLE * (1 - sum(length(left(html, 400)) // 4) / sum(length(html) // 4)), 3) AS reduction FROM pages")
def token_savings(spark, d):
    return P.token_savings(read(spark, d, "pages").select(F.col("html").alias("text"), F.substr("html", F.lit(1), F.lit(400)).alias("snippet")))


RUNS = "SELECT o_orderpriority AS run, sum(o_totalprice)::DOUBLE AS baseline, sum(o_totalprice / 4)::DOUBLE AS payload FROM orders GROUP BY 1"


def _runs(spark, d):
    return read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("run")).agg(F.sum("o_totalprice").cast("double").alias("baseline"), F.sum(F.col("o_totalprice") / 4).cast("double").alias("payload"))


@register("run_totals", f"SELECT count(*)::BIGINT AS runs, round(sum(baseline), 2) AS baseline, round(sum(payload), 2) AS payload, round(100 * (1 - sum(payload) / sum(baseline)), 6) AS reduction, round(sum(baseline) / sum(payload), 6) AS factor FROM ({RUNS})")
def run_totals(spark, d):
    t = P.run_totals(_runs(spark, d))
    return t.select("runs", *(F.round(c, k).alias(c) for c, k in (("baseline", 2), ("payload", 2), ("reduction", 6), ("factor", 6))))


@register("run_anomalies", "SELECT doc_id AS run, concat_ws(',', CASE WHEN n_chars // 4 = 0 THEN 'no_baseline' END, CASE WHEN length(lang) > n_chars // 4 THEN 'payload_over_baseline' END, CASE WHEN n_chars > 20000 THEN 'slow' END) AS anomalies FROM documents WHERE n_chars // 4 = 0 OR length(lang) > n_chars // 4 OR n_chars > 20000")
def run_anomalies(spark, d):
    x = read(spark, d, "documents").select(F.col("doc_id").alias("run"), F.floor(F.col("n_chars") / 4).alias("baseline"), F.length("lang").alias("payload"), F.col("n_chars").alias("ms"))
    return P.run_anomalies(x, slow=20_000)


@register("staged_files", "WITH t AS (SELECT user_id AS id, count_if(event_type = 'view') AS o, count_if(event_type = 'click') AS p, count_if(event_type = 'purchase') AS e, max(value) AS exports FROM events GROUP BY 1) SELECT id, round(least(1.0::DOUBLE, 0.25::DOUBLE * ln(1 + o) + 0.5::DOUBLE * ln(1 + p) + 0.7::DOUBLE * ln(1 + e)), 6) AS intent, exports FROM t WHERE o + p + e > 0 ORDER BY intent DESC, exports DESC, id LIMIT 25")
def staged_files(spark, d):
    of = lambda t: F.count_if(F.col("event_type") == t)
    x = read(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(of("view").alias("o"), of("click").alias("p"), of("purchase").alias("e"), F.max("value").alias("exports")).where("o + p + e > 0")
    x = x.select("id", F.round(intent(F.col("o"), F.col("p"), F.col("e"), F.lit(0.0)), 6).alias("intent"), "exports")
    return P.staged(x, 25)


@register("args_hash", "SELECT o_orderkey, left(sha256('{\"customer\":' || o_custkey || ',\"status\":\"' || o_orderstatus || '\"}'), 16) AS hash FROM orders")
def args_hash(spark, d):
    return read(spark, d, "orders").select("o_orderkey", P.args_hash(status=F.col("o_orderstatus"), customer=F.col("o_custkey")).alias("hash"))


@register("uptime", "SELECT event_id, CASE WHEN event_id >= 3600 THEN event_id // 3600 || 'h ' || (event_id % 3600) // 60 || 'm' WHEN event_id >= 60 THEN event_id // 60 || 'm ' || event_id % 60 || 's' ELSE event_id || 's' END AS uptime FROM events")
def uptime(spark, d):
    return read(spark, d, "events").select("event_id", P.uptime(F.col("event_id")).alias("uptime"))


@register("path_parts", f"SELECT file_id, regexp_extract(path, '[^/]*$') AS base, lower(regexp_extract(path, '[^/](\\.[^./]*)$', 1)) AS ext FROM ({FILES})")
def path_parts(spark, d):
    return files(spark, d).select("file_id", X.basename(F.col("path")).alias("base"), X.extension(F.col("path")).alias("ext"))


@register("ordered_unique", "SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS types FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) GROUP BY 1")
def ordered_unique(spark, d):
    """Each user's different event types in the order in which they first came."""
    return P.ordered_unique(read(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("at"), F.col("event_type").alias("value"))).select(F.col("key").alias("user_id"), F.array_join("values", ",").alias("types"))


@register("candidate_pool", "SELECT DISTINCT id FROM (SELECT p_partkey AS id FROM part WHERE contains(lower(p_name), 'red') UNION ALL SELECT p_partkey FROM part WHERE p_retailprice > 1500 UNION ALL SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)")
def candidate_pool(spark, d):
    p, li = read(spark, d, "part"), read(spark, d, "lineitem")
    return P.pool(p.where(F.lower("p_name").contains("red")).select(F.col("p_partkey").alias("id")), p.where("p_retailprice > 1500").select(F.col("p_partkey").alias("id")), li.where("l_quantity >= 50").select(F.col("l_partkey").alias("id")))


FILE_EDGES = "SELECT DISTINCT a.p_brand AS src, b.p_brand AS dst FROM ({e}) e JOIN part a ON e.src = a.p_partkey JOIN part b ON e.dst = b.p_partkey WHERE a.p_brand <> b.p_brand"


def _file_edges(spark, d):
    """Edges of symbols (parts) as edges of their files (brands)."""
    return G.file_graph(A.part_edges(spark, d), read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("file")))


@register("file_graph", FILE_EDGES.format(e=A.DISTINCT_EDGES))
def file_graph(spark, d):
    return _file_edges(spark, d)


@register("left_counts_filtered", "SELECT s_suppkey, count(l_orderkey)::BIGINT AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_quantity > 40 WHERE s_nationkey < 12 GROUP BY 1")
def left_counts_filtered(spark, d):
    """Filters on both sides of a left join: the left one drops rows, the right one counts fewer."""
    s = read(spark, d, "supplier").where("s_nationkey < 12").select("s_suppkey")
    return R.left_counts(s, read(spark, d, "lineitem").where("l_quantity > 40").select("l_suppkey"), "s_suppkey", "l_suppkey")


@register("import_pairs", "SELECT DISTINCT a.n_name AS importer, b.n_name AS target FROM (SELECT DISTINCT c_nationkey, s_nationkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE o_orderpriority = '1-URGENT') JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey WHERE a.n_name <> b.n_name")
def import_pairs(spark, d):
    """Edges between nations joined with the names of both ends."""
    urgent = read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    x = read(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("s_suppkey")).join(urgent, "l_orderkey")
    x = x.join(read(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey").join(read(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey").select("c_nationkey", "s_nationkey").distinct()
    name = lambda key, alias: read(spark, d, "nation").select(F.col("n_nationkey").alias(key), F.col("n_name").alias(alias))
    return x.join(name("c_nationkey", "importer"), "c_nationkey").join(name("s_nationkey", "target"), "s_nationkey").where("importer <> target").select("importer", "target").distinct()


@register("ranked_dependencies", "SELECT DISTINCT l_orderkey, p_partkey, p_retailprice AS rank FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey <= 100")
def ranked_dependencies(spark, d):
    """Distinct dependencies of some sources, the highest ranked first."""
    li = read(spark, d, "lineitem").where("l_orderkey <= 100").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).distinct()
    return li.join(read(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("rank")), "p_partkey").select("l_orderkey", "p_partkey", "rank").sort("l_orderkey", F.desc("rank"), "p_partkey")


@register("callers_by_name", f"WITH e AS ({A.DISTINCT_EDGES}) SELECT a.p_name AS name, count(DISTINCT e.src)::BIGINT AS callers, count(DISTINCT b.p_name)::BIGINT AS names FROM part a JOIN e ON e.dst = a.p_partkey JOIN part b ON b.p_partkey = e.src GROUP BY 1")
def callers_by_name(spark, d):
    """Edges joined twice with the names of their ends."""
    p = A.parts(spark, d)
    x = A.part_edges(spark, d).join(p.select(F.col("id").alias("dst"), "name"), "dst").join(p.select(F.col("id").alias("src"), F.col("name").alias("caller")), "src")
    return x.groupBy("name").agg(F.count_distinct("src").alias("callers"), F.count_distinct("caller").alias("names"))


@register("top_importance", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 30")
def top_importance(spark, d):
    return read(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(30).select("p_partkey", "p_retailprice")


@register("timestamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM events")
def timestamps(spark, d):
    return read(spark, d, "events").select("event_id", X.iso_time(F.col("ts").cast("timestamp")).alias("iso"))


@register("offset_lines", "SELECT doc_id, (length(left(text, 300)) - length(replace(left(text, 300), chr(10), '')) + 1)::INTEGER AS line FROM documents WHERE text IS NOT NULL")
def offset_lines(spark, d):
    return read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.line_of(F.col("text"), F.lit(300)).alias("line"))


@register("protected_files", "SELECT key, intent > 0.2 AS protected FROM (SELECT user_id AS key, least(1.0::DOUBLE, 0.25::DOUBLE * ln(1 + count_if(event_type = 'view')) + 0.5::DOUBLE * ln(1 + count_if(event_type = 'click')) + 0.7::DOUBLE * ln(1 + count_if(event_type = 'purchase'))) AS intent FROM events GROUP BY 1)")
def protected_files(spark, d):
    of = lambda t: F.count_if(F.col("event_type") == t)
    x = read(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(intent(of("view"), of("click"), of("purchase"), F.lit(0.0)).alias("intent"))
    return x.select("key", D.protected(F.lit(False), F.col("intent")).alias("protected"))


@register("file_facts", "SELECT s_suppkey AS id, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey)::BIGINT AS symbols, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R')::BIGINT AS unresolved, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND l_discount > 0.05)::BIGINT AS dynamic, (SELECT min(l_orderkey) FROM lineitem WHERE l_suppkey = s_suppkey) AS first FROM supplier")
def file_facts(spark, d):
    """What a cascade asks about each file: several counts and a first one, by one aggregate before the join."""
    facts = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("symbols"), F.count_if(F.col("l_returnflag") == "R").alias("unresolved"), F.count_if(F.col("l_discount") > 0.05).alias("dynamic"), F.min("l_orderkey").alias("first"))
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("id")).join(facts, "id", "left").na.fill(0, ["symbols", "unresolved", "dynamic"])


@register("long_files", "SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS lines FROM documents WHERE len(string_split(text, chr(10))) > 40")
def long_files(spark, d):
    return G.long_files(read(spark, d, "documents").select("doc_id", "text"), 40)


@register("dead_files", f"SELECT file_id, path FROM ({FILES}) WHERE NOT regexp_matches(lower(path), 'index|main|layout|page|route|__init__|__main__|server|cli|backend|bridge|worker|service|coordinator|orchestrator|tower') AND NOT regexp_matches(lower(path), 'test|spec|conftest|config|setup|webpack|vite|package\\.json') AND NOT regexp_matches(lower(path), '(^|/)(skills|plugins|hooks|bin|scripts|tools|jobs)/|/(assets|public)/') AND file_id NOT IN (SELECT item_id FROM benchmark)")
def dead_files(spark, d):
    """Files that nothing names, but for entry points, tests, settings and folders that are loaded by name."""
    named = read(spark, d, "benchmark").select(F.col("item_id").alias("file_id"))
    return G.dead_files(files(spark, d).select("file_id", "path"), named, "file_id")


_VEC = "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings"


@register("unit_vectors", f"SELECT vec_id, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS length, round(u[1], 6) AS first FROM (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM ({_VEC}))")
def unit_vectors(spark, d):
    u = read(spark, d, "embeddings").select("vec_id", V.normalise(F.col("embedding")).alias("u"))
    return u.select("vec_id", F.round(V.dot(F.col("u"), F.col("u")), 6).alias("length"), F.round(F.get("u", F.lit(0)), 6).alias("first"))


@register("mean_pooling", f"SELECT vec_id, round(p[1] / sqrt(list_sum(list_transform(p, lambda x: x * x))), 6) AS first FROM (SELECT a.vec_id, list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] + b.v[i]) / 2) AS p FROM ({_VEC}) a JOIN ({_VEC}) b ON b.vec_id = a.vec_id + 1)")
def mean_pooling(spark, d):
    """Each vector pooled with the next one, and a third that the mask leaves out."""
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    x = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    pooled = V.mean_pool(F.array("a", "b", F.transform("a", lambda v: v * 100)), F.array(F.lit(1), F.lit(1), F.lit(0)))
    return x.select("vec_id", F.round(F.get(pooled, F.lit(0)), 6).alias("first"))


@register("aggregate_edges", "SELECT 'a' AS k, 0.0::DOUBLE AS avg, 'inf'::DOUBLE AS min, '-inf'::DOUBLE AS max, 0.0::DOUBLE AS sum, 2.0::DOUBLE AS n UNION ALL SELECT 'b', 1.5::DOUBLE, 0.0::DOUBLE, 3.0::DOUBLE, 3.0::DOUBLE, 3.0::DOUBLE")
def aggregate_edges(spark, d):
    """Groups without numbers, and cells that are blank, words or numbers."""
    x = spark.createDataFrame([("a", "x"), ("a", "1f"), ("b", ""), ("b", "3"), ("b", "y")], "k string, v string")
    out = T.aggregate(x, "k", "v", "avg").withColumnRenamed("avg_v", "avg")
    for op in ("min", "max", "sum"):
        out = out.join(T.aggregate(x, "k", "v", op).withColumnRenamed(f"{op}_v", op), "k")
    return out.join(T.aggregate(x, "k", "v", "median").withColumnRenamed("count_v", "n"), "k")


@register("redact_nested", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'key [REDACTED_SECRET]' ELSE 'key none' END AS text, 'a,' || CASE WHEN p_partkey % 3 = 0 THEN '[REDACTED_SECRET]' ELSE 'none' END AS list, CASE WHEN p_partkey % 3 = 0 THEN '[REDACTED_SECRET]' ELSE 'none' END AS inside FROM part")
def redact_nested(spark, d):
    """A key of a cloud account in a text, an array and a map."""
    secret = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("AKIA"), F.lpad(F.col("p_partkey").cast("string"), 16, "7"))).otherwise("none")
    x = read(spark, d, "part").select("p_partkey", F.concat(F.lit("key "), secret).alias("text"), F.array(F.lit("a"), secret).alias("list"), F.create_map(F.lit("k"), secret).alias("map"))
    x = P.redact_values(x, ["text", "list", "map"])
    return x.select("p_partkey", "text", F.array_join("list", ",").alias("list"), F.element_at("map", "k").alias("inside"))


@register("memory_events", "SELECT event_type AS type, count(*)::BIGINT AS n, max(length('user ' || user_id || ' ' || repeat('x', (event_id % 30)::INTEGER))) AS longest FROM (SELECT event_id, user_id, CASE WHEN event_id % 11 = 0 THEN 'nonsense' ELSE event_type END AS event_type FROM events) WHERE event_type <> 'nonsense' GROUP BY 1")
def memory_events(spark, d):
    e = read(spark, d, "events").select(F.when(F.col("event_id") % 11 == 0, "nonsense").otherwise(F.col("event_type")).alias("type"), F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" "), F.repeat(F.lit("x"), (F.col("event_id") % 30).cast("int"))).alias("summary"))
    return P.memory_events(e).groupBy("type").agg(F.count("*").alias("n"), F.max(F.length("summary")).cast("long").alias("longest"))


@register("memory_paths", "SELECT type, n, paths AS last_paths FROM (SELECT event_type AS type, count(*)::BIGINT AS n FROM events GROUP BY 1) JOIN (SELECT event_type AS type, string_agg('u' || user_id, ',' ORDER BY p) AS paths FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS p FROM events) WHERE p <= 10 GROUP BY 1) USING (type)")
def memory_paths(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("type"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"))
    return P.memory_paths(e).withColumn("last_paths", F.array_join("last_paths", ","))


@register("ledger_artifacts", f"SELECT 'state' AS what, state AS name, count(*)::BIGINT AS n FROM ({LEDGER}) GROUP BY 2 UNION ALL SELECT 'kind', kind, count(*)::BIGINT FROM ({LEDGER}) GROUP BY 2 UNION ALL SELECT 'blocking', 'rows', count(*)::BIGINT FROM ({LEDGER}) WHERE state IN ('resolver_missing', 'requires_runtime', 'failed_with_reason')")
def ledger_artifacts(spark, d):
    """The artifacts written, and read back."""
    folder = _scratch(spark, "ledger")
    P.ledger_artifacts(D.resolution(files(spark, d)), folder)
    of = lambda what: spark.read.schema(f"{what} string, n long").json(f"{folder}/by_{what}").select(F.lit(what).alias("what"), F.col(what).alias("name"), "n")
    blocking = spark.read.schema("file_id long").json(f"{folder}/blocking").agg(F.count("*").alias("n"))
    return of("state").unionByName(of("kind")).unionByName(blocking.select(F.lit("blocking").alias("what"), F.lit("rows").alias("name"), "n"))


@register("session_brief", f"SELECT risk, CASE WHEN NOT suggestion_allowed THEN 0 WHEN risk = 'LOW' THEN 90 WHEN risk = 'MEDIUM' THEN 65 ELSE 35 END AS health, concat_ws(',', CASE WHEN NOT destructive_allowed THEN 'delete' END, CASE WHEN NOT destructive_allowed THEN 'rename' END, CASE WHEN NOT repair_allowed THEN 'repair' END, CASE WHEN NOT suggestion_allowed THEN 'suggest' END) AS forbidden, CASE WHEN NOT suggestion_allowed THEN 'index the project' WHEN gaps > 0 THEN 'resolve blocking gaps' WHEN risk <> 'LOW' THEN 'review warnings' ELSE 'continue' END AS next_action FROM ({GATE}), (SELECT count_if(state IN ('resolver_missing', 'requires_runtime', 'failed_with_reason')) AS gaps FROM ({LEDGER}))")
def session_brief(spark, d):
    return P.brief(_gate(spark, d), D.coverage(D.resolution(files(spark, d))))


@register("recent_events", "SELECT event_id FROM events, (SELECT max(ts) AS now FROM events) WHERE now - ts <= INTERVAL 6 HOUR")
def recent_events(spark, d):
    e = read(spark, d, "events").select("event_id", "ts")
    now = e.agg(F.max("ts").alias("now"))
    return P.recent_events(e.crossJoin(F.broadcast(now)), F.col("now")).select("event_id")


@register("replaced_children", "SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS q FROM lineitem WHERE l_orderkey % 4 <> 0 UNION ALL SELECT l_orderkey, l_linenumber, 0.0::DOUBLE FROM lineitem WHERE l_orderkey % 4 = 0 AND l_linenumber = 1")
def replaced_children(spark, d):
    """Every fourth order was read again, with one line each."""
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"))
    again = li.where("l_orderkey % 4 = 0")
    return P.replace_children(li, again.where("l_linenumber = 1").withColumn("q", F.lit(0.0)), again, "l_orderkey")


@register("meta_upsert", "SELECT n_name AS key, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE 'old' || n_regionkey END AS value FROM nation UNION ALL SELECT r_name || '!', 'new' FROM region")
def meta_upsert(spark, d):
    """Key and value settings: some replaced, some added."""
    n = read(spark, d, "nation")
    old = n.select(F.col("n_name").alias("key"), F.concat(F.lit("old"), F.col("n_regionkey").cast("string")).alias("value"))
    new = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("key"), F.lit("new").alias("value")).unionByName(read(spark, d, "region").select(F.concat("r_name", F.lit("!")).alias("key"), F.lit("new").alias("value")))
    return S.upsert(old, new, "key")


@register("ledger_by_state", f"SELECT file_id, state, path FROM ({LEDGER}) l JOIN (SELECT file_id, path FROM ({FILES})) f USING (file_id)")
def ledger_by_state(spark, d):
    f = files(spark, d)
    return D.resolution(f).select("file_id", "state").join(f.select("file_id", "path"), "file_id").sort("state", "path")


@register("newest_artifacts", "SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def newest_artifacts(spark, d):
    return P.newest(read(spark, d, "events"), "user_id", "event_id", "ts")
