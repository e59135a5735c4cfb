"""Queries of slices, summaries and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataforge.operators import reports as R
from strataforge.plans.catalogue import register
from strataforge.plans.decisions import FILES, files
from strataforge.plans.tabular import read


@register("line_slice", "SELECT doc_id::VARCHAR AS path, substr(array_to_string(string_split(text, chr(10))[2:4], chr(10)), 1, 4000) AS text FROM documents")
def line_slice(spark, d):
    return R.line_slice(read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"), 2, 4)


@register("stale_files", "SELECT o_orderkey::VARCHAR AS path, l < o_orderdate IS NOT TRUE AND (l IS NULL OR epoch_us(l) - epoch_us(o_orderdate) > 1000000) AS stale FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS l FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def stale_files(spark, d):
    ship = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("modified"))
    x = read(spark, d, "orders").join(ship, "o_orderkey", "left")
    return R.stale(x.select(F.col("o_orderkey").cast("string").alias("path"), "modified", F.col("o_orderdate").alias("indexed_at")))


@register("blocking_diagnostics", "SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'PARSE_FAILURE|error|bad|hint=' ELSE 'NOTE|info|fine|hint=' END AS reason FROM labels WHERE toxic = 1 ORDER BY 1 LIMIT 15")
def blocking_diagnostics(spark, d):
    return R.blocking(read(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "PARSE_FAILURE|error|bad|hint=").otherwise("NOTE|info|fine|hint=").alias("reason")))


@register("safe_files", f"SELECT path, file_id FROM ({FILES}) WHERE parser_mode = 'tree-sitter' AND parse_quality >= 0.9 ORDER BY file_id DESC, path LIMIT 10")
def safe_files(spark, d):
    return R.safe_files(files(spark, d).withColumn("indexed_at", F.col("file_id"))).select("path", "file_id")


@register("code_groups", "SELECT event_type AS code, count(*)::BIGINT AS n, min(event_id) AS first, array_to_string(list_sort(list(event_id))[1:3], ',') AS examples FROM events GROUP BY 1")
def code_groups(spark, d):
    return R.code_groups(read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("code")))


@register("git_context", "SELECT 'u' || user_id AS author, count(*)::BIGINT AS commits FROM events WHERE epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts) <= 30 * 86400000000 GROUP BY 1 ORDER BY commits DESC, author LIMIT 5")
def git_context(spark, d):
    e = read(spark, d, "events")
    x = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("author"), "ts").crossJoin(F.broadcast(e.agg(F.max("ts").alias("now"))))
    return R.git_context(x, F.col("now"))


@register("output_budget", "SELECT doc_id AS id, ceil(length(text) / 4)::BIGINT AS tokens, ceil(length(text) / 4) > 600 AS spilled, CASE WHEN ceil(length(text) / 4) > 600 THEN substr(text, 1, 200) ELSE text END AS shown FROM documents")
def output_budget(spark, d):
    return R.output_budget(read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), 600)


@register("path_mentions", "SELECT page_id AS id, count(*)::BIGINT AS n FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(url || ' ' || 'see src/a' || page_id || '.ts', '(?:^|[\\s(`''\"])((?:\\.{0,2}/)?[\\w.-]+(?:/[\\w.-]+)+\\.\\w+)', 1)) AS path FROM pages) GROUP BY 1")
def path_mentions(spark, d):
    x = read(spark, d, "pages").select(F.col("page_id").alias("id"), F.concat("url", F.lit(" see src/a"), F.col("page_id").cast("string"), F.lit(".ts")).alias("text"))
    return R.mentions(x).groupBy("id").agg(F.count("*").alias("n"))


@register("audit_config", "WITH c AS (SELECT doc_id, doc_id || CASE WHEN doc_id % 2 = 0 THEN '.json' ELSE '.md' END AS path, text FROM documents), f AS (SELECT path, 'invalid_json' AS category, 'high' AS severity FROM c WHERE ends_with(path, '.json') UNION ALL SELECT path, 'missing_policy', 'medium' FROM c WHERE NOT regexp_matches(lower(text), 'policy|must not|never') UNION ALL SELECT path, 'token_waste', CASE WHEN ceil(length(text) / 4) > 8000 THEN 'high' ELSE 'medium' END FROM c WHERE ceil(length(text) / 4) > 4000) SELECT category, severity, count(*)::BIGINT AS n FROM f GROUP BY ALL")
def audit_config(spark, d):
    x = read(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".json").otherwise(".md")).alias("path"), "text")
    return R.audit_config(x, ["search"]).groupBy("category", "severity").agg(F.count("*").alias("n"))


@register("languages", f"SELECT CASE ext WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.js' THEN 'javascript' ELSE 'unknown' END AS language, count(*)::BIGINT AS n FROM (SELECT lower(regexp_extract(path, '[^/](\\.[^./]*)$', 1)) AS ext FROM ({FILES})) GROUP BY 1")
def languages(spark, d):
    return files(spark, d).groupBy(R.language(F.col("path")).alias("language")).agg(F.count("*").alias("n"))


@register("signal_share", "SELECT doc_id, floor(1000.0::DOUBLE * ((coalesce(quality = 1, false))::INT + (coalesce(toxic = 0, false))::INT + (n_chars > 1000)::INT + (lang = 'en')::INT + (source = 'src0')::INT) / 5 + 0.5) / 10 AS confidence FROM documents LEFT JOIN labels USING (doc_id)")
def signal_share(spark, d):
    x = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    return x.select("doc_id", R.signal_share([F.col("quality") == 1, F.col("toxic") == 0, F.col("n_chars") > 1000, F.col("lang") == "en", F.col("source") == "src0"]).alias("confidence"))


@register("human_numbers", "SELECT o_orderkey, CASE WHEN p >= 1000000 THEN printf('%.1f', floor(p / 1000000.0::DOUBLE * 10 + 0.5) / 10) || 'M' WHEN p >= 1000 THEN printf('%.1f', floor(p / 1000.0::DOUBLE * 10 + 0.5) / 10) || 'k' ELSE p::VARCHAR END AS price FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS p FROM orders)")
def human_numbers(spark, d):
    return read(spark, d, "orders").select("o_orderkey", R.human(F.floor("o_totalprice")).alias("price"))


@register("path_sandbox", "SELECT path, starts_with(path, '/data/') AND NOT contains(path, '..') AS safe FROM (SELECT CASE page_id % 3 WHEN 0 THEN '/data/p' || page_id WHEN 1 THEN '/data/../etc/' || page_id ELSE '/etc/' || page_id END AS path FROM pages)")
def path_sandbox(spark, d):
    k, n = F.col("page_id") % 3, F.col("page_id").cast("string")
    path = F.when(k == 0, F.concat(F.lit("/data/p"), n)).when(k == 1, F.concat(F.lit("/data/../etc/"), n)).otherwise(F.concat(F.lit("/etc/"), n))
    return read(spark, d, "pages").select(path.alias("path")).withColumn("safe", R.safe_path(F.col("path"), ["/data"]))


@register("memory_summary", "SELECT event_type AS type, count(*)::BIGINT AS n, arg_max(props, row(ts, event_id)) AS last FROM events GROUP BY 1")
def memory_summary(spark, d):
    return R.memory_summary(read(spark, d, "events").select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("type"), F.col("props").alias("summary")))


@register("json_fields", "SELECT event_type, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY 1")
def json_fields(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))
