"""Queries of sources, parsing and streams, each over a table written out in the source's form."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strataforge.lineage import cut
from strataforge.operators import parsing as P
from strataforge.sources import files as S
from strataforge.streaming import streams
from strataforge.plans.catalogue import register
from strataforge.plans.tabular import read


def _scratch(spark, label: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        cut(spark.range(1))  # sets a folder for local sessions
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@register("csv_roundtrip", "SELECT c_custkey::VARCHAR AS c_custkey, 'say \"' || c_name || '\", ' || chr(10) || c_mktsegment AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_nationkey::VARCHAR END AS nation FROM customer")
def csv_roundtrip(spark, d):
    path = _scratch(spark, "csv")
    quoted = F.concat(F.lit('say "'), F.col("c_name"), F.lit('", \n'), F.col("c_mktsegment"))
    x = read(spark, d, "customer").select(F.col("c_custkey").cast("string"), quoted.alias("name"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_nationkey").cast("string")).alias("nation"))
    x.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return S.load_csv(spark, path)


@register("jsonl_recent", "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def jsonl_recent(spark, d):
    path = _scratch(spark, "jsonl")
    S.append_jsonl(read(spark, d, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.format_string("#%012d", "event_id")).alias("ts"), "user_id", "event_type"), path)
    return S.recent(S.read_jsonl(spark, path, "event_id long, ts string, user_id long, event_type string")).select("event_id", "user_id", "event_type")


MD = "SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i, len(l) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"


@register("markdown_sections", f"WITH h AS (SELECT doc_id, i, n, CASE WHEN length(line) < 25 THEN 1 ELSE 2 END AS level FROM ({MD}) WHERE length(line) < 60 AND regexp_matches(line, '^[^ \\t#`~]')), x AS (SELECT a.doc_id, a.i, a.level, coalesce(min(b.i) - 1, a.n) AS last FROM h a LEFT JOIN h b ON a.doc_id = b.doc_id AND b.i > a.i AND b.level <= a.level GROUP BY a.doc_id, a.i, a.level, a.n) SELECT doc_id AS file, i::INTEGER AS line, level::INTEGER AS level, last::INTEGER AS last FROM x")
def markdown_sections(spark, d):
    """Documents whose short lines are made headings: shorter than 25 characters level 1, than 60 level 2."""
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.when((F.length(x) < 60) & x.rlike(r"^[^ \t#`~]"), F.concat(F.when(F.length(x) < 25, "# ").otherwise("## "), x)).otherwise(F.regexp_replace(x, "^#", "")))
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("file"), F.array_join(lines, "\n").alias("text"))
    return S.sections(docs).select("file", "line", "level", "last")


@register("parse_sources", "WITH s AS (SELECT p_partkey AS k, replace(p_name, ' ', '_') || '_' || p_partkey AS name FROM part) SELECT 'f' || k || '.py' AS path, 'symbol' AS what, name, 'function' AS kind, 3 AS line, NULL::VARCHAR AS owner FROM s UNION ALL SELECT 'f' || k || '.py', 'import', 'base.m' || k % 10, 'import', 1, NULL FROM s UNION ALL SELECT 'f' || k || '.py', 'call', 'next_' || k, 'call', 4, name FROM s")
def parse_sources(spark, d):
    """One Python file for each part."""
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("import base.m"), (F.col("p_partkey") % 10).cast("string"), F.lit("\n\ndef "), F.translate("p_name", " ", "_"), F.lit("_"), k, F.lit("(x):\n    return next_"), k, F.lit("(x)\n"))
    files = read(spark, d, "part").select(F.concat(F.lit("f"), k, F.lit(".py")).alias("path"), text.alias("text"))
    return P.parse_files(files).select("path", "what", "name", "kind", "line", "owner")


@register("resolve_specifiers", "SELECT 'src/f' || p_partkey || '.ts' AS path, './f' || (p_partkey + 1) AS spec, CASE WHEN p_partkey + 1 IN (SELECT p_partkey FROM part) THEN 'src/f' || (p_partkey + 1) || '.ts' END AS target FROM part")
def resolve_specifiers(spark, d):
    p = read(spark, d, "part").select("p_partkey")
    path = F.concat(F.lit("src/f"), F.col("p_partkey").cast("string"), F.lit(".ts"))
    imports = p.select(path.alias("path"), F.concat(F.lit("./f"), (F.col("p_partkey") + 1).cast("string")).alias("spec"))
    return P.resolve_specifiers(imports, p.select(path.alias("path")))


@register("call_owners", "SELECT user_id::VARCHAR AS path, event_id AS line, 'click' AS name, last_value(CASE WHEN event_type = 'view' THEN 'v' || event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS owner FROM events QUALIFY event_type = 'click'")
def call_owners(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("line"), "event_type")
    return P.owners(e.where("event_type = 'click'").select("path", "line", F.lit("click").alias("name")), e.where("event_type = 'view'").select("path", "line", F.concat(F.lit("v"), F.col("line").cast("string")).alias("name")))


def _stream(spark, d):
    """events as a stream: a copy in the shared folder, in several files of the schema that streams read."""
    folder = _scratch(spark, "events")
    read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).repartition(4).write.parquet(folder)
    return streams.events(spark, folder, "*.parquet", per_batch=2)


KINDS = {"view": "open", "click": "pull", "purchase": "edit"}


@register("stream_touch_counts", "SELECT user_id AS key, count_if(event_type = 'view')::BIGINT AS opened, count_if(event_type = 'click')::BIGINT AS pulled, count_if(event_type = 'purchase')::BIGINT AS edited FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1")
def stream_touch_counts(spark, d):
    """Two batches of files through running state; the last state of each key stands."""
    out = _scratch(spark, "touch")
    streams.run(streams.touch_counts(_stream(spark, d), KINDS), _scratch(spark, "ckpt"), lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{out}/b={i}"), "update")
    x = spark.read.option("recursiveFileLookup", True).parquet(out)
    return x.groupBy("key").agg(*(F.max_by(c, "batch").alias(c) for c in ("opened", "pulled", "edited")))


@register("stream_windows", "SELECT epoch_us(date_trunc('hour', ts)) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark, d):
    """Tumbling windows in batch form, as the stream computes them. (An addition of this engine.)"""
    x = streams.tumbling(read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return x.select(F.unix_micros("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@register("session_windows", "WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts, s DESC ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT user_id, epoch_us(min(ts)) AS start, count(*)::BIGINT AS n FROM b GROUP BY user_id, k")
def session_windows(spark, d):
    return streams.sessions(read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("start", F.unix_micros("start"))


@register("rollup_orders", "SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_orders(spark, d):
    """(An addition of this engine.)"""
    return read(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
