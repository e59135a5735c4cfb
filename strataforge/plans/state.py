"""Queries of activity, increments, chains and dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataforge.functions.decay import age_decay
from strataforge.functions.text import estimate_tokens
from strataforge.operators import state as S
from strataforge.plans.catalogue import register
from strataforge.plans.tabular import read

KINDS = {"view": "open", "click": "pull", "purchase": "edit"}


def _touches(spark, d):
    return S.touches(read(spark, d, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_type").alias("type")), KINDS)


@register("touch_counters", "SELECT user_id AS key, count_if(event_type = 'view')::BIGINT AS opened, count_if(event_type = 'click')::BIGINT AS pulled, count_if(event_type = 'purchase')::BIGINT AS edited FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1")
def touch_counters(spark, d):
    return _touches(spark, d).drop("last")


@register("intent_scores", "WITH t AS (SELECT user_id AS key, count_if(event_type = 'view') AS o, count_if(event_type = 'click') AS p, count_if(event_type = 'purchase') AS e, max(ts) AS last FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1) SELECT key, round(greatest(0, least(1, 0.25::DOUBLE * ln(1 + o) + 0.5::DOUBLE * ln(1 + p) + 0.7::DOUBLE * ln(1 + e) + 0.3::DOUBLE * pow(0.5::DOUBLE, greatest(0, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(last)) / 86400000000.0::DOUBLE) / 14))), 6) AS intent FROM t")
def intent_scores(spark, d):
    now = read(spark, d, "events").agg(F.max("ts").alias("now"))
    x = _touches(spark, d).crossJoin(F.broadcast(now))
    return S.intent_scores(x, F.col("now")).select("key", F.round("intent", 6).alias("intent"))


@register("age_decay_rerank", "WITH n AS (SELECT max(ts) AS now FROM events), a AS (SELECT user_id, (epoch_us(now) - epoch_us(ts)) / 1000000.0::DOUBLE AS age FROM events, n) SELECT user_id, round(sum(CASE WHEN age < 0 OR age > 21600 THEN 0.0::DOUBLE ELSE pow(0.5::DOUBLE, age / 1800) END), 6) AS score FROM a GROUP BY 1 HAVING score > 0")
def age_decay_rerank(spark, d):
    e = read(spark, d, "events").select("user_id", "ts")
    age = (F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1_000_000.0
    x = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now"))))
    return x.groupBy("user_id").agg(F.round(F.sum(age_decay(age, 1800.0, 21600.0)), 6).alias("score")).where("score > 0")


@register("latest_by_type", "SELECT event_type, count(*)::BIGINT AS n, arg_max(value, row(ts, event_id)) AS value, epoch_us(max(ts)) AS ts FROM events GROUP BY 1")
def latest_by_type(spark, d):
    return S.latest_by(read(spark, d, "events"), "event_type", "value").withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))


@register("session_savings", "SELECT role, count(*)::BIGINT AS calls, sum(t)::BIGINT AS tokens, sum(greatest(0, 1800 - t))::BIGINT AS saved FROM (SELECT role, ceil(length(text) / 4)::BIGINT AS t FROM conversations) GROUP BY 1")
def session_savings(spark, d):
    return S.savings(read(spark, d, "conversations").select("role", estimate_tokens(F.col("text")).alias("tokens")), "role")


def _chain(spark, d):
    core = F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props")
    return S.chain(read(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "props"), "user_id", ["ts", "event_id"], core)


CHAIN = """WITH RECURSIVE b AS (SELECT user_id, event_id, event_id || '|' || event_type || '|' || props AS core, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
c AS (SELECT user_id, event_id, i, '' AS prev, sha256(core) AS hash FROM b WHERE i = 1 UNION ALL SELECT b.user_id, b.event_id, b.i, c.hash, sha256(c.hash || b.core) FROM c JOIN b ON b.user_id = c.user_id AND b.i = c.i + 1)"""


@register("hash_chain_build", CHAIN + " SELECT user_id, event_id, prev, hash FROM c")
def hash_chain_build(spark, d):
    return _chain(spark, d).select("user_id", "event_id", "prev", "hash")


@register("hash_chain_verify", "SELECT user_id, count(*)::BIGINT AS rows, CASE WHEN user_id % 10 = 0 AND count(*) >= 3 THEN 3 ELSE 0 END::BIGINT AS first_broken FROM events GROUP BY 1")
def hash_chain_verify(spark, d):
    """Chains of which every tenth user's third row is changed after the fact; 0 stands for an unbroken chain."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    x = _chain(spark, d).withColumn("n", n).withColumn("core", F.when((F.col("user_id") % 10 == 0) & (F.col("n") == 3), F.concat("core", F.lit("!"))).otherwise(F.col("core"))).drop("n")
    return S.verify_chain(x, "user_id", ["ts", "event_id"]).na.fill(0, ["first_broken"])


@register("incremental_diff", "SELECT status, count(*)::BIGINT AS n FROM (SELECT CASE WHEN doc_id % 20 = 1 THEN 'new' WHEN doc_id % 20 = 2 THEN 'removed' WHEN doc_id % 20 = 3 THEN 'changed' ELSE 'same' END AS status FROM documents) GROUP BY 1")
def incremental_diff(spark, d):
    """documents against a copy in which every twentieth is new, gone or changed."""
    x = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    r = F.col("doc_id") % 20
    new = x.where(r != 2).withColumn("hash", F.when(r == 3, F.reverse("hash")).otherwise(F.col("hash")))
    return S.diff(x.where(r != 1), new, "doc_id").groupBy("status").agg(F.count("*").alias("n"))


@register("upsert_latest", "SELECT o_orderstatus, count(*)::BIGINT AS n, floor(sum(CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END) * 1000 + 0.5) / 1000 AS total FROM orders GROUP BY 1")
def upsert_latest(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderkey % 5 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    x = S.upsert(o, new, "o_orderkey").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    return x.select("o_orderstatus", "n", (F.floor(F.col("t") * 1000 + 0.5).cast("double") / 1000).alias("total"))


@register("dictionary_encode", "SELECT event_type, (row_number() OVER (ORDER BY min(event_id)) - 1)::INTEGER AS id, count(*)::BIGINT AS n FROM events GROUP BY 1")
def dictionary_encode(spark, d):
    return S.dictionary(read(spark, d, "events"), "event_type", "event_id")


@register("encoded_rows", "WITH k AS (SELECT event_type, (row_number() OVER (ORDER BY min(event_id)) - 1) AS id FROM events GROUP BY 1) SELECT event_id, concat_ws(chr(9), event_id, user_id, k.id) AS row FROM events JOIN k USING (event_type)")
def encoded_rows(spark, d):
    x = S.encoded(read(spark, d, "events").select("event_id", "user_id", "event_type"), ["event_type"], "event_id")
    return x.select("event_id", F.concat_ws("\t", "event_id", "user_id", "event_type_id").alias("row"))


@register("stale_rows", "SELECT count(*)::BIGINT AS stale FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def stale_rows(spark, d):
    o = read(spark, d, "orders").select("o_orderkey")
    return S.stale(o, read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey").agg(F.count("*").alias("stale"))


@register("benchmark_totals", "SELECT sum(octet_length(encode(html)))::BIGINT AS baseline, sum(length(url))::BIGINT AS payload, round(100.0::DOUBLE * (baseline - payload) / baseline, 6) AS reduction FROM pages")
def benchmark_totals(spark, d):
    x = read(spark, d, "pages").agg(F.sum(F.octet_length("html")).alias("baseline"), F.sum(F.length("url")).alias("payload"))
    return x.withColumn("reduction", F.round(100.0 * (F.col("baseline") - F.col("payload")) / F.col("baseline"), 6))
