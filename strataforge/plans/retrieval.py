"""Queries of ranked retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataforge.functions.text import estimate_tokens
from strataforge.operators import retrieval as R
from strataforge.plans.catalogue import register
from strataforge.plans.tabular import read
from strataforge.plans.text import _tokens_sql

TERMS = ["the", "und", "con"]
_T = _tokens_sql("text")
BM25 = f"""WITH t AS (SELECT doc_id AS id, len(x) AS len, {', '.join(f"len(list_filter(x, lambda w: w = '{w}')) AS tf{i}" for i, w in enumerate(TERMS))} FROM (SELECT doc_id, {_T} AS x FROM documents)),
s AS (SELECT count(*) AS n, avg(len) AS avgdl, {', '.join(f'count_if(tf{i} > 0) AS df{i}' for i in range(3))} FROM t)
SELECT id, {' + '.join(f'ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.5::DOUBLE / (tf{i} + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl))' for i in range(3))} AS score FROM t, s WHERE greatest(tf0, tf1, tf2) > 0"""
TOP_BM25 = f"SELECT id, round(score, 6) AS score FROM ({BM25}) ORDER BY score DESC, id LIMIT 50"


def _bm25(spark, d):
    return R.bm25(read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), TERMS).select("id", F.round("score", 6).alias("score"))


@register("bm25_documents", TOP_BM25)
def bm25_documents(spark, d):
    return _bm25(spark, d).orderBy(F.desc("score"), "id").limit(50)


@register("bm25_all", f"SELECT id, round(score, 6) AS score FROM ({BM25})")
def bm25_all(spark, d):
    return _bm25(spark, d)


IDENTITY = "SELECT id, name, tier, price FROM (SELECT p_partkey AS id, p_name AS name, p_retailprice AS price, CASE WHEN p_name = 'red widget' THEN 0 WHEN lower(p_name) = 'red widget' THEN 1 WHEN starts_with(lower(p_name), 'red widget') THEN 2 WHEN contains(lower(p_name), 'red widget') THEN 3 END AS tier FROM part) WHERE tier IS NOT NULL"


def _identity(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))
    return R.identity_tiers(p, "red widget")


@register("identity_tiers", f"SELECT id, name, tier, (row_number() OVER (ORDER BY tier, price DESC, id) - 1)::INTEGER AS rank0 FROM ({IDENTITY}) ORDER BY tier, price DESC, id LIMIT 50")
def identity_tiers(spark, d):
    return R.ranked(_identity(spark, d), F.col("tier"), F.desc("price")).select("id", "name", "tier", "rank0")


COS = "WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT v AS q FROM e WHERE id = 0) SELECT id, list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * q[i])) / (sqrt(list_sum(list_transform(v, lambda x: x * x))) * sqrt(list_sum(list_transform(q, lambda x: x * x)))) AS score FROM e, q WHERE id <> 0"


def _similar(spark, d, least=-1.0):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return R.similar(e.where("id <> 0"), e.where("id = 0"), least)


@register("cosine_topk", f"SELECT id, round(score, 6) AS score FROM ({COS}) ORDER BY score DESC, id LIMIT 20")
def cosine_topk(spark, d):
    return _similar(spark, d).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)


@register("cosine_min_score", f"SELECT id, round(score, 6) AS score FROM ({COS}) WHERE score >= 0.3")
def cosine_min_score(spark, d):
    return _similar(spark, d, 0.3).select("id", F.round("score", 6).alias("score"))


def _channels(spark, d):
    lexical = R.ranked(_bm25(spark, d), F.desc("score"))
    similar = R.ranked(_similar(spark, d).select("id", F.round("score", 6).alias("score")), F.desc("score"))
    structural = R.ranked(read(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars"), F.desc("n_chars"))
    return {"lexical": lexical, "similarity": similar, "structural": structural}


CHANNELS = f"""lex AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM ({TOP_BM25})),
sim AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM (SELECT id, round(score, 6) AS score FROM ({COS}) ORDER BY score DESC, id LIMIT 50)),
str AS (SELECT id, row_number() OVER (ORDER BY n DESC, id) - 1 AS r FROM (SELECT doc_id AS id, n_chars AS n FROM documents ORDER BY n DESC, id LIMIT 50)),
fused AS (SELECT id, sum(s) AS score FROM (SELECT id, 1.0::DOUBLE / (60 + r) AS s FROM lex UNION ALL SELECT id, 0.8::DOUBLE / (60 + r) FROM sim UNION ALL SELECT id, 0.4::DOUBLE / (60 + r) FROM str) GROUP BY 1)"""


@register("wrr_fusion", f"WITH {CHANNELS} SELECT id, round(score, 6) AS score FROM fused")
def wrr_fusion(spark, d):
    return R.fuse(_channels(spark, d)).select("id", F.round("score", 6).alias("score"))


@register("confidence", f"WITH {CHANNELS}, t AS (SELECT score, row_number() OVER (ORDER BY score DESC, id) AS p FROM fused), x AS (SELECT max(score) FILTER (p = 1) AS a, coalesce(max(score) FILTER (p = 2), 0) AS b FROM t) SELECT floor(greatest(0, least(1, (a - b) / a)) * (1 - exp(-a / 0.05::DOUBLE)) * 0.7::DOUBLE * 1000 + 0.5) / 1000 AS confidence FROM x")
def confidence(spark, d):
    return R.confidence(R.fuse(_channels(spark, d)), identity="partial")


SIGNALS = "SELECT doc_id AS id, (doc_id % 90) * 300.0::DOUBLE AS age, (quality + toxic) AS overlap, toxic = 1 AS runtime FROM labels"


@register("search_pipeline", f"""WITH {CHANNELS}, sig AS ({SIGNALS}), top AS (SELECT max(score) AS top FROM fused),
b AS (SELECT f.id, f.score, top, coalesce(0.20::DOUBLE * CASE WHEN age < 0 OR age > 21600 THEN 0.0::DOUBLE ELSE pow(0.5::DOUBLE, age / 1800) END, 0) + 0.05::DOUBLE * least(coalesce(overlap, 0), 3) - CASE WHEN runtime THEN top * 0.25::DOUBLE ELSE 0.0::DOUBLE END AS boost FROM fused f LEFT JOIN sig USING (id), top)
SELECT id, round(score + greatest(-0.35::DOUBLE * top, least(0.35::DOUBLE * top, boost)), 6) AS score FROM b ORDER BY score DESC, id LIMIT 50""")
def search_pipeline(spark, d):
    """Channels, fusion, session rerank, first fifty."""
    labels = read(spark, d, "labels")
    none = F.lit(None)
    signals = labels.select(F.col("doc_id").alias("id"), ((F.col("doc_id") % 90) * 300.0).alias("symbol_age"), none.cast("double").alias("file_age"), (F.col("quality") + F.col("toxic")).alias("overlap"), none.cast("double").alias("intent"), none.cast("boolean").alias("kind_match"), (F.col("toxic") == 1).alias("runtime"))
    out = R.rerank(R.fuse(_channels(spark, d)), signals).select("id", F.round("score", 6).alias("score"))
    return out.orderBy(F.desc("score"), "id").limit(50)


def _cards(spark, d):
    return read(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_partkey").alias("name"), F.concat_ws(" ", "p_type", "p_brand").alias("description"))


CARDS = "SELECT p_name || ' ' || p_partkey AS name, p_type || ' ' || p_brand AS description FROM part"
OWN = "list_distinct(list_filter(string_split_regex(lower(name || ' ' || description), '[^a-z0-9]+'), lambda x: length(x) >= 2))"


@register("inverted_index", f"SELECT token, count(*)::BIGINT AS n, min(name) AS first, max(name) AS last FROM (SELECT name, unnest({OWN}) AS token FROM ({CARDS})) GROUP BY 1")
def inverted_index(spark, d):
    return R.inverted_index(_cards(spark, d).withColumnRenamed("description", "text"))


@register("skill_postings", f"SELECT DISTINCT token, name FROM (SELECT name, unnest({OWN}) AS token FROM ({CARDS}))")
def skill_postings(spark, d):
    return R.postings(_cards(spark, d).withColumnRenamed("description", "text"))


_WANTED = ("economy", "idg", "red")
@register("postings_lookup", "SELECT name, score, matched FROM (SELECT name, " + " + ".join(f"CASE WHEN list_contains(own, '{t}') THEN 2.0::DOUBLE WHEN contains(lower(name), '{t}') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" for t in _WANTED) + " AS score, concat_ws(',', " + ", ".join(f"CASE WHEN list_contains(own, '{t}') OR contains(lower(name), '{t}') THEN '{t}' END" for t in _WANTED) + f") AS matched FROM (SELECT *, {OWN} AS own FROM ({CARDS}))) ORDER BY score DESC, name LIMIT 5")
def postings_lookup(spark, d):
    cards = _cards(spark, d)
    return R.postings_lookup(R.postings(cards.withColumnRenamed("description", "text")), cards.select("name"), "red idg ECONOMY").withColumn("matched", F.array_join("matched", ","))


FNV = "((list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(token, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: ((xor(a, c) * 16777619::BIGINT) & 4294967295)) % 384)::INTEGER)"


def _vectors_sql(source: str) -> str:
    """id, idx, value of hashed token vectors of a source (id, text)."""
    return f"SELECT id, idx, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS value FROM (SELECT id, idx, count(*) / sqrt(n) AS v FROM (SELECT id, len(t) AS n, unnest(t) AS token FROM (SELECT id, list_filter(string_split_regex(lower(text), '[^a-z0-9_$]+'), lambda x: x <> '') AS t FROM ({source}))) JOIN (SELECT token, {FNV} AS idx FROM (SELECT DISTINCT unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9_$]+'), lambda x: x <> '')) AS token FROM ({source}))) USING (token) GROUP BY id, n, idx)"


SYMBOL_TERMS = ["red", "widget"]
SYMBOLS = "SELECT p_partkey AS id, p_name AS name, 'src/' || p_type || '/' || p_brand AS path, p_type AS kind, p_retailprice::DOUBLE AS importance FROM part"
SYMBOL_TEXT = "SELECT id, concat_ws(' ', name, regexp_extract(path, '[^/]*$'), kind) AS text FROM sym"
SEARCH = f"""WITH sym AS ({SYMBOLS}), ident AS (SELECT id, row_number() OVER (ORDER BY tier, importance DESC, id) - 1 AS r FROM (SELECT id, importance, CASE WHEN name = 'red widget' THEN 0 WHEN lower(name) = 'red widget' THEN 1 WHEN starts_with(lower(name), 'red widget') THEN 2 WHEN contains(lower(name), 'red widget') THEN 3 END AS tier FROM sym) WHERE tier IS NOT NULL),
txt AS ({SYMBOL_TEXT}), tok AS (SELECT id, {_tokens_sql('text')} AS x FROM txt), tf AS (SELECT id, len(x) AS len, {', '.join(f"len(list_filter(x, lambda w: w = '{w}')) AS tf{i}" for i, w in enumerate(SYMBOL_TERMS))} FROM tok),
tot AS (SELECT count(*) AS n, avg(len) AS avgdl, {', '.join(f'count_if(tf{i} > 0) AS df{i}' for i in range(2))} FROM tf),
lex AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM (SELECT id, round({' + '.join(f'ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.5::DOUBLE / (tf{i} + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl))' for i in range(2))}, 9) AS score FROM tf, tot WHERE tf0 > 0 OR tf1 > 0)),
vec AS ({_vectors_sql('SELECT * FROM txt')}), q AS ({_vectors_sql("SELECT 0 AS id, 'red widget' AS text")}),
sim AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM (SELECT vec.id, round(sum(vec.value * q.value), 9) AS score FROM vec JOIN q ON vec.idx = q.idx GROUP BY 1) WHERE score >= 0.3),
pool AS (SELECT id FROM ident UNION SELECT id FROM lex UNION SELECT id FROM sim), str AS (SELECT id, row_number() OVER (ORDER BY importance DESC, id) - 1 AS r FROM sym WHERE id IN (SELECT id FROM pool))
SELECT id, round(sum(s), 9) AS score FROM (SELECT id, 2.0::DOUBLE / (60 + r) AS s FROM ident UNION ALL SELECT id, 1.0::DOUBLE / (60 + r) FROM lex UNION ALL SELECT id, 0.8::DOUBLE / (60 + r) FROM sim UNION ALL SELECT id, 0.4::DOUBLE / (60 + r) FROM str) GROUP BY 1 ORDER BY sum(s) DESC, id LIMIT 50"""


@register("search_symbols", SEARCH)
def search_symbols(spark, d):
    """Parts as symbols: their types are kinds, their brands files, their prices importance."""
    p = read(spark, d, "part")
    symbols = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws("/", F.lit("src"), "p_type", "p_brand").alias("path"), F.col("p_type").alias("kind"), F.col("p_retailprice").cast("double").alias("importance"))
    return R.search_symbols(symbols, "red widget").select("id", F.round("score", 9).alias("score"))


@register("skill_search", f"SELECT name, {' + '.join(f'''CASE WHEN list_contains(own, '{t}') THEN 2.0::DOUBLE WHEN contains(lower(name), '{t}') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END''' for t in ('economy', 'idg', 'red'))} AS score, description FROM (SELECT *, {OWN} AS own FROM ({CARDS})) ORDER BY score DESC, name LIMIT 5")
def skill_search(spark, d):
    return R.skill_search(_cards(spark, d), "red idg ECONOMY")


@register("greedy_pack")
def greedy_pack(spark, d):
    return R.skill_pack(_cards(spark, d), "economy red widget brand 17 small ring")


def _blocks(spark, d):
    return read(spark, d, "conversations").select("conv_id", F.col("turn").alias("rank"), estimate_tokens(F.col("text")).alias("tokens"))


BLOCKS = "SELECT conv_id, turn AS rank, ceil(length(text) / 4)::BIGINT AS tokens FROM conversations"


@register("budget_prefix", f"SELECT conv_id, rank, running FROM (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY rank)::BIGINT AS running FROM ({BLOCKS})) WHERE running <= 400")
def budget_prefix(spark, d):
    return R.pack_prefix(_blocks(spark, d), "conv_id", 400).select("conv_id", "rank", "running")


@register("budget_skip", f"""WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY rank, tokens) AS i FROM ({BLOCKS})),
f AS (SELECT conv_id, i, rank, CASE WHEN tokens <= 400 THEN tokens ELSE 0 END AS used, tokens <= 400 AS kept FROM b WHERE i = 1
UNION ALL SELECT b.conv_id, b.i, b.rank, CASE WHEN f.used + b.tokens <= 400 THEN f.used + b.tokens ELSE f.used END, f.used + b.tokens <= 400 FROM f JOIN b ON b.conv_id = f.conv_id AND b.i = f.i + 1)
SELECT conv_id, rank FROM f WHERE kept""")
def budget_skip(spark, d):
    return R.pack_skipping(_blocks(spark, d), "conv_id", 400)


@register("hash_embedding", """WITH t AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '[^a-z0-9_$]+'), lambda x: x <> '') AS t FROM documents),
e AS (SELECT id, len(t) AS n, unnest(t) AS token FROM t WHERE len(t) > 0),
h AS (SELECT token, (list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(token, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: ((xor(a, c) * 16777619::BIGINT) & 4294967295)) % 384)::INTEGER AS idx FROM (SELECT DISTINCT token FROM e)),
c AS (SELECT id, idx, count(*) / sqrt(n) AS v FROM e JOIN h USING (token) GROUP BY id, n, idx)
SELECT id, idx, round(v / sqrt(sum(v * v) OVER (PARTITION BY id)), 6) AS value FROM c""")
def hash_embedding(spark, d):
    return R.hash_embedding(read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")).select("id", "idx", F.round("value", 6).alias("value"))
