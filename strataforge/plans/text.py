"""Queries of text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataforge.functions import text as X
from strataforge.functions.numbers import half_up
from strataforge.plans.catalogue import register
from strataforge.plans.tabular import read


def _tokens_sql(c: str) -> str:
    return f"list_filter(string_split_regex(lower(regexp_replace(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: x <> '')"


@register("tokenize_identifiers", f"SELECT token, count(*)::BIGINT AS n FROM (SELECT unnest({_tokens_sql('concat(p_name, p_type, p_brand)')}) AS token FROM part) GROUP BY 1")
def tokenize_identifiers(spark, d):
    return read(spark, d, "part").select(F.explode(X.identifier_tokens(F.concat("p_name", "p_type", "p_brand"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@register("slugify", "SELECT p_partkey, substr(regexp_replace(regexp_replace(trim(lower(p_name || ' / ' || p_type)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS slug FROM part")
def slugify(spark, d):
    return read(spark, d, "part").select("p_partkey", X.slug(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"))


_REDACTED = "text"
for _p in X.SECRETS:
    _REDACTED = f"regexp_replace({_REDACTED}, '{_p}', '{X.MARK}', 'g')"


@register("redact", f"SELECT doc_id, ((length(r) - length(replace(r, '{X.MARK}', ''))) / {len(X.MARK)})::BIGINT AS marks, sha256(r) AS sha FROM (SELECT doc_id, {_REDACTED} AS r FROM documents)")
def redact(spark, d):
    x = read(spark, d, "documents").select("doc_id", X.redact(F.col("text")).alias("r"))
    return x.select("doc_id", (F.size(F.split("r", r"\[REDACTED_SECRET\]", -1)) - 1).cast("long").alias("marks"), F.sha2("r", 256).alias("sha"))


@register("sha256_fingerprint", "SELECT source, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS fingerprint FROM documents GROUP BY 1")
def sha256_fingerprint(spark, d):
    """A source's fingerprint: the hash of its documents' hashes by id. Hashes only are gathered, 64 bytes a document."""
    x = read(spark, d, "documents").select("source", F.struct("doc_id", F.sha2("text", 256).alias("h")).alias("x"))
    return x.groupBy("source").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda y: y.h), ""), 256).alias("fingerprint"))


@register("line_explode", "SELECT doc_id, count(*)::BIGINT AS lines, sum(length(line))::BIGINT AS chars, max(length(line))::BIGINT AS longest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1")
def line_explode(spark, d):
    lens = F.transform(F.split("text", "\n", -1), F.length)
    x = read(spark, d, "documents").select("doc_id", lens.alias("n"))
    return x.select("doc_id", F.size("n").cast("long").alias("lines"), F.aggregate("n", F.lit(0).cast("long"), lambda a, b: a + b).alias("chars"), F.array_max("n").cast("long").alias("longest"))


@register("minified_flags", "SELECT doc_id, longest, n_lines, n_lines = 1 OR longest > 5000 OR bytes / greatest(1, n_lines - 1) > 2000 AS minified FROM (SELECT doc_id, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x)))::BIGINT AS longest, len(string_split(text, chr(10)))::BIGINT AS n_lines, octet_length(encode(text)) AS bytes FROM documents)")
def minified_flags(spark, d):
    x = read(spark, d, "documents").select("doc_id", F.array_max(F.transform(F.split("text", "\n", -1), F.length)).cast("long").alias("longest"), F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), F.octet_length("text").alias("bytes"))
    return x.select("doc_id", "longest", "n_lines", ((F.col("n_lines") == 1) | (F.col("longest") > 5000) | (F.col("bytes") / F.greatest(F.lit(1), F.col("n_lines") - 1) > 2000)).alias("minified"))


@register("html_headings", "SELECT page_id, count(*)::BIGINT AS n, min(title) AS first FROM (SELECT page_id, unnest(regexp_extract_all(html, '<h1[^>]*>([^<]*)</h1>', 1)) AS title FROM pages) GROUP BY 1")
def html_headings(spark, d):
    x = read(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<h1[^>]*>([^<]*)</h1>"), F.lit(1))).alias("title"))
    return x.groupBy("page_id").agg(F.count("*").alias("n"), F.min("title").alias("first"))


@register("token_estimates", "SELECT role, sum(ceil(length(text) / 4))::BIGINT AS tokens, floor(avg(ceil(length(text) / 4)) * 1000 + 0.5) / 1000 AS mean FROM conversations GROUP BY 1")
def token_estimates(spark, d):
    t = X.estimate_tokens(F.col("text"))
    return read(spark, d, "conversations").groupBy("role").agg(F.sum(t).alias("tokens"), half_up(F.avg(t)).alias("mean"))


@register("split_reason", "SELECT code, severity, message, hint, count(*)::BIGINT AS n FROM (SELECT CASE WHEN toxic = 1 THEN 'DYNAMIC_IMPORT' WHEN quality = 0 THEN 'UNKNOWN_BLINDSPOT' ELSE 'skipped:minified' END AS code, CASE WHEN toxic = 1 THEN 'error' WHEN quality = 0 THEN 'warn' ELSE 'info' END AS severity, CASE WHEN toxic = 1 THEN 'seen' WHEN quality = 0 THEN 'odd' ELSE 'skipped:minified 12 bytes' END AS message, CASE WHEN toxic = 1 THEN 'a|b' WHEN quality = 0 THEN 'inspect manually' ELSE 'classified artifact' END AS hint FROM labels) GROUP BY ALL")
def split_reasons(spark, d):
    raw = F.when(F.col("toxic") == 1, "DYNAMIC_IMPORT|error|seen|hint=a|b").when(F.col("quality") == 0, "odd").otherwise("skipped:minified 12 bytes")
    return read(spark, d, "labels").select(X.split_reason(raw).alias("r")).groupBy("r.code", "r.severity", "r.message", "r.hint").agg(F.count("*").alias("n"))
