"""Queries of the table tools."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataforge.operators import tabular as T
from strataforge.plans.catalogue import register


def read(spark, d: str, name: str):
    return spark.read.parquet(f"{d}/{name}.parquet")


_SQL_OP = {"count": "count(*)::DOUBLE", **{op: f"floor({op}(l_extendedprice::DOUBLE) * 1000 + 0.5) / 1000" for op in ("sum", "avg", "min", "max")}}
for _op in T.OPS:
    register(f"agg_{_op}", f"SELECT l_returnflag, {_SQL_OP[_op]} AS {_op}_l_extendedprice FROM lineitem GROUP BY 1")(lambda s, d, op=_op: T.aggregate(read(s, d, "lineitem"), "l_returnflag", "l_extendedprice", op))


@register("agg_avg_orders_priority", "SELECT o_orderpriority, floor(avg(o_totalprice::DOUBLE) * 1000 + 0.5) / 1000 AS avg_o_totalprice FROM orders GROUP BY 1")
def agg_avg_orders_priority(spark, d):
    return T.aggregate(read(spark, d, "orders"), "o_orderpriority", "o_totalprice", "avg")


def _profile_sql(source: str, columns: dict[str, str]) -> str:
    rows = []
    for c, kind in columns.items():
        null = f"{c} IS NULL" + (f" OR {c} = ''" if kind == "string" else "")
        nums = f"min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, floor(avg({c}::DOUBLE) * 1000 + 0.5) / 1000 AS mean" if kind == "number" else "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean"
        rows.append(f"SELECT '{c}' AS name, '{kind}' AS type, count_if({null})::BIGINT AS nulls, count(DISTINCT {c})::BIGINT AS \"distinct\", {nums} FROM src")
    return f"WITH src AS ({source}) " + " UNION ALL ".join(rows)


ORDERS = {"o_orderkey": "number", "o_custkey": "number", "o_orderstatus": "string", "o_totalprice": "number", "o_orderdate": "date", "o_orderpriority": "string"}


@register("profile_orders", _profile_sql("SELECT * FROM orders", ORDERS))
def profile_orders(spark, d):
    return T.profile(read(spark, d, "orders").select(*ORDERS))


CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal"]


@register("infer_types", "SELECT * FROM (VALUES ('c_custkey', 'number'), ('c_name', 'string'), ('c_nationkey', 'number'), ('c_acctbal', 'number'), ('flag', 'boolean'), ('day', 'date'), ('blank', 'string')) t(name, type)")
def infer_types(spark, d):
    text = read(spark, d, "customer").select(*(F.col(c).cast("string") for c in CUSTOMER))
    return T.infer_types(text.withColumns({"flag": (F.col("c_custkey").cast("long") % 2 == 0).cast("string"), "day": F.lit("2024-01-31"), "blank": F.lit("")}))


JOINED = {"c_custkey": "number", "c_name": "string", "c_nationkey": "number", "o_orderkey": "number", "o_custkey": "number", "o_totalprice": "number"}


def _joined(spark, d):
    return T.inner_join(read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), read(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), "o_custkey", "c_custkey")


JOIN_SQL = "SELECT c_custkey, c_name, c_nationkey, o_orderkey, o_custkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey"


@register("join_orders_customer", JOIN_SQL)
def join_orders_customer(spark, d):
    return _joined(spark, d)


@register("join_profile", _profile_sql(JOIN_SQL, JOINED))
def join_profile(spark, d):
    return T.profile(_joined(spark, d))


@register("null_gaps", "WITH x AS (SELECT d.*, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), n AS (SELECT 'quality' AS name, count_if(quality IS NULL)::BIGINT AS nulls, count(*) AS n FROM x UNION ALL SELECT 'toxic', count_if(toxic IS NULL)::BIGINT, count(*) FROM x UNION ALL SELECT 'text', count_if(text IS NULL)::BIGINT, count(*) FROM x UNION ALL SELECT 'lang', count_if(lang IS NULL)::BIGINT, count(*) FROM x) SELECT name, nulls, floor(100.0::DOUBLE * nulls / n + 0.5)::BIGINT AS pct FROM n WHERE nulls > 0")
def null_gaps(spark, d):
    return T.null_gaps(read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left"))


@register("constant_columns", "SELECT name, value FROM (SELECT 'lang' AS name, min(lang) AS value, count(*) AS n FROM documents WHERE lang = 'de' UNION ALL SELECT 'source', min(source), CASE WHEN min(source) = max(source) THEN count(*) ELSE 0 END FROM documents WHERE lang = 'de') WHERE n > 1")
def constant_columns(spark, d):
    return T.constant_columns(read(spark, d, "documents").where("lang = 'de'"))


@register("correlations", "SELECT 'n_chars' AS a, 'text_len' AS b, floor(corr(n_chars::DOUBLE, length(text)::DOUBLE) * 1000 + 0.5) / 1000 AS r FROM documents")
def correlations(spark, d):
    return T.correlations(read(spark, d, "documents").select("doc_id", "n_chars", F.length("text").alias("text_len"))).where("a <> 'doc_id'")


HOT = """WITH x AS (SELECT d.lang, n_chars, length(text) AS text_len, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE lang = 'de')
SELECT 'nulls' AS kind, 'quality' AS item, floor(100.0::DOUBLE * count_if(quality IS NULL) / count(*) + 0.5) AS value FROM x HAVING count_if(quality IS NULL) > 0
UNION ALL SELECT 'constant', 'lang', 1.0 FROM x HAVING count(*) > 1
UNION ALL SELECT * FROM (SELECT 'correlation', a || '~' || b, floor(coalesce(r, 0) * 1000 + 0.5) / 1000 AS r FROM (
  SELECT 'n_chars' AS a, 'text_len' AS b, corr(n_chars::DOUBLE, text_len::DOUBLE) AS r FROM x
  UNION ALL SELECT 'n_chars', 'quality', corr(n_chars::DOUBLE, quality::DOUBLE) FROM x
  UNION ALL SELECT 'text_len', 'quality', corr(text_len::DOUBLE, quality::DOUBLE) FROM x)) WHERE abs(r) >= 0.5"""


@register("data_hotspots", HOT)
def data_hotspots(spark, d):
    docs = read(spark, d, "documents").where("lang = 'de'").select("doc_id", "lang", "n_chars", F.length("text").alias("text_len"))
    return T.hotspots(docs.join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").drop("doc_id"))
