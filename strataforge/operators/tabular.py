"""Table tools: grouped aggregation, profiles, type inference, joins and hotspots."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataforge.functions.numbers import half_up, is_number, number

OPS = ("count", "sum", "avg", "min", "max")


def aggregate(df: DataFrame, by: str, metric: str | None = None, op: str = "count") -> DataFrame:
    """One row for each group: the group and ``op_metric``, to three digits. Cells that aren't numbers are left out, blank ones are 0.

    A group without numbers has avg 0, min infinity and max minus infinity; an unknown op counts rows. Partial sums are
    made before the shuffle on the group.
    """
    metric = metric or by
    op = op if op in OPS else "count"
    kind = df.schema[metric].dataType
    x = number(F.col(metric)) if isinstance(kind, T.StringType) else F.col(metric).cast("double")
    value = {
        "count": lambda: F.count("*").cast("double"),
        "sum": lambda: F.coalesce(F.sum(x), F.lit(0.0)),
        "avg": lambda: F.coalesce(F.avg(x), F.lit(0.0)),
        "min": lambda: F.coalesce(F.min(x), F.lit(float("inf"))),
        "max": lambda: F.coalesce(F.max(x), F.lit(float("-inf"))),
    }[op]()
    value = value if op == "count" else F.when(F.abs(value) == float("inf"), value).otherwise(half_up(value))
    return df.groupBy(by).agg(value.alias(f"{op}_{metric}"))


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, T.BooleanType):
        return "boolean"
    return "date" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "string"


DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9:.]+Z?)?$"


def _inferred(c: Column) -> Column:
    """A column's type from its cells that aren't blank: number, boolean, date or string, the first that all fit."""
    some = (F.coalesce(F.trim(c), F.lit("")) != "")
    every = lambda test: F.bool_and(F.when(some, test))
    return F.when(F.count_if(some) == 0, "string").when(every(is_number(c)), "number").when(every(F.lower(F.trim(c)).isin("true", "false")), "boolean").when(every(c.rlike(DATE)), "date").otherwise("string")


def infer_types(df: DataFrame) -> DataFrame:
    """name, type of each column of a table of strings, in one pass."""
    one = df.agg(*(_inferred(F.col(c)).alias(c) for c in df.columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("type")) for c in df.columns))).alias("x")).select("x.*")


def profile(df: DataFrame) -> DataFrame:
    """name, type, nulls, distinct, min, max, mean of each column; the last three of numbers only, the mean to three digits.

    Types of string columns are read from their cells, as infer_types() does; blank strings are nulls, and no value. All columns
    are profiled in one pass for what needs no distinct count; distinct counts come from one long shape (column, 64-bit hash of
    the value), so cells are shuffled once, after a partial distinct, in 8 bytes whatever their width.
    """
    none = F.lit(None).cast("double")
    parts, cells = [], []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        text = isinstance(f.dataType, T.StringType)
        null = c.isNull() | (c == "") if text else c.isNull()
        kind = _inferred(c) if text else F.lit(_kind(f.dataType))
        x = F.when(F.trim(c) != "", number(c)) if text else c.cast("double") if _kind(f.dataType) == "number" else none
        of = lambda v, kind=kind: F.when(kind == "number", v)
        parts.append(F.struct(F.lit(f.name).alias("name"), kind.alias("type"), F.count_if(null).alias("nulls"), of(F.min(x)).alias("min"), of(F.max(x)).alias("max"), of(half_up(F.avg(x))).alias("mean")))
        cells.append(F.struct(F.lit(f.name).alias("name"), F.xxhash64(c.cast("string")).alias("h"), null.alias("missing")))
    first = df.agg(*(p.alias(f"_{i}") for i, p in enumerate(parts))).select(F.explode(F.array(*(f"_{i}" for i in range(len(parts))))).alias("x")).select("x.*")
    shown = df.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("NOT missing")
    distinct = shown.groupBy("name", "h").count().groupBy("name").agg(F.count("*").alias("distinct"))
    return first.join(distinct, "name", "left").select("name", "type", "nulls", F.coalesce("distinct", F.lit(0)).cast("long").alias("distinct"), "min", "max", "mean")


def inner_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of both with equal keys: the right columns first, a left one in place of an equally named right one. Null keys are blank ones, which match."""
    a, b = left.alias("a"), right.alias("b")
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cols = [F.col(f"a.{c}") if c in left.columns else F.col(f"b.{c}") for c in right.columns]
    cols += [F.col(f"a.{c}") for c in left.columns if c not in right.columns]
    kinds = left.schema[left_key].dataType, right.schema[right_key].dataType
    typed = kinds[0] == kinds[1] and not isinstance(kinds[0], T.StringType)
    same = F.col(f"a.{left_key}").eqNullSafe(F.col(f"b.{right_key}")) if typed else key(f"a.{left_key}") == key(f"b.{right_key}")
    return a.join(b, same).select(*cols)


def join_profile(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    return profile(inner_join(left, right, left_key, right_key))


def null_gaps(df: DataFrame) -> DataFrame:
    """name, nulls, pct (whole percent) of the columns that have nulls."""
    n = df.agg(F.count("*").alias("_n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    x = n.select("_n", F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("nulls")) for c in df.columns))).alias("x")).select("_n", "x.*")
    return x.where("nulls > 0").select("name", "nulls", F.floor(100.0 * F.col("nulls") / F.col("_n") + 0.5).cast("long").alias("pct"))


def constant_columns(df: DataFrame) -> DataFrame:
    """name, value of columns with one value at most, of tables with more than one row. Smallest and largest decide, so nothing is kept by value."""
    one = df.agg(F.count("*").alias("_n"), *(F.struct(F.min(F.col(c).cast("string")).alias("lo"), F.max(F.col(c).cast("string")).alias("hi"), F.count_if(F.col(c).isNull()).alias("nulls")).alias(c) for c in df.columns))
    x = one.select("_n", F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"{c}.lo").alias("lo"), F.col(f"{c}.hi").alias("hi"), F.col(f"{c}.nulls").alias("nulls")) for c in df.columns))).alias("x")).select("_n", "x.*")
    same = (F.col("lo").eqNullSafe(F.col("hi"))) & ((F.col("nulls") == 0) | (F.col("nulls") == F.col("_n")))
    return x.where((F.col("_n") > 1) & same).select("name", F.col("lo").alias("value"))


def pearson(a: Column, b: Column) -> Column:
    """Over rows that have both; 0 where one doesn't vary."""
    r = F.corr(a.cast("double"), b.cast("double"))
    return half_up(F.when(r.isNull() | F.isnan(r), F.lit(0.0)).otherwise(r))


def correlations(df: DataFrame, least: float = 0.5) -> DataFrame:
    """a, b, r of the pairs of numeric columns whose correlation is strong, all in one pass."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    pairs = list(combinations(names, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    one = df.agg(*(pearson(F.col(a), F.col(b)).alias(f"_{i}") for i, (a, b) in enumerate(pairs)))
    x = one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("r")) for i, (a, b) in enumerate(pairs)))).alias("x")).select("x.*")
    return x.where(F.abs("r") >= least)


def hotspots(df: DataFrame, least: float = 0.5) -> DataFrame:
    """kind, item, value: null gaps with their percentage, constant columns, strong correlations."""
    gaps = null_gaps(df).select(F.lit("nulls").alias("kind"), F.col("name").alias("item"), F.col("pct").cast("double").alias("value"))
    constant = constant_columns(df).select(F.lit("constant").alias("kind"), F.col("name").alias("item"), F.lit(1.0).alias("value"))
    strong = correlations(df, least).select(F.lit("correlation").alias("kind"), F.concat_ws("~", "a", "b").alias("item"), F.col("r").alias("value"))
    return gaps.unionByName(constant).unionByName(strong)
