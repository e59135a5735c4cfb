"""The index of a file tree: scanned, compared with what is stored, parsed where it changed, and written as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.operators import parsing
from strataforge.operators.state import needs_index, stale, upsert
from strataforge.sources.files import contents, scan

#: How a file is told to have imports.
IMPORTS = r"(?m)^\s*(import|from|use|using|require|#\s*include)\b|\brequire\s*\("


@dataclass
class Index:
    """files (path, hash, symbols, blindspots, imports), facts (path, what, name, kind, line, owner), links (path, spec, target); parsed: how many files this run read."""

    files: DataFrame
    facts: DataFrame
    links: DataFrame
    parsed: int


FACTS = ["path", "what", "name", "kind", "line", "owner"]


def index_tree(spark: SparkSession, root: str, store: str, previous: Index | None = None) -> Index:
    """Indexes the authored files below a root; tables go below ``store``, a new folder.

    With a previous index, only new, changed and incomplete files are parsed, what is gone goes, and all else is carried over;
    then links are resolved anew over all files. An empty tree, or one where nothing changed, is a run like any other.
    """
    found = contents(scan(spark, root).where("status = 'authored'").select("path"), root).select("path", F.col("content").cast("string").alias("text"))
    found = found.select("path", "text", F.sha2(F.col("text"), 256).alias("hash"), F.col("text").rlike(IMPORTS).alias("has_imports"))
    found.write.parquet(f"{store}/scan")
    found = spark.read.parquet(f"{store}/scan")
    todo = found if previous is None else needs_index(found, previous.files)
    todo.write.parquet(f"{store}/todo")
    todo = spark.read.parquet(f"{store}/todo")
    parsing.parse_files(todo).select(*FACTS).write.parquet(f"{store}/parsed")
    new = spark.read.parquet(f"{store}/parsed")
    of = lambda what: F.count_if(F.col("what") == what)
    counts = new.groupBy("path").agg(of("symbol").alias("symbols"), of("diagnostic").alias("blindspots"), of("import").alias("imports"))
    # As many rows as files, of which the estimate from compressed columns is too low: not broadcast.
    rows = todo.select("path", "hash").join(counts.hint("merge"), "path", "left").na.fill(0, ["symbols", "blindspots", "imports"])
    if previous is not None:
        gone = stale(previous.files.select("path"), found.select("path"), "path")
        kept = previous.files.join(gone, "path", "left_anti")
        rows = upsert(kept, rows, "path")
        new = previous.facts.join(gone.union(todo.select("path")), "path", "left_anti").select(*FACTS).unionByName(new)
    rows.write.parquet(f"{store}/files")
    new.write.parquet(f"{store}/facts")
    files, facts = spark.read.parquet(f"{store}/files"), spark.read.parquet(f"{store}/facts")
    parsing.resolve_specifiers(facts.where("what = 'import'").select("path", F.col("name").alias("spec")), files.select("path")).write.parquet(f"{store}/links")
    return Index(files, facts, spark.read.parquet(f"{store}/links"), todo.count())
