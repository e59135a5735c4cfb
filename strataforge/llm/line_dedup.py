"""Exact line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

import contextlib
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.llm.common import join_hot, remove, scratch, small_batches, table, tidy, written

MIN_CHARS, MIN_DOCS = 40, 5
BLANK = b" \t\n\x0b\x0c\r"
#: Batches that a bulk load is taken in at least, documents of a batch at most (in expectation) beyond that, and runs of a
#: level that are compacted to one of the next.
BATCHES, BATCH_DOCS, FANOUT = 4, 10_000_000, 2
#: The id that a null id counts as: below all others.
NO_ID = -(1 << 63)


def key(line: bytes) -> bytes:
    """A line without blanks at its ends, A to Z in lower case."""
    return line.strip(BLANK).lower()


def _long(k: bytes, least: int) -> bool:
    """Whether a key has so many code points: bytes that don't continue one."""
    return len(k) >= least and (len(k) >= 4 * least or k.isascii() or len(k.decode("utf-8", "replace")) >= least)


def line_hashes(text: bytes, least: int = MIN_CHARS) -> list[bytes]:
    """128-bit hashes of the distinct long keys of a text."""
    return list({hashlib.blake2b(k, digest_size=16).digest() for k in map(key, text.split(b"\n")) if _long(k, least)})


def doc_lines(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """(id, hash) of each long line key of each row, once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = line_hashes(text or b"", least)
                ids += [doc] * len(found)
                hashes += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.binary())], names=["id", "hash"])

    return small_batches(docs).select(_id(), F.col("text").cast("binary").alias("text")).mapInArrow(tidy(run), "id long, hash binary")


def _id() -> F.Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id")


@contextlib.contextmanager
def sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Scans of bucketed tables, one file a bucket, are known to be sorted; the session's setting comes back afterwards."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class LineRuns:
    """Runs of (hash, n_docs, last_id) in levels: tables in buckets of the hash, each a file sorted by it.

    Batches come with falling ids. add() merge-anti-joins a batch with the runs: a line that no run holds enters with its
    largest id, one that is held adds to the count alone, so each line has its holder from the first batch that had it.
    Both are the batch's own run on level 0; when a level has ``fanout`` runs they are merged to one of the next, so a line is
    rewritten as often as there are levels, the logarithm of the batches. Buckets are as many as the session's shuffle
    partitions, so a batch is dealt out once, by its own count, and runs are merged where they lie: neither shuffled nor sorted.

    Runs are tables of the session's catalogue, with files in the shared folder; both go when a run is merged into another, and with close().
    """

    SCHEMA = "hash binary, n_docs long, last_id long"

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT):
        self.spark, self.path, self.fanout = spark, path or scratch(spark, "line-runs"), fanout
        self.name, self.buckets = f"line_run_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.paths: dict[str, str] = {}
        self.count = 0

    def _write(self, run: DataFrame, level: int) -> None:
        name, path = f"{self.name}_{self.count}", f"{self.path}/level={level}/run={self.count}"
        self.count += 1
        with sorted_buckets(self.spark):
            run.write.bucketBy(self.buckets, "hash").sortBy("hash").option("path", path).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        self.paths[name] = path

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """Runs merged by hash, two at a time."""
        out = runs[0]
        for r in runs[1:]:
            both = out.alias("a").join(r.alias("b").hint("merge"), F.col("a.hash") == F.col("b.hash"), "full")
            n = F.coalesce("a.n_docs", F.lit(0)) + F.coalesce("b.n_docs", F.lit(0))
            out = both.select(F.coalesce("a.hash", "b.hash").alias("hash"), n.alias("n_docs"), F.greatest("a.last_id", "b.last_id").alias("last_id"))
        return out

    def _known(self, batch: DataFrame) -> DataFrame:
        """The batch with ``held``, whether a run holds the line: one merge join with each run."""
        batch = batch.withColumn("held", F.lit(False))
        for i, r in enumerate(self.runs()):
            r = r.where("last_id IS NOT NULL").select(F.col("hash").alias(f"h{i}")).hint("merge")
            batch = batch.join(r, F.col("hash") == F.col(f"h{i}"), "left").withColumn("held", F.col("held") | F.col(f"h{i}").isNotNull()).drop(f"h{i}")
        return batch

    def new_lines(self, lines: DataFrame) -> DataFrame:
        """The batch's lines that no run holds."""
        return self._known(lines).where("NOT held").drop("held")

    def add(self, lines: DataFrame) -> None:
        """lines: (id, hash). A document counts once, however often its id or the line is repeated in the batch; a document's lines belong in one batch."""
        batch = lines.groupBy("hash").agg(F.count_distinct("id").alias("n_docs"), F.max("id").alias("last_id"))
        # Rows without a match are the anti-join, the others add to the count.
        self._write(self._known(batch).select("hash", "n_docs", F.when(~F.col("held"), F.col("last_id")).alias("last_id")), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            self._write(self._merged([self.spark.table(t) for t in old]), level + 1)
            self.levels[level] = []
            self._forget(old)
            level += 1

    def _forget(self, tables: list[str]) -> None:
        for t in tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
            remove(self.spark, self.paths.pop(t))

    def seen(self) -> DataFrame:
        """All lines of all runs, each once, as a written table."""
        if not self.count:
            return self.spark.createDataFrame([], self.SCHEMA)
        with sorted_buckets(self.spark):
            return written(self._merged(self.runs()), "lines-seen")

    def close(self) -> None:
        self._forget([t for level in self.levels for t in level])
        self.levels = [[]]


def shared_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, hash) of all long lines, and (hash, n_docs, last_id) of those found in at least min_docs documents, through the runs."""
    spark = docs.sparkSession
    batches = batches or max(BATCHES, -(-docs.count() // BATCH_DOCS))
    parts = [k / batches for k in range(1, batches)]
    bounds = sorted(set(docs.select(_id()).agg(F.percentile_approx("id", parts, 250 * batches)).first()[0] or []))
    # Batch 0 has the largest ids: the batch is the number of bounds that an id is below.
    batch = F.size(F.filter(F.lit(bounds).cast("array<long>"), lambda b: F.col("id") < b)) if bounds else F.lit(0)
    lines = written(doc_lines(docs, min_chars).withColumn("batch", batch.cast("int")), "lines", "batch")
    runs = LineRuns(spark)
    for k in range(len(bounds) + 1):
        runs.add(lines.where(F.col("batch") == k).select("id", "hash"))
    shared = runs.seen().where(F.col("n_docs") >= min_docs)
    runs.close()
    return lines.select("id", "hash"), shared


def dedup_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int | None = None) -> DataFrame:
    """Every row with n_lines, n_dropped and kept_text: without the lines whose key has min_chars code points and stands in min_docs documents, but for the document with the largest id among those.

    A null or empty text is one empty line; kept_text is then empty. Documents are ids: repeated rows of an id count as
    one document and keep or lose lines alike; rows with a null id count as one document below all others. All other
    columns pass. An empty table gives an empty one. The result's new columns replace equally named ones.
    """
    lines, shared = shared_lines(docs, min_chars=min_chars, min_docs=min_docs, batches=batches)
    # A row of (id, hash) stays only where the line goes: never more rows than lines. Very common lines don't gather in a task.
    drop = join_hot(lines, shared.hint("merge"), "hash", "n_docs", lines.count()).where(F.col("id") < F.col("last_id")).groupBy("id").agg(F.collect_set("hash").alias("_drop"))
    docs = docs.drop("n_lines", "n_dropped", "kept_text", "_drop").withColumn("_id", _id())
    names = docs.columns[:-1]
    joined = docs.join(drop.withColumnRenamed("id", "_id"), "_id", "left").drop("_id")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name != "_drop") + ", n_lines long, n_dropped long, kept_text string"
    at_text, at_drop = joined.columns.index("text"), joined.columns.index("_drop")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, gone in zip(batch.column(at_text).to_pylist(), batch.column(at_drop).to_pylist(), strict=True):
                text = text or ""
                if gone is None:
                    rows.append((text.count("\n") + 1, 0, text))
                    continue
                gone, own = set(gone), text.encode().split(b"\n")
                kept = [x for x in own if not (_long(k := key(x), min_chars) and hashlib.blake2b(k, digest_size=16).digest() in gone)]
                rows.append((len(own), len(own) - len(kept), b"\n".join(kept).decode()))
            more = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)] if rows else [pa.array([], k) for k in (pa.int64(), pa.int64(), pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(batch.num_columns) if i != at_drop] + more, names=[*names, "n_lines", "n_dropped", "kept_text"])

    return joined.mapInArrow(tidy(run), schema)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
