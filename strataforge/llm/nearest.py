"""Approximate nearest neighbours by cosine: probed lists, scanned by blocks of rotated dimensions with early abandoning."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataforge.llm.common import cut, table, tidy

#: Rows that the lists' centres are fitted on at most, in expectation, by a hash of the id. There are no more lists than these.
SAMPLE = 16_384
SEED = 11
#: Rows of the sample among which each query finds the distance that its bound starts at.
STARTS = 512
#: Rows of a list that are scanned at a time; rows of a list, and queries that probe it, that one task holds. Longer lists are
#: dealt to several tasks, so a query goes once to a list, or to each so large a part of it.
CHUNK, PART, ASKED = 4096, 1 << 17, 1 << 15
#: Dimensions in a block; how many standard errors a partial distance must be above the bound for a candidate to be abandoned.
BLOCK, ERRORS = 16, 3.0
NEIGHBOURS = 5
#: Share of the nearest that the probed lists should hold.
RECALL = 0.97


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centres(sample: np.ndarray, lists: int, seed: int = SEED, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on unit vectors; an empty list takes a random row."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        near = np.argmax(sample @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        norm = np.linalg.norm(total, axis=1)
        empty = norm < 1e-12
        total[empty] = sample[rng.integers(0, len(sample), int(empty.sum()))]
        c = total / np.linalg.norm(total, axis=1, keepdims=True)
    return c


def probes_for(sample: np.ndarray, middle: np.ndarray, k: int, recall: float, trials: int = 256) -> int:
    """The fewest lists that hold so large a share of the k nearest of the sample's first rows, among the sample.

    All rows have nearer neighbours than the sample alone, so the whole table's recall is no lower in expectation.
    """
    asked = sample[:trials]
    near = asked @ sample.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -2
    top = np.argsort(-near, axis=1)[:, : min(k, len(sample) - 1)]
    if not top.size:
        return len(middle)
    of_row = np.argmax(sample @ middle.T, axis=1)
    order = np.argsort(-(asked @ middle.T), axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(len(middle)), order.shape), axis=1)
    needed = np.sort(np.take_along_axis(rank, of_row[top], axis=1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)))]) + 1


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector in doubles of the rows that take part: not null, of the commonest length, all components finite, not all zero."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.where(finite & F.exists("v", lambda x: x != 0))


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that no square overflows: their cosines stay as they are."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])


def unit(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def cosine(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosines of one vector with rows, each by the same sums in double precision, whatever stands beside it."""
    q, c = scaled(q[None])[0], scaled(c)
    return (c * q).sum(axis=1) / (np.sqrt((c * c).sum(axis=1)) * math.sqrt((q * q).sum()))


class Scan:
    """The k nearest rows of each query, from rows that come in chunks, by blocks of rotated dimensions.

    A query's bound is the k-th smallest squared distance known so far: it comes with the query, from the sample, and falls
    when rows are measured. Of a chunk, the rows with the least distance in the first block are measured whole at once, then
    those that look best after each block; the other rows are abandoned as soon as their partial distance, as an estimate of
    the whole one, is above the bound by more than the test's error for so many dimensions.
    """

    def __init__(self, queries: np.ndarray, ids: np.ndarray, bounds: np.ndarray, rot: np.ndarray, k: int):
        self.queries, self.ids, self.rot, self.k = queries, ids, rot, k
        self.asked, self.bounds = unit(queries) @ rot, bounds.copy()
        self.near = [np.full(k, np.inf) for _ in ids]
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0)) for _ in ids]

    def _fall(self, qi: int, distances: np.ndarray) -> None:
        self.near[qi] = np.sort(np.concatenate([self.near[qi], distances]))[: self.k]
        self.bounds[qi] = min(self.bounds[qi], self.near[qi][-1])

    def add(self, rows: np.ndarray, ids: np.ndarray) -> None:
        dim, k = rows.shape[1], self.k
        turned = unit(rows) @ self.rot
        first = min(dim, BLOCK)
        head = np.ascontiguousarray(turned[:, :first])
        heads = (head**2).sum(axis=1)
        for qi, q in enumerate(self.asked):
            # The first block of all rows at once, by one product.
            partial = np.maximum(0, heads - 2 * (head @ q[:first]) + q[:first] @ q[:first])
            keep, done = np.flatnonzero(ids != self.ids[qi]), np.zeros(0, np.int64)
            partial, at = partial[keep], first
            while True:
                if len(keep) > 8 * k and at < dim:
                    # Rows that look best are measured whole, so that the bound falls before the others are judged.
                    look = np.argpartition(partial, k - 1)[:k]
                    whole = keep[look]
                    self._fall(qi, ((turned[whole] - q) ** 2).sum(axis=1))
                    done = np.append(done, whole)
                    keep, partial = np.delete(keep, look), np.delete(partial, look)
                # At d of dim dimensions the estimate is partial * dim / d, with a relative error near ERRORS / sqrt(d).
                bound = self.bounds[qi]
                allow = bound * (at / dim) * (1 + ERRORS / math.sqrt(at)) ** 2 if at < dim else bound
                left = partial <= allow + 1e-9
                keep, partial = keep[left], partial[left]
                if at == dim or not len(keep):
                    break
                end = min(dim, at + BLOCK)
                partial = partial + ((turned[keep, at:end] - q[at:end]) ** 2).sum(axis=1)
                at = end
            if len(keep):
                self._fall(qi, partial)
            keep = np.append(done, keep[partial <= self.bounds[qi] + 1e-9])
            known, scores = self.best[qi]
            known, scores = np.append(known, ids[keep]), np.append(scores, cosine(self.queries[qi], rows[keep]))
            order = np.lexsort((known, -scores))
            order = order[np.sort(np.unique(known[order], return_index=True)[1])][:k]
            self.best[qi] = known[order], scores[order]

    def found(self) -> list[tuple[int, int, float]]:
        return [(int(q), int(i), float(s)) for q, (ids, scores) in zip(self.ids, self.best, strict=True) for i, s in zip(ids, scores, strict=True)]


def from_sample(asked: np.ndarray, asked_ids: np.ndarray, sample: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sample's k rows of other ids that are nearest to each unit vector (none where the sample is so small), and the k-th one's squared distance: a bound on that among all rows."""
    if len(sample) <= k:
        return np.zeros((len(asked), 0), np.int64), np.full(len(asked), np.inf)
    d = 2 - 2 * (asked @ sample.T)
    d[asked_ids[:, None] == ids[None, :]] = np.inf
    top = np.argpartition(d, k - 1, axis=1)[:, :k]
    return top, np.maximum(0, np.take_along_axis(d, top, axis=1).max(axis=1)) + 1e-9


KNOWN = pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())]))


def search(vectors: DataFrame, *, every: int = 50, k: int = NEIGHBOURS, lists: int | None = None, probes: int | None = None, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by ``every``, among all others.

    Centres come from a bounded sample; every row is in the list of its nearest centre (half as many lists as the root of the
    rows, and no more than the sample has rows). A query probes the lists of its nearest centres: as many as the sample needs
    for the recall asked for, at least 8, and on until they hold more than k rows. Lists are scanned in chunks under a falling
    bound that starts at the query's k-th distance among ``STARTS`` rows of the sample, whose k rows are candidates, too. Ties go to the smaller id. Null, zero, ragged and non-finite
    vectors and null ids take no part; rows that repeat an id are each candidates, and the nearest of them counts; other
    columns, whatever their names, are not read; an empty table, or one without queries, gives an empty result.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    v = usable(vectors, id_col, vector_col)
    lengths = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim, total = lengths["d"], lengths["count"]
    v = v.where(F.size("v") == dim)
    share = min(1.0, SAMPLE / total)
    hashed = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))
    drawn = v.where(hashed).limit(2 * SAMPLE).toPandas()
    if drawn.empty:
        drawn = v.limit(1).toPandas()
    drawn = drawn.drop_duplicates("vec_id").sort_values("vec_id")
    raw, sample_ids = np.stack(drawn["v"].to_numpy()), drawn["vec_id"].to_numpy(np.int64)
    sample = unit(raw)
    lists = max(1, min(lists or int(math.sqrt(total) / 2), len(sample)))
    middle = centres(sample, lists, seed)
    probes = min(lists, probes or max(8, probes_for(sample, middle, k, recall)))
    rot = rotation(dim, seed)
    starts = np.random.default_rng(seed).permutation(len(sample))[:STARTS]
    model = spark.sparkContext.broadcast((middle, raw[starts], sample_ids[starts]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, dim))
            near = np.concatenate([np.argmax(x[a : a + 1024] @ model.value[0].T, axis=1) for a in range(0, len(x), 1024)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near)], names=["vec_id", "v", "list"])

    placed = cut(v.mapInArrow(tidy(place), "vec_id long, v array<double>, list int"))
    # One number for each list: no more than the sample's rows.
    held = np.zeros(lists, np.int64)
    for r in placed.groupBy("list").count().collect():
        held[r["list"]] = r["count"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, raw, sample_ids = model.value
        sample = unit(raw)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ids = part.column(0).to_numpy()
                x = unit(part.column(1).flatten().to_numpy().reshape(part.num_rows, dim))
                top, bounds = from_sample(x, ids, sample, sample_ids, k)
                own = part.column(1).flatten().to_numpy().reshape(x.shape)
                known = [[{"vec_id": int(i), "score": float(c)} for i, c in zip(sample_ids[t], cosine(q, raw[t]), strict=True)] if len(t) else [] for q, t in zip(own, top, strict=True)]
                order = np.argsort(-(x @ middle.T), axis=1, kind="stable")
                enough = np.argmax(np.cumsum(held[order], axis=1) > min(k, total - 1), axis=1) + 1
                probed = pa.array([o[: max(probes, int(n))].astype(np.int32) for o, n in zip(order, enough, strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), probed, pa.array(bounds), pa.array(known, KNOWN)], names=["vec_id", "v", "lists", "bound", "known"])

    asked = cut(placed.where(F.col("vec_id") % every == 0).select("vec_id", "v").mapInArrow(tidy(ask), "vec_id long, v array<double>, lists array<int>, bound double, known array<struct<vec_id: long, score: double>>"))
    known = asked.select(F.col("vec_id").alias("query_id"), F.explode("known").alias("x")).select("query_id", "x.*")
    asked = asked.select("vec_id", "v", "bound", F.explode("lists").alias("list"))
    dealt = {r["list"]: (int(held[r["list"]]) // PART + 1, r["count"] // ASKED + 1) for r in asked.groupBy("list").count().collect()}
    plan = F.broadcast(spark.createDataFrame([(i, *n) for i, n in dealt.items()], "list int, parts int, sheets int"))
    cell = (F.col("list").cast("long") * (1 << 40) + F.col("part").cast("long") * (1 << 20) + F.col("sheet")).alias("cell")
    mine = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = placed.join(plan, "list").select("vec_id", "v", "list", mine("parts").alias("part"), each("sheets").alias("sheet"), F.lit(None).cast("double").alias("bound"))
    queries = asked.join(plan, "list").select("vec_id", "v", "list", each("parts").alias("part"), mine("sheets").alias("sheet"), "bound")
    both = rows.unionByName(queries).select(cell, F.col("bound").isNull().alias("row"), "vec_id", "v", "bound")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asks, scan = None, [], None

        def out() -> Iterator[pa.RecordBatch]:
            if scan is not None and (got := scan.found()):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*got, strict=True)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            cells = batch.column(0).to_numpy()
            row = batch.column(1).to_numpy(zero_copy_only=False)
            ids = batch.column(2).to_numpy()
            x = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, dim)
            bounds = batch.column(4).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.append(True, (cells[1:] != cells[:-1]) | (row[1:] != row[:-1])))
            for a, b in zip(edges, np.append(edges[1:], len(cells)), strict=True):
                if cells[a] != now:
                    yield from out()
                    now, asks, scan = cells[a], [], None
                if not row[a]:
                    asks.append((x[a:b].copy(), ids[a:b].copy(), bounds[a:b].copy()))
                    continue
                if asks:
                    scan, asks = Scan(*(np.concatenate(c) for c in zip(*asks, strict=True)), rot, k), []
                if scan is not None:
                    for i in range(a, b, CHUNK):
                        scan.add(x[i : min(b, i + CHUNK)], ids[i : min(b, i + CHUNK)])
        yield from out()

    near = both.repartition("cell").sortWithinPartitions("cell", "row").mapInArrow(tidy(found), "query_id long, vec_id long, score double")
    near = near.unionByName(known).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
