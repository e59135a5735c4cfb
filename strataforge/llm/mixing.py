"""Mixing sources to target weights: Sainte-Lague quotas of equal-token blocks for sources and shards, then seeded blocks."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.llm import textvec
from strataforge.llm.common import NOT_SPACE, cut, groups, join_hot, small_batches, table, tidy

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
SEED = 17
#: A shard has about so many words or documents of one source at most, whichever is reached first (a longer document stands alone).
SHARD_WORDS, SHARD_DOCS = 1 << 21, 1 << 15
#: Blocks have so many words, fewer where the smallest source would have under BLOCKS of them.
BLOCK_WORDS, BLOCKS = 256, 512
#: Up to so many sources their quotas are found on the driver and broadcast (under 2 MB); beyond, by sums over the table of sources.
BROADCAST_SOURCES = 10_000
#: Divisors that one pass over the table of sources tries.
TRIES = 32


def targets(sizes: np.ndarray, weights: np.ndarray, share: float = SHARE, most: float = MOST) -> np.ndarray:
    """share of all sizes dealt by weight, none above most times its size; what that cuts off is dealt again by weight."""
    sizes, weights = sizes.astype(float), weights.astype(float)
    cap, out, open_ = most * sizes, np.zeros(len(sizes)), np.ones(len(sizes), bool)
    while open_.any():
        level = max(0.0, share * sizes.sum() - cap[~open_].sum()) / weights[open_].sum()
        over = open_ & (weights * level > cap)
        if not over.any():
            out[open_] = weights[open_] * level
            break
        open_ &= ~over
    out[~open_] = cap[~open_]
    return out


def sainte_lague(votes: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Seats by highest quotients votes / (2 k + 1), at most caps each; equal quotients go to the earlier one.

    A divisor found by halving gives all but a few seats at once; the rest are dealt one by one.
    """
    votes, caps = votes.astype(float), np.where(votes > 0, caps, 0).astype(np.int64)
    seats = int(min(seats, caps.sum()))
    if seats <= 0:
        return np.zeros(len(votes), np.int64)
    given = lambda d: np.minimum(np.floor(votes / d + 0.5), caps).astype(np.int64)
    low, high = 0.0, 2 * votes.max() + 1  # too many or enough seats; too few
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high) or mid == 0:
            break
        low, high = (mid, high) if given(mid).sum() > seats else (low, mid)
        if given(high).sum() == seats:
            break
    out = given(high)
    left = [(-votes[i] / (2 * out[i] + 1), i) for i in np.flatnonzero(out < caps)]
    heapq.heapify(left)
    for _ in range(seats - int(out.sum())):
        _, i = heapq.heappop(left)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(left, (-votes[i] / (2 * out[i] + 1), i))
    return out


def source_quotas(stats: pd.DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> pd.DataFrame:
    """stats: source, source_size, n_docs. Adds target, seats (blocks), block (words) and shards; sources by code point, null last, take the weights in turn."""
    stats = stats.assign(_null=stats.source.isna(), _key=[x.encode() if isinstance(x, str) else b"" for x in stats.source]).sort_values(["_null", "_key"]).reset_index(drop=True)
    size = stats.source_size.to_numpy(np.int64)
    weight = np.resize(np.array(weights, float), len(stats))
    goal = targets(size, weight, share, most)
    some = size[size > 0]
    block = int(np.clip(some.min() // BLOCKS, 1, BLOCK_WORDS)) if len(some) else 1
    caps = np.floor(most * np.maximum(1, np.round(size / block)))
    seats = sainte_lague(goal, int(round(goal.sum() / block)), caps)
    shards = np.maximum(1, np.maximum(-(-size // SHARD_WORDS), -(-stats.n_docs.to_numpy(np.int64) // SHARD_DOCS)))
    return pd.DataFrame({"source": stats.source, "source_size": size, "target": goal, "seats": seats, "block": block, "shards": shards})


QUOTAS = "source string, source_size long, target double, seats long, block long, shards long"


def quotas_of_many(stats: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source_quotas() without gathering the sources: places by a sort, the level of targets and the divisor by sums over the table."""
    ordered = cut(stats.orderBy(F.col("source").isNull(), F.col("source").cast("binary")))
    at = ordered.withColumn("_at", F.monotonically_increasing_id())
    # One number for each partition.
    held = {r["_p"]: r["count"] for r in at.groupBy(F.shiftright("_at", 33).alias("_p")).count().collect()}
    before, offsets = 0, []
    for p in range(max(held) + 1):
        offsets.append(before)
        before += held.get(p, 0)
    place = F.element_at(F.lit(offsets).cast("array<long>"), F.shiftright("_at", 33).cast("int") + 1) + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.lit([float(w) for w in weights]), (place % len(weights)).cast("int") + 1)
    x = cut(at.select("source", "source_size", "n_docs", place.alias("place"), weight.alias("weight"), (most * F.col("source_size")).alias("cap")))
    whole, smallest = x.agg(share * F.sum("source_size"), F.min(F.when(F.col("source_size") > 0, F.col("source_size")))).first()
    level = 0.0
    while True:
        over = F.col("weight") * level > F.col("cap")
        cut_off, open_ = x.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        higher = max(0.0, whole - cut_off) / open_ if open_ else level
        if higher <= level:
            break
        level = higher
    block = int(np.clip(smallest // BLOCKS, 1, BLOCK_WORDS)) if smallest else 1
    x = x.withColumn("target", F.least("cap", F.col("weight") * level)).withColumn("limit", F.floor(most * F.greatest(F.lit(1), F.round(F.col("source_size") / block))).cast("long"))
    goal, limits, top = x.agg(F.sum("target"), F.sum(F.when(F.col("target") > 0, F.col("limit")).otherwise(0)), F.max("target")).first()
    seats = int(min(round(goal / block), limits))
    given = lambda d: F.when(F.col("target") > 0, F.least(F.floor(F.col("target") / d + 0.5), F.col("limit"))).otherwise(0).cast("long")
    low, high = 0.0, 2 * top + 1  # too many or enough seats; too few
    while True:
        tries = [d for d in np.linspace(low, high, TRIES + 2)[1:-1].tolist() if low < d < high]
        if not tries:
            break
        got = x.agg(*(F.sum(given(d)) for d in tries)).first()
        low, high = max([low, *(d for d, n in zip(tries, got, strict=True) if n > seats)]), min([high, *(d for d, n in zip(tries, got, strict=True) if n <= seats)])
        if seats in got:
            high = tries[list(got).index(seats)]
            break
    x = x.withColumn("seats", given(high))
    while left := seats - (x.agg(F.sum("seats")).first()[0] or 0):
        # Few are left: those whose quotients no divisor in doubles tells apart.
        rank = (F.col("target") / (2 * F.col("seats") + 1)).alias("q")
        more = x.where("target > 0 AND seats < `limit`").select("place", rank).orderBy(F.desc("q"), "place").limit(left).select("place", F.lit(1).alias("one"))
        x = cut(x.join(more, "place", "left").withColumn("seats", F.col("seats") + F.coalesce("one", F.lit(0))).drop("one"))
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS), F.ceil(F.col("n_docs") / SHARD_DOCS))
    return x.select("source", "source_size", "target", "seats", F.lit(block).cast("long").alias("block"), shards.cast("long").alias("shards"), "n_docs")


def _key() -> Column:
    """A source's name, null sources apart from empty ones."""
    return F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_source")


def with_quotas(rows: DataFrame, q: DataFrame, n_docs: int | None) -> DataFrame:
    """rows with their source's figures; n_docs: of all rows, or none where q is small enough to broadcast."""
    rows, q = rows.withColumn("_source", _key()), q.withColumn("_source", _key()).drop("source")
    return (rows.join(F.broadcast(q.drop("n_docs")), "_source") if n_docs is None else join_hot(rows, q, "_source", "n_docs", n_docs)).drop("_source")


def quotas(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> tuple[DataFrame, int | None]:
    """One row for each source, and the number of all rows, or none if the sources are few enough to broadcast."""
    spark = sized.sparkSession
    stats = sized.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"), F.count("*").alias("n_docs"))
    few = stats.limit(BROADCAST_SOURCES + 1).toPandas()
    if few.empty:
        return spark.createDataFrame([], QUOTAS), None
    if len(few) <= BROADCAST_SOURCES:
        return spark.createDataFrame(source_quotas(few, weights, share, most).astype({"source": object}).to_dict("records"), QUOTAS), None
    return quotas_of_many(stats, weights, share, most), sized.count()


def blocks_taken(sizes: np.ndarray, block: int, seats: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each block of a shard is taken, and where blocks end on the line of the shard's words.

    Every block is taken seats // blocks times, and a seeded choice of the others once more.
    """
    words = int(sizes.sum())
    n = max(1, int(round(words / block)))
    often = np.full(n, seats // n, np.int64)
    often[np.random.default_rng(seed).permutation(n)[: seats % n]] += 1
    edges = np.arange(n + 1, dtype=np.int64) * words // n if words < 1 << 40 else np.round(np.linspace(0, words, n + 1)).astype(np.int64)
    return often, edges


def words_taken(sizes: np.ndarray, often: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Words that each document gives, repeats counted."""
    ends = np.cumsum(sizes)
    upto = np.concatenate(([0], np.cumsum(often * np.diff(edges))))

    def before(x: np.ndarray) -> np.ndarray:
        i = np.clip(np.searchsorted(edges, x, "right") - 1, 0, len(often) - 1)
        return upto[i] + often[i] * (x - edges[i])

    return before(ends) - before(ends - sizes)


def _sized(docs: DataFrame, seed: int, *more: Column) -> DataFrame:
    """Each row's words and its seeded place, by id and text: rows alike in both are interchangeable."""
    size = F.coalesce(F.regexp_count("text", F.lit(NOT_SPACE)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("place"), *more)


def _in_shards(rows: DataFrame, q: DataFrame, n_docs: int | None) -> DataFrame:
    return with_quotas(rows, q, n_docs).withColumn("shard", F.pmod("place", "shards")).withColumn("group", _group())


def _lines(docs: DataFrame, weights: tuple, share: float, most: float, seed: int, *more: Column) -> DataFrame:
    """All rows, dealt and sorted by shard (group) in seeded order; before a shard's rows stands one without an id (kind 0) that has its blocks (seats).

    Only sizes are gathered to find the quotas; whole rows, if ``more`` has them, are moved once.
    """
    narrow = cut(_sized(docs, seed))
    q, n_docs = quotas(narrow, weights, share, most)
    # Shard sizes are sums made before the shuffle; a source's shards are few next to its documents.
    placed = _in_shards(narrow, q, n_docs)
    sums = placed.groupBy("source", "seats", "block", "shard", "group").agg(F.sum("size").alias("shard_size"))

    def deal(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("shard")
        n = np.maximum(1, np.round(p.shard_size / p.block)).to_numpy()
        got = sainte_lague(p.shard_size.to_numpy(), int(p.seats.iloc[0]), np.floor(most * n))
        return pd.DataFrame({"group": p.group, "block": p.block, "shard_seats": got})

    dealt = sums.groupBy("source").applyInPandas(deal, "group string, block long, shard_seats long")
    rows = _in_shards(_sized(docs, seed, *more), q, n_docs) if more else placed
    rows = rows.drop("seats", "block", "shards", "shard").withColumn("kind", F.lit(1))
    both = rows.unionByName(dealt.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    return both.withColumn("order", F.xxhash64(F.lit(seed + 1), "place")).repartition("group").sortWithinPartitions("group", "kind", "order", "doc_id", "size")


def mix_sources(docs: DataFrame, *, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row: how many of its words the mix takes, repeats counted.

    Documents of a source stand in seeded order on a line of words, in shards; the line is cut to equal blocks, each
    source gets blocks by its target and each shard by its words, by highest quotients, and a shard takes all its
    blocks as often as they go and a seeded choice once more, so no document gives more than ``most`` times its words.
    Null and empty texts have size 0 and give nothing; null sources are one source; rows that repeat an id count as rows
    (those of equal text, too, are interchangeable); other columns are not read; an empty table gives an empty one.
    """
    schema = "doc_id long, source string, size long, source_size long, target double, taken long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, "group"):
            g, sizes, _, (often, edges) = _line(g)
            columns = [g.column(c) for c in ("doc_id", "source", "size", "source_size", "target")]
            yield from pa.table([*columns, pa.array(words_taken(sizes, often, edges))], names=[x.split()[0] for x in schema.split(", ")]).to_batches()

    return _lines(docs, weights, share, most, seed).mapInArrow(tidy(run), schema)


def _group() -> F.Column:
    """A shard's key, of fixed length; null sources apart from empty ones."""
    return F.md5(F.concat_ws("\0", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")), "shard").cast("binary"))


def _line(g: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """A shard's rows, their sizes and starts, and its blocks."""
    seed = int(g.column("group")[0].as_py()[:15], 16)
    block, seats = g.column("block")[0].as_py(), g.column("shard_seats")[0].as_py()
    g = g.slice(1)
    sizes = g.column("size").to_numpy()
    return g, sizes, np.cumsum(sizes) - sizes, blocks_taken(sizes, block, seats, seed)


def mixed_rows(docs: DataFrame, *, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The mix itself: each row as often as a pass over its source takes any of its words, text and n_chars cut to the words taken; other columns pass.

    A pass that takes a whole text takes it as it is; else the runs of taken words, with the space between them as in the
    text, are joined by a blank. Needs doc_id, text and source; null and empty texts are not in the mix. n_chars is set where
    it holds whole numbers or strings; rows that repeat an id count as rows; an empty table gives an empty one.
    """
    names = docs.columns
    rows = _lines(small_batches(docs), weights, share, most, seed, F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names))).alias("row"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, "group"):
            g, sizes, starts, (often, edges) = _line(g)
            data = g.select([f"c{i}" for i in range(len(names))]).rename_columns(names)
            at_text = names.index("text")
            for a, b in textvec.chunks(pc.fill_null(pc.binary_length(data.column(at_text)), 0).to_pylist(), 4 << 20):
                pick, texts = [], []
                for i in range(a, b):
                    if not sizes[i]:
                        continue
                    text = None
                    first, last = (int(np.searchsorted(edges, x, "right")) - 1 for x in (starts[i], starts[i] + sizes[i] - 1))
                    for turn in range(int(often[first : last + 1].max())):
                        on = np.flatnonzero(often[first : last + 1] > turn) + first
                        text = text if text is not None else data.column(at_text)[i].as_py()
                        pick.append(i)
                        if len(on) == last - first + 1:
                            texts.append(text)
                            continue
                        raw = text.encode()
                        begin, end = textvec.runs(~textvec.SPACE[np.frombuffer(raw, np.uint8)])
                        parts = np.split(on, np.flatnonzero(np.diff(on) > 1) + 1)
                        spans = [(max(0, edges[p[0]] - starts[i]), min(sizes[i], edges[p[-1] + 1] - starts[i])) for p in parts]
                        texts.append(b" ".join(raw[begin[x] : end[y - 1]] for x, y in spans if y > x).decode())
                if pick:
                    out = data.take(pa.array(pick))
                    out = out.set_column(at_text, "text", pa.array(texts, pa.string()))
                    if "n_chars" in names and (pa.types.is_integer(kind := data.schema.field("n_chars").type) or pa.types.is_string(kind)):
                        out = out.set_column(names.index("n_chars"), "n_chars", pa.array([len(t) for t in texts], pa.int64()).cast(kind))
                    yield from out.combine_chunks().to_batches()

    return rows.select("row.*", "size", "block", "shard_seats", "group").mapInArrow(tidy(run), schema)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")
