"""Ranked retrieval: BM25, identity tiers, vector similarity, rank fusion, session rerank, confidence, packing to budgets, skills."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataforge.functions.decay import age_decay
from strataforge.functions.text import basename, identifier_tokens, query_tokens
from strataforge.functions.vectors import cosine
from strataforge.lineage import cut, numbered

K1, B = 1.5, 0.75
TOKEN = re.compile("[a-z0-9_$]+")
#: Weights of channels in rank fusion, and the constant added to ranks.
WEIGHTS, RANK = {"identity": 2.0, "lexical": 1.0, "similarity": 0.8, "structural": 0.4}, 60


def bm25(docs: DataFrame, terms: list[str], tokens: Column | None = None) -> DataFrame:
    """id, score of the documents (id, text) that hold a term; none without terms.

    Only the query's terms are counted, in each row's own token array: nothing is exploded, and one row of totals (documents,
    mean length, documents of each term) is all that is shuffled. Texts are read once: the counts, a few numbers a row, are
    written before the totals are known.
    """
    terms = list(dict.fromkeys(terms))
    if not terms:
        return docs.select("id", F.lit(0.0).alias("score")).where("false")
    t = docs.select("id", (tokens if tokens is not None else identifier_tokens(F.col("text"))).alias("t"))
    count = lambda w: F.size(F.filter("t", lambda x: x == w))
    t = t.select("id", F.size("t").alias("len"), *(count(w).alias(f"tf{i}") for i, w in enumerate(terms)))
    t = cut(t)
    totals = t.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    x = t.crossJoin(F.broadcast(totals))
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    any_hit = F.greatest(*(f"tf{i}" for i in range(len(terms)))) if len(terms) > 1 else F.col("tf0")
    return x.where(any_hit > 0).select("id", score.alias("score"))


def ranked(df: DataFrame, *order: Column, limit: int = 50) -> DataFrame:
    """The first rows by order and then id, with rank0 from 0. The limit is taken first, so one task numbers few rows."""
    top = df.orderBy(*order, "id").limit(limit)
    return top.withColumn("rank0", F.row_number().over(Window.orderBy(*order, "id")) - 1)


def identity_tiers(symbols: DataFrame, query: str) -> DataFrame:
    """Symbols (id, name, ...) with a tier: 0 equal, 1 equal but for case, 2 begins so, 3 contains it; others are left out."""
    low, q = F.lower("name"), query.lower()
    tier = F.when(F.col("name") == query, 0).when(low == q, 1).when(F.startswith(low, F.lit(q)), 2).when(low.contains(q), 3)
    return symbols.withColumn("tier", tier).where("tier IS NOT NULL")


def similar(vectors: DataFrame, query: DataFrame, least: float = 0.3) -> DataFrame:
    """id, score of vectors (id, v) at least so close to the one query vector (v)."""
    x = vectors.crossJoin(F.broadcast(query.select(F.col("v").alias("q")).limit(1)))
    return x.select("id", cosine(F.col("v"), F.col("q")).alias("score")).where(F.col("score") >= least)


def fuse(channels: dict[str, DataFrame], weights: dict[str, float] | None = None, k: int = RANK) -> DataFrame:
    """id, score: the sum over channels (id, rank0) of weight / (k + rank); unknown channels weigh 1, weight 0 leaves one out."""
    weights = WEIGHTS if weights is None else weights
    parts = [x.select("id", (F.lit(float(w)) / (k + F.col("rank0"))).alias("s")) for name, x in channels.items() if (w := weights.get(name, 1.0))]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.groupBy("id").agg(F.sum("s").alias("score"))


def confidence(scores: DataFrame, *, identity: str = "exact", stale: bool = False) -> DataFrame:
    """One row: how sure the best hit of (id, score) is, from its lead, its strength, the identity tier and freshness."""
    top = scores.orderBy(F.desc("score"), "id").limit(2).agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    first, second = F.coalesce(F.get("s", F.lit(0)), F.lit(0.0)), F.coalesce(F.get("s", F.lit(1)), F.lit(0.0))
    gap = F.when(first <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (first - second) / first)))
    strength = 1 - F.exp(-first / 0.05)
    sure = {"exact": 1.0, "partial": 0.7}.get(identity, 0.6) * (0.6 if stale else 1.0)
    return top.select(F.floor(gap * strength * sure * 1000 + 0.5).cast("double").alias("c")).select((F.col("c") / 1000).alias("confidence"))


def rerank(fused: DataFrame, signals: DataFrame, *, cap: float = 0.35, half_life: float = 1800.0, most: float = 21600.0, penalty: float = 0.25) -> DataFrame:
    """id, score, boost: fused scores moved by session signals, each by at most ``cap`` of the best score.

    signals: id, symbol_age, file_age (seconds, null: no access), overlap (query tokens shared), intent, kind_match, runtime
    (needs runtime and few pulls).
    """
    fused = cut(fused)
    best = fused.agg(F.max("score").alias("top"))
    x = fused.join(signals, "id", "left").crossJoin(F.broadcast(best))
    decayed = lambda c: F.coalesce(age_decay(F.col(c), half_life, most), F.lit(0.0))
    intent = F.coalesce("intent", F.lit(0.0))
    boost = (
        0.20 * decayed("symbol_age")
        + 0.10 * decayed("file_age")
        + 0.05 * F.least(F.coalesce("overlap", F.lit(0)), F.lit(3))
        + F.when(F.col("kind_match"), 0.05 * intent).when(F.col("kind_match").isNull() & (intent > 0.5), 0.03 * intent).otherwise(0.0)
        - F.when(F.col("runtime"), F.col("top") * penalty).otherwise(0.0)
    )
    limit = F.col("top") * cap
    boost = F.greatest(-limit, F.least(limit, boost))
    return x.select("id", (F.col("score") + boost).alias("score"), boost.alias("boost"))


def pack_prefix(blocks: DataFrame, by: str, budget: int) -> DataFrame:
    """Blocks (by, rank, tokens, ...) of each group up to the first one that would pass the budget, with the running sum."""
    w = Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("running", F.sum("tokens").over(w)).where(F.col("running") <= budget)


def pack_skipping(blocks: DataFrame, by: str, budget: int) -> DataFrame:
    """(by, rank) of the blocks kept when one that doesn't fit is skipped and the next ones are tried: a fold over each group's sorted blocks."""
    rows = blocks.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", "tokens"))).alias("b"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc.used + x.tokens <= budget
        return F.struct(F.when(fits, acc.used + x.tokens).otherwise(acc.used).alias("used"), F.when(fits, F.array_append(acc.kept, x.rank)).otherwise(acc.kept).alias("kept"))

    return rows.select(by, F.explode(F.aggregate("b", zero, step, lambda acc: acc.kept)).alias("rank"))


def inverted_index(cards: DataFrame) -> DataFrame:
    """token, n, first, last of cards (name, text): how many names a token has, the first and the last. No name list is gathered, so common tokens cost no more."""
    t = cards.select("name", F.explode(query_tokens(F.concat_ws(" ", "name", "text"))).alias("token")).distinct()
    return t.groupBy("token").agg(F.count("*").alias("n"), F.min("name").alias("first"), F.max("name").alias("last"))


def postings(cards: DataFrame) -> DataFrame:
    """token, name of cards (name, text): a row for each token of a card, sorted by token and name; lists are what a reader makes of it."""
    t = cards.select(F.explode(query_tokens(F.concat_ws(" ", "name", "text"))).alias("token"), "name").distinct()
    return t.sort("token", "name")


def postings_lookup(index: DataFrame, names: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """name, score, matched (sorted query tokens) of names (name): 2 for each posting of a query token, 1 for one only inside the name."""
    tokens = sorted({t for t in "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split() if len(t) >= 2})
    if not tokens:
        return names.select("name", F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("matched")).where("false")
    exact = index.where(F.col("token").isin(tokens)).select("name", "token", F.lit(2.0).alias("s"))
    inside = F.filter(F.array(*map(F.lit, tokens)), lambda t: F.lower("name").contains(t))
    part = names.select("name", F.explode(inside).alias("token")).join(exact.select("name", "token"), ["name", "token"], "left_anti").withColumn("s", F.lit(1.0))
    hits = exact.unionByName(part).groupBy("name").agg(F.sum("s").alias("score"), F.array_sort(F.collect_set("token")).alias("matched"))
    return hits.orderBy(F.desc("score"), "name").limit(limit)


def search_symbols(symbols: DataFrame, query: str, limit: int = 50, least: float = 0.3) -> DataFrame:
    """id, score of symbols (id, name, path, kind, importance): identity, lexical and similarity channels, then importance over all that these found, fused.

    The lexical channel is BM25 over the tokens of name, file name and kind; similarity is the cosine of hashed token vectors.
    Importance orders what the other channels found and adds nothing of its own.
    """
    text = F.concat_ws(" ", "name", basename(F.col("path")), "kind")
    plain = symbols.select("id", text.alias("text"))
    terms = [t for t in "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split() if len(t) >= 2]
    identity = numbered(identity_tiers(symbols, query).select("id", "tier", "importance"), F.col("tier"), F.desc("importance"), F.col("id"))
    lexical = numbered(bm25(plain, terms).select("id", F.round("score", 9).alias("score")), F.desc("score"), F.col("id"))
    asked = hash_embedding(symbols.sparkSession.createDataFrame([(0, query)], "id long, text string")).select("idx", F.col("value").alias("q"))
    close = hash_embedding(plain).join(F.broadcast(asked), "idx").groupBy("id").agg(F.round(F.sum(F.col("value") * F.col("q")), 9).alias("score")).where(F.col("score") >= least)
    similar_ = numbered(close, F.desc("score"), F.col("id"))
    pool = identity.select("id").union(lexical.select("id")).union(similar_.select("id")).distinct()
    structural = numbered(symbols.select("id", "importance").join(pool, "id", "left_semi"), F.desc("importance"), F.col("id"))
    return fuse({"identity": identity, "lexical": lexical, "similarity": similar_, "structural": structural}).orderBy(F.desc("score"), "id").limit(limit)


def skill_search(cards: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """name, score of cards (name, description): 2 for each query token among a card's tokens, 1 for one only inside its name."""
    tokens = sorted({t for t in "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split() if len(t) >= 2})
    own = query_tokens(F.concat_ws(" ", "name", "description"))
    score = F.lit(0.0)
    for t in tokens:
        score = score + F.when(F.array_contains("own", t), 2.0).when(F.lower("name").contains(t), 1.0).otherwise(0.0)
    hits = cards.withColumn("own", own).withColumn("score", score).where("score > 0").groupBy("name").agg(F.max("score").alias("score"), F.min("description").alias("description"))
    return hits.orderBy(F.desc("score"), "name").limit(limit)


def skill_pack(cards: DataFrame, task: str, limit: int = 5, pool: int = 25) -> DataFrame:
    """place, name, score: cards that cover a task's tokens with little overlap, chosen one by one from the ``pool`` best hits.

    The pool is a stated constant, so the choice is made on the driver.
    """
    hits = skill_search(cards, task, pool).collect()
    words = lambda s: {t for t in "".join(c if c.isascii() and c.isalnum() else " " for c in (s or "").lower()).split() if len(t) >= 2}
    wanted, covered, left, out = words(task), set(), list(hits), []
    while left and len(out) < limit:
        def gain(h) -> float:
            own = words(h["name"]) | words(h["description"])
            return h["score"] + len((own & wanted) - covered) - 0.6 * len(own & covered)
        best = max(left, key=gain)
        out.append((len(out) + 1, best["name"], math.floor(gain(best) * 100 + 0.5) / 100))
        covered |= words(best["name"]) | words(best["description"])
        left.remove(best)
    return cards.sparkSession.createDataFrame(out, "place int, name string, score double")


def hash_embedding(docs: DataFrame, dims: int = 384) -> DataFrame:
    """id, idx, value of documents (id, text): each token adds 1 / sqrt(tokens) at its hash's place; the vector is then of length 1. Sparse rows.

    A document's vector is made within its row, each distinct token hashed once, so nothing is shuffled.
    """
    kind = docs.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[str, int] = {}

        def hashed(token: str) -> int:
            h = 2166136261
            for c in token.encode():
                h = (h ^ c) * 16777619 & 0xFFFFFFFF
            return h % dims

        for batch in batches:
            ids, at, values = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                counts: Counter[int] = Counter()
                for token, n in Counter(TOKEN.findall(text.lower() if text else "")).items():
                    if token not in place:
                        if len(place) >= 200_000:
                            place.clear()
                        place[token] = hashed(token)
                    counts[place[token]] += n
                if counts:
                    total = math.sqrt(sum(counts.values()))
                    parts = {k: c / total for k, c in counts.items()}
                    norm = math.sqrt(math.fsum(v * v for v in parts.values()))
                    ids += [i] * len(parts)
                    at += parts
                    values += [v / norm for v in parts.values()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int32())), pa.array(at, pa.int32()), pa.array(values, pa.float64())], names=["id", "idx", "value"])

    return docs.select("id", "text").mapInArrow(run, f"id {kind.simpleString()}, idx int, value double")
