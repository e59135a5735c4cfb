"""Set similarity join on word shingles by chosen paths: split sets on sampled shared tokens, compare within small buckets, verify exactly."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataforge.llm import textvec
from strataforge.llm.common import cut, groups, join_hot, maybe_in, relieve, small_batches, table, tidy

WORDS, THRESHOLD = 5, 0.8
#: Share of pairs at the threshold that the paths must bring together, and that the sketches must let through.
RECALL = 0.99999
#: Coordinates of a set's sketch: each the token that one random order of all tokens puts first in the set.
SKETCH = 48
#: Buckets up to so many sets are compared whole; larger ones lose their inner sets to representatives and are split on further tokens, so often at most.
BUCKET, DEPTH = 2048, 3
#: Representatives of a large bucket, in expectation; equal coordinates with one that make a set an inner one.
CHIEFS, INNER = 8, 40
#: A bucket is dense when one of its parts has more than half of it: splitting does not help. It is then compared in cells, or
#: goes on whole to other representatives if that took more than so many cells for a set.
DENSE, CELLS = 0.5, 16
#: Sets and shingles that a block of the exact check holds.
CELL_SETS, CELL_SHINGLES = 2048, 2 << 20
NO_ID = -(1 << 63)

#: Rows of narrow tables, and of tables with sketches, in a partition of a checkpoint.
EDGE_ROWS, NODE_ROWS = 250_000, 20_000

U = np.uint64
_rng = np.random.default_rng(505)
TIMES = _rng.integers(1, 1 << 63, WORDS * 2, dtype=np.uint64) * U(2) + U(1)
ORDERS = _rng.integers(1, 1 << 63, (SKETCH, 2), dtype=np.uint64) * U(2) + U(1)


def runs_for(recall: float, threshold: float) -> int:
    """Paths to follow from the root: each brings a pair at the threshold together with that probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold)))


def least_equal(recall: float, threshold: float, n: int = SKETCH) -> int:
    """The most equal coordinates that may be asked for while so large a share of pairs at the threshold has them."""
    missed = 0.0
    for k in range(n + 1):
        missed += math.comb(n, k) * threshold**k * (1 - threshold) ** (n - k)
        if missed > 1 - recall:
            return k
    return n


def shingles(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's runs of words, lower case, and where each text's begin. Fewer words are one shingle, none has none."""
    data, begins = textvec.joined([(t or "").lower().encode("utf-8", "surrogatepass") for t in texts])
    starts, ends = textvec.runs(~textvec.SPACE[data])
    w = textvec.span_hash(data, starts, ends)
    first = np.searchsorted(starts, begins)
    counts = np.diff(first)
    n = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    out_begin = np.concatenate(([0], np.cumsum(n)))
    at = np.repeat(first[:-1] - out_begin[:-1], n) + np.arange(out_begin[-1])
    h = np.zeros(len(at), np.uint64)
    left = np.repeat(first[1:], n) - at
    padded = np.concatenate([w, np.zeros(words, np.uint64)])
    for k in range(words):
        h += np.where(left > k, padded[at + k] * TIMES[k] + TIMES[words + k], U(0))
    return textvec.mix(h), out_begin


def sketches(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Row for each non-empty set: the first token in each order."""
    at = begin[:-1][np.diff(begin) > 0]
    out = np.empty((len(at), SKETCH), np.uint64)
    for k, (times, plus) in enumerate(ORDERS):
        out[:, k] = np.minimum.reduceat((h ^ plus) * times, at) if len(at) else 0
    return out


def digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def signed(docs: DataFrame, runs: int, words: int = WORDS) -> DataFrame:
    """id, node (a digest of the set; null for none), n (its size), roots (the sampled tokens of the first paths), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in textvec.chunks([len(t or "") for t in texts], 1 << 19):
                h, begin = shingles(texts[a:b], words)
                full = sketches(h, begin)
                node, n, roots, sketch, at = [], [], [], [], 0
                for i in range(b - a):
                    own = np.unique(h[begin[i] : begin[i + 1]])
                    n.append(len(own))
                    if len(own):
                        node.append(digest(own))
                        roots.append(full[at, :runs].view(np.int64))
                        sketch.append(full[at].astype(np.uint32).tobytes())
                        at += 1
                    else:
                        node.append(None), roots.append(None), sketch.append(None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(node, pa.binary()), pa.array(n, pa.int32()), pa.array(roots, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=["id", "node", "n", "roots", "sketch"])

    return small_batches(docs).select(_id(), "text").mapInArrow(tidy(run), "id long, node binary, n int, roots array<long>, sketch binary")


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id")


def _parts(rows: int, each: int) -> int:
    return max(1, -(-rows // each))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node connected to each node of the edges (a, b), by large and small stars until nothing changes."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, total = None, 2 * e.count()
    # Edges don't grow in number, so the checkpoints, and the shuffles that read them, need no more partitions than this. What a
    # join reads three times is a checkpoint, too: else each of the three is a shuffle with tasks of its own, all told to the driver.
    n = _parts(total, EDGE_ROWS)
    e = e.coalesce(n)
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("k")).select("a", F.least("a", "m").alias("m"), "k").coalesce(n))
        large = join_hot(both, low, "a", "k", total).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = cut(large.coalesce(n))
        low = cut(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("k")).coalesce(n))
        small = join_hot(large, low, "a", "k", total).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        e = cut(small.coalesce(n))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        relieve(e.sparkSession)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _sized(members: DataFrame, total: int) -> DataFrame:
    """Members (path, node, parent size) of paths that more than one set follows, with the path's size."""
    sizes = members.groupBy("path").agg(F.count("*").alias("size"), F.count("*").alias("k")).where("size > 1")
    return join_hot(members, sizes, "path", "k", total)


def chiefs(big: DataFrame, nodes: DataFrame, equal: int, limit: int, turn: int) -> DataFrame:
    """(path, node, chief, same): how many coordinates each set of a large bucket has in common with each representative, where this matters.

    About CHIEFS sets of each bucket, chosen by a hash, meet all others, which are dealt in parts of about ``limit`` sets.
    """
    parts = F.ceil(F.col("size") / limit).cast("int")
    m = big.join(nodes.select("node", "sketch"), "node").withColumn("parts", parts)
    leads = F.pmod(F.xxhash64("node", "path", F.lit(turn)), F.col("size")) < CHIEFS
    rows = m.select("path", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), F.lit(1).alias("kind"), "node", "sketch")
    meet = m.where(leads).select("path", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "node", "sketch")
    least = INNER + equal - SKETCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, "cell"):
            kind = g.column("kind").to_numpy()
            s = np.frombuffer(b"".join(g.column("sketch").to_pylist()), np.uint32).reshape(len(kind), SKETCH)
            n = int((kind == 0).sum())
            for c in range(n):
                same = (s[n:] == s[c]).sum(axis=1)
                at = np.flatnonzero(same >= least)
                if len(at):
                    found = g.take(pa.array(at + n))
                    name = pa.array([g.column("node")[c].as_py()] * len(at), pa.binary())
                    yield from pa.table([found.column("path"), found.column("node"), name, pa.array(same[at].astype(np.int32))], names=["path", "node", "chief", "same"]).combine_chunks().to_batches()

    cells = rows.unionByName(meet).withColumn("cell", F.xxhash64("path", "part"))
    return cells.repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(tidy(run), "path long, node binary, chief binary, same int")


def thinned(big: DataFrame, nodes: DataFrame, equal: int, limit: int, turn: int, total: int) -> tuple[DataFrame, DataFrame]:
    """What large buckets (path, node, size) keep without the inner sets of representatives, and edges (a, b) in their place.

    When a set has INNER coordinates in common with a representative, all that have ``equal`` in common with the set have at
    least INNER + equal - SKETCH in common with the representative. So if all of those are linked with the representative,
    the inner sets need no further comparison. That is done where the sets linked by this alone are no more than the inner
    ones; so a group of k near copies takes about CHIEFS * k rows, and sets that share a passage are not linked for it.
    """
    met = cut(chiefs(big, nodes, equal, limit, turn).withColumn("by", F.xxhash64("path", "chief")))
    counts = met.groupBy("by").agg(F.count_if(F.col("same") >= INNER).alias("inner"), F.count_if(F.col("same") < equal).alias("only"), F.count("*").alias("k"))
    good = join_hot(met, counts.where("only <= inner").select("by", "k"), "by", "k", total)
    inner = good.where(F.col("same") >= INNER).select("path", "node").distinct()
    return big.join(inner, ["path", "node"], "left_anti").select("path", "node"), good.select(F.col("node").alias("a"), F.col("chief").alias("b"))


def buckets(nodes: DataFrame, runs: int, equal: int, limit: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(cell, node): every set in each bucket to compare, and edges (a, b) that need no comparison; buckets have at most about ``limit`` sets."""
    total = runs * nodes.count()
    members = cut(_sized(nodes.select("node", F.posexplode("roots").alias("k", "token")).select("node", F.xxhash64("k", "token").alias("path")), total).coalesce(_parts(total, EDGE_ROWS)))
    out, edges = [members.where(F.col("size") <= limit).select(F.col("path").alias("cell"), "node")], [nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false")]
    big = members.where(F.col("size") > limit)
    for turn in range(DEPTH):
        if big.isEmpty():
            break
        left, linked = thinned(big, nodes, equal, limit, turn, total)
        relieve(nodes.sparkSession)
        edges.append(linked)
        left = cut(_sized(left, total).coalesce(_parts(total, EDGE_ROWS)))
        out.append(left.where(F.col("size") <= limit).select(F.col("path").alias("cell"), "node"))
        big = left.where(F.col("size") > limit)
        if big.isEmpty():
            break
        # Each turn has coordinates of its own, after those of the roots: a path never takes a token that it has already.
        each = max(1, (SKETCH - runs) // DEPTH)
        place = lambda j: runs + turn * each + F.pmod(F.xxhash64("parent") + j, F.lit(each))  # noqa: B023, E731
        token = lambda j: F.substr("sketch", F.lit(4) * F.pmod(place(j), F.lit(SKETCH)).cast("int") + 1, F.lit(4))  # noqa: B023, E731
        parents = big.select("node", F.col("path").alias("parent"), F.col("size").alias("parent_size")).join(nodes.select("node", "sketch"), "node")
        children = parents.select("node", "parent", "parent_size", F.posexplode(F.array(*(token(j) for j in range(runs)))).alias("k", "token"))
        children = cut(_sized(children.select("node", "parent", "parent_size", F.xxhash64("parent", "k", "token").alias("path")), total).coalesce(_parts(total, EDGE_ROWS)))
        dense = cut(children.where(F.col("size") > DENSE * F.col("parent_size")).select("parent").distinct())
        rest = children.join(dense, "parent", "left_anti")
        out.append(rest.where(F.col("size") <= limit).select(F.col("path").alias("cell"), "node"))
        whole = big.join(dense.withColumnRenamed("parent", "path"), "path", "left_semi").select("path", "node", "size")
        out.append(_cells(whole.where(F.col("size") <= CELLS * limit / 2), limit))
        whole = whole.where(F.col("size") > CELLS * limit / 2)
        big = cut(rest.where(F.col("size") > limit).select("path", "node", "size").unionByName(whole))
    else:
        out.append(_cells(big, limit))
    both, linked = out[0], edges[0]
    for x in out[1:]:
        both = both.unionByName(x)
    for x in edges[1:]:
        linked = linked.unionByName(x)
    return both, linked


def _cells(members: DataFrame, limit: int) -> DataFrame:
    """All pairs of parts of what is left of too large buckets: each set goes to the cells of its part with every part, so all pairs meet, in small tasks."""
    parts = F.ceil(F.col("size") * 2 / limit).cast("int")
    x = members.withColumns({"parts": parts, "own": F.pmod(F.xxhash64("node"), parts).cast("int")})
    x = x.select("path", "node", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return x.select(F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "node")


def _roots(pairs_of: Iterator[tuple[int, np.ndarray]], m: int) -> np.ndarray:
    """The first member of each one's component, from rows (i, later members joined with i)."""
    root = np.arange(m)

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = int(root[x])
        return x

    for i, js in pairs_of:
        for j in js.tolist():
            a, b = top(i), top(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    return np.array([top(i) for i in range(m)])


def candidate_edges(cells: DataFrame, nodes: DataFrame, equal: int) -> DataFrame:
    """Stars (a, b) that connect the sets of a bucket whose sketches have enough equal coordinates: fewer rows than sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for g in groups(batches, "cell"):
            m = g.num_rows
            if m < 2:
                continue
            s = np.frombuffer(b"".join(g.column("sketch").to_pylist()), np.uint32).reshape(m, SKETCH)
            if m == 2:
                if (s[0] == s[1]).sum() >= equal:
                    x, y = g.column("node").to_pylist()
                    a.append(x), b.append(y)
            else:
                root = np.arange(m)
                for i in range(m - 1):
                    # Those already with i need no second look; the others' components are renamed to i's.
                    j = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
                    near = j[(s[j] == s[i]).sum(axis=1) >= equal]
                    if len(near):
                        joined = np.unique(np.append(root[near], root[i]))
                        root[np.isin(root, joined)] = joined[0]
                off = np.flatnonzero(root != np.arange(m))
                if len(off):
                    names = g.column("node").to_pylist()
                    a += [names[i] for i in off]
                    b += [names[root[i]] for i in off]
            if len(a) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    full = cells.join(nodes.select("node", "sketch"), "node").select("cell", "node", "sketch")
    return full.repartition("cell").sortWithinPartitions("cell").mapInArrow(tidy(run), "a binary, b binary")


def intersections(left: list[np.ndarray], right: list[np.ndarray] | None = None, columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs, over the tokens that more than one set has: products of 0/1 matrices for common ones, the pairs of their sets for rare ones."""
    sets = left + (right or [])
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    count = np.diff(np.append(first, len(flat)))
    n, m = len(left), len(right) if right is not None else len(left)
    out = np.zeros((n, m), np.float32)
    rare = np.where(count < max(2, len(sets) // 10), count, 0)
    for c in np.unique(rare[rare > 1]).tolist():
        own = row[first[rare == c][:, None] + np.arange(c)]
        for at in range(0, len(own), step := max(1, (1 << 20) // (c * c))):
            i, j = (np.broadcast_to(x, (len(own[at : at + step]), c, c)).ravel() for x in (own[at : at + step, :, None], own[at : at + step, None, :]))
            if right is not None:
                cross = (i < n) & (j >= n)
                i, j = i[cross], j[cross] - n
            np.add.at(out.ravel(), i * m + j, np.float32(1))
    common = np.flatnonzero((count > 1) & (rare == 0))
    for at in range(0, len(common), columns):
        some = common[at : at + columns]
        matrix = np.zeros((len(sets), len(some)), np.float32)
        k = count[some]
        place = np.repeat(first[some] - np.cumsum(k) + k, k) + np.arange(k.sum())
        matrix[row[place], np.repeat(np.arange(len(some)), k)] = 1
        out += matrix[:n] @ (matrix[n:] if right is not None else matrix).T
    return out


FOUND = "node binary, links long, texts long, to binary, open boolean"
BLOCK = "root binary, own int, parts int, nodes array<binary>, w array<long>, sizes array<int>, tokens binary"
BLOCK_KINDS = [pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
FOUND_KINDS = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]


def _batch(rows: list[tuple], kinds: list, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])


class Linker:
    """Links among the sets of one block, or between those of two, by exact comparison."""

    def __init__(self, threshold: float):
        t = Fraction(str(threshold))
        self.p, self.q = t.numerator, t.denominator

    def _near(self, left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
        both = intersections(left, right).astype(np.int64)
        a, b = (np.array([len(x) for x in s], np.int64) for s in (left, left if right is None else right))
        return (self.p + self.q) * both >= self.p * (a[:, None] + b[None, :])

    def rows(self, nodes: list[list[bytes]], w: list[list[int]], tokens: list[list[np.ndarray]], open_: bool) -> list[tuple]:
        """FOUND rows; one block's own links, or with a second block only those between both."""
        names = [x for own in nodes for x in own]
        n, total = len(nodes[0]), np.concatenate([np.array(x, np.int64) for x in w])
        near = np.zeros((len(names), len(names)), bool)
        if len(nodes) == 1:
            near = self._near(tokens[0], None)
            np.fill_diagonal(near, False)
        else:
            near[:n, n:] = self._near(*tokens)
            near |= near.T
        root = _roots(((i, np.flatnonzero(near[i, i + 1 :]) + i + 1) for i in range(len(names))), len(names)) if near.sum() < 8 * len(names) else _spread(near)
        links, texts = near @ total, near.sum(axis=1)
        return [(names[i], int(links[i]), int(texts[i]), names[root[i]], open_) for i in range(len(names))]


def verified(members: DataFrame, docs: DataFrame, threshold: float, words: int) -> DataFrame:
    """Exact links among the sets of each candidate component (node, root, id, w, n): rows (node, links, texts, to, open).

    links and texts: documents and different sets linked with the node in one cell; to: the first set of the node's component
    in the cell; open: whether the component has other cells. Small components are compared at once. Sets of large ones are
    gathered in blocks, one row each, and pairs of blocks are compared: a component of k sets takes k rows of sets and
    (k / CELL_SETS) squared rows of blocks.
    """
    size = members.groupBy("root").agg(F.count("*").alias("sets"), F.sum(F.col("n").cast("long")).alias("total"))
    parts = F.greatest(F.ceil(F.col("sets") / CELL_SETS), F.ceil(F.col("total") / CELL_SHINGLES)).cast("int")
    n = members.count()
    placed = join_hot(members, size.select("root", parts.alias("parts"), "sets"), "root", "sets", n)
    # Only texts that may be members are moved.
    some = maybe_in(docs.select(_id(), "text"), "id", members.select("id"), n).where("_maybe").drop("_maybe")
    rows = some.join(placed, "id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in textvec.chunks([len(t or "") for t in texts], 1 << 19):
                h, begin = shingles(texts[a:b], words)
                own = [np.unique(h[begin[i] : begin[i + 1]]) for i in range(b - a)]
                nodes = batch.column("node").slice(a, b - a).to_pylist()
                # Rows of one id may have different texts: only the one of this set counts.
                keep = [i for i in range(b - a) if len(own[i]) and digest(own[i]) == nodes[i]]
                if keep:
                    part = batch.slice(a, b - a).take(pa.array(keep))
                    yield pa.RecordBatch.from_arrays([part.column("root"), part.column("node"), part.column("w"), part.column("parts"), pa.array([own[i].tobytes() for i in keep], pa.binary())], names=["root", "node", "w", "parts", "tokens"])

    s = rows.select("text", "root", "node", "w", "parts").mapInArrow(tidy(sets), "root binary, node binary, w long, parts int, tokens binary")
    s = s.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("cell", F.md5(F.concat(F.hex("root"), F.lit("-"), "own").cast("binary")))
    linker = Linker(threshold)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of components of one part; one row for each part of the others."""
        held: list[tuple] = []
        none = (None,) * len(BLOCK_KINDS)
        for g in groups(batches, "cell"):
            seen: dict[bytes, int] = {}
            for i, x in enumerate(g.column("node").to_pylist()):
                seen.setdefault(x, i)
            at = list(seen.values())
            raw = [g.column("tokens")[i].as_py() for i in at]
            w = g.column("w").to_numpy()[at].tolist()
            parts = g.column("parts")[0].as_py()
            if parts == 1:
                held += [x + none for x in linker.rows([list(seen)], [w], [[np.frombuffer(x, np.uint64) for x in raw]], False)]
            else:
                held.append((None,) * len(FOUND_KINDS) + (g.column("root")[0].as_py(), g.column("own")[0].as_py(), parts, list(seen), w, [len(x) // 8 for x in raw], b"".join(raw)))
            if parts > 1 or len(held) > 20_000:
                yield _batch(held, FOUND_KINDS + BLOCK_KINDS, f"{FOUND}, {BLOCK}")
                held = []
        if held:
            yield _batch(held, FOUND_KINDS + BLOCK_KINDS, f"{FOUND}, {BLOCK}")

    first = cut(s.repartition("cell").sortWithinPartitions("cell").mapInArrow(tidy(gather), f"{FOUND}, {BLOCK}"))
    done, blocks = first.where("node IS NOT NULL").select(*(x.split()[0] for x in FOUND.split(", "))), first.where("root IS NOT NULL").select(*(x.split()[0] for x in BLOCK.split(", ")))
    if blocks.isEmpty():
        return done
    pairs = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    pairs = pairs.withColumn("cell", F.md5(F.concat_ws("-", F.hex("root"), "low", "high").cast("binary"))).select("cell", "own", "low", "high", "nodes", "w", "sizes", "tokens")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, "cell"):
            own = g.drop_columns(["cell"]).to_pylist()
            tokens = [np.split(np.frombuffer(b["tokens"], np.uint64), np.cumsum(b["sizes"])[:-1]) for b in own]
            # A part without sets has no block, so a pair with it has only one.
            if len(own) == 1 + (own[0]["low"] != own[0]["high"]):
                yield _batch(linker.rows([b["nodes"] for b in own], [b["w"] for b in own], tokens, True), FOUND_KINDS, FOUND)

    return done.unionByName(cut(pairs.repartition("cell").sortWithinPartitions("cell", "own").mapInArrow(tidy(compare), FOUND)))


def _spread(near: np.ndarray) -> np.ndarray:
    """The first member of each one's component, of a dense adjacency matrix."""
    root = np.arange(len(near))
    todo = np.ones(len(near), bool)
    for i in range(len(near)):
        if not todo[i]:
            continue
        inside = np.zeros(len(near), bool)
        edge = np.array([i])
        inside[i] = True
        while len(edge):
            new = near[edge].any(axis=0) & ~inside
            inside |= new
            edge = np.flatnonzero(new)
        root[inside] = i
        todo &= ~inside
    return root


def _classified(docs: DataFrame, threshold: float, words: int, recall: float) -> DataFrame:
    """id, node of every row with class_id, n_links, n_text_links and head: whether its set is the one by which the class has its id."""
    runs, equal = runs_for(recall, threshold), least_equal(recall, threshold)
    base = cut(signed(docs, runs, words))
    with_set = base.where(F.col("node").isNotNull())
    nodes = with_set.groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("w"), F.any_value("n").alias("n"), F.any_value("roots").alias("roots"), F.any_value("sketch").alias("sketch"))
    total = base.count()
    nodes = cut(nodes.coalesce(_parts(total, NODE_ROWS)))
    cells, linked = buckets(nodes, runs, equal)
    relieve(docs.sparkSession)
    near = components(candidate_edges(cells, nodes, equal).unionByName(linked))
    members = cut(near.join(nodes.select("node", "id", "w", "n"), "node").coalesce(_parts(total, NODE_ROWS)))
    found = verified(members, docs, threshold, words)
    relieve(docs.sparkSession)
    sums = found.groupBy("node").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    root = found.where(~F.col("open")).select("node", F.col("to").alias("class"))
    spread = found.where("open").select(F.col("node").alias("a"), F.col("to").alias("b"))
    if not spread.isEmpty():
        root = root.unionByName(components(spread).select("node", F.col("root").alias("class")))
    known = nodes.select("node", "id", "w").join(sums, "node", "left").join(root, "node", "left").withColumn("class", F.coalesce("class", "node"))
    known = cut(known.coalesce(_parts(total, NODE_ROWS)))
    first = known.groupBy("class").agg(F.min(F.struct("id", "node")).alias("first"), F.count("*").alias("k"))
    known = join_hot(known, first, "class", "k", total).select("node", F.col("first.id").alias("class_id"), (F.col("node") == F.col("first.node")).alias("head"), "w", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("texts", F.lit(0)).cast("long").alias("n_text_links"))
    return join_hot(base.select("id", "node"), cut(known.coalesce(_parts(total, NODE_ROWS))), "node", "w", total, "left")


def classify(docs: DataFrame, *, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links, n_text_links of every row: rows with Jaccard similarity of at least ``threshold`` are linked.

    Sets are of shingles of ``words`` lower-case words between blanks; a shorter text is one shingle. class_id is the smallest
    id of all rows linked directly or through others; n_links counts linked rows (equal sets included), n_text_links linked
    sets other than the row's own. Null, empty and blank texts have no shingle: they are linked to nothing and are their own
    class. Rows that repeat an id count as rows; null ids count as one id below all others and come back null. Other columns
    are not read; an empty table gives an empty one.
    """
    out = _classified(docs, threshold, words, recall)
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(real("id").alias("doc_id"), F.when(F.col("node").isNull(), real("id")).otherwise(real("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_text_links", F.lit(0)).cast("long").alias("n_text_links"))


def with_node(docs: DataFrame, words: int) -> DataFrame:
    """docs with _node, as in signed()."""
    at, names = docs.columns.index("text"), [*docs.columns, "_node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, b in textvec.chunks([len(t or "") for t in texts], 1 << 19):
                h, begin = shingles(texts[a:b], words)
                own = [np.unique(h[begin[i] : begin[i + 1]]) for i in range(b - a)]
                nodes = pa.array([digest(x) if len(x) else None for x in own], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, nodes], names=names)

    return small_batches(docs).mapInArrow(tidy(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", _node binary")


def first_of_each_class(docs: DataFrame, *, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """One row of each class by id, set and text, with all columns; of rows without a shingle that repeat an id and text, one."""
    first = F.col("node").isNull() | (F.col("head") & (F.col("id") == F.col("class_id")))
    rows = cut(_classified(docs, threshold, words, recall).select("id", "node", first.alias("first")))
    ids = rows.groupBy(F.col("id").alias("_id")).agg(F.bool_or("first").alias("_first"), F.count("*").alias("_rows"))
    # Ids of one row, the first of its class, stay as they are, wherever they stand; only rows of other ids are moved.
    others = cut(ids.where("NOT _first OR _rows > 1"))
    n = others.count()
    all_rows = maybe_in(docs.withColumn("_id", _id()), "_id", others.select("_id"), n)
    plain, moved = all_rows.where("NOT _maybe").drop("_maybe"), all_rows.where("_maybe").drop("_maybe")
    stay = plain.unionByName(moved.join(others.select("_id"), "_id", "left_anti")).select(*docs.columns)
    mixed = others.where("_first AND _rows > 1").select("_id")
    if mixed.isEmpty():
        return stay
    # Rows that share an id, as null ids do, are told apart by their sets.
    heads = rows.where("first").join(mixed.select(F.col("_id").alias("id")), "id").select(F.col("id").alias("_of"), F.col("node").alias("_set")).distinct()
    shared = with_node(moved.join(mixed, "_id"), words)
    shared = shared.join(heads, (F.col("_id") == F.col("_of")) & F.col("_node").eqNullSafe(F.col("_set")), "left_semi")
    order = Window.partitionBy("_id", "_node", F.when(F.col("_node").isNull(), F.col("text"))).orderBy("text")
    shared = shared.withColumn("_place", F.row_number().over(order)).where("_place = 1")
    return stay.unionByName(shared.select(*docs.columns))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"))
