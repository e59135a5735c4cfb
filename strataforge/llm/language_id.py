"""Language identification: words by log frequency, unseen words by ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataforge.llm import textvec
from strataforge.llm.common import small_batches, table, tidy

UNKNOWN = "und"
#: The model is fitted on so many labelled rows of each language in expectation, drawn by a hash of the id.
FIT_ROWS = 2000
#: Words and n-grams of each order that a language's model holds at most, the most frequent ones; a model grows with its
#: languages alone.
MOST_WORDS, MOST_GRAMS = 20_000, 8_000
LONGEST = 5
#: Counts below are not learned.
LEAST = 2
WORD = re.compile(r"[^\W\d_]+")
#: Texts with other characters than these are split by WORD; the rest by their bytes, where letters are a-z and all above ASCII.
OTHER = re.compile(r"[^\x00-\x7fÀ-ÖØ-öø-ÿ]")
#: Numbers that a worker remembers for unseen words, bytes of text split at a time, and numbers added up at a time.
CACHE, AT_ONCE, SUMS = 1 << 20, 1 << 19, 1 << 22


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word between blanks."""
    w = f" {word} "
    return [w[i : i + n] for i in range(len(w) - n + 1)]


TIMES = np.random.default_rng(55).integers(1, 1 << 63, LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hash(chars: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n characters from each place on."""
    h = np.zeros(len(at), np.uint64)
    for t in range(n):
        h = textvec.mix(h ^ chars[at + t] * TIMES[t])
    return h


class Model:
    """Per-language log frequencies of words and of n-grams of each order, kept sparse.

    An item's log frequency in a language is that of an item never seen there (``floors``), and log(2 n + 1) more for n
    occurrences; only the latter are kept for each item.
    """

    def __init__(self, langs: list[str], tables: list[dict[str, dict[str, int]]]):
        """tables: of words, then of n-grams from the longest to single characters; each language's counts by item."""
        self.langs = langs
        self.rows, self.items, self.floors = zip(*(self._items(t) for t in tables), strict=True)
        self.start = None

    def _items(self, counts: dict[str, dict[str, int]]) -> tuple[dict[str, int], tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        names = sorted({x for c in counts.values() for x in c})
        row = {x: i for i, x in enumerate(names)}
        found = [(row[x], j, n) for j, lang in enumerate(self.langs) for x, n in counts.get(lang, {}).items()]
        r, lang, n = (np.array(c, np.int64) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        total = 0.5 * len(names) + np.bincount(lang, weights=n, minlength=len(self.langs))
        order = np.argsort(r, kind="stable")
        begin = np.concatenate(([0], np.cumsum(np.bincount(r, minlength=len(names)))))
        return row, (begin, lang[order], np.log(2.0 * n[order] + 1)), np.log(0.5 / np.maximum(total, 0.5))

    def __getstate__(self) -> tuple:
        """Workers get hashes of items in place of the items."""
        self._forget()
        return self.langs, self.items, self.floors, self.start, self.grams

    def __setstate__(self, state: tuple) -> None:
        self.langs, self.items, self.floors, self.start, self.grams = state
        self._forget()

    def _forget(self) -> None:
        """Only the known words are left: their hashes in order, where their numbers begin, how many they are, and their table."""
        if self.start is None:
            names = list(self.rows[0])
            data, begins = textvec.joined([x.encode() for x in names])
            hashes = textvec.span_hash(data, begins[:-1], begins[1:] - 1)
            order = np.argsort(hashes)
            begin, lang, more = self.items[0]
            self.start = hashes[order], begin[:-1][order], np.diff(begin)[order], np.zeros(len(names), np.int64), lang, more
            self.grams: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
            for k in range(1, len(self.rows)):
                n = LONGEST - k + 1
                chars = np.frombuffer("".join(self.rows[k]).encode("utf-32-le"), np.uint32).astype(np.uint64)
                h = gram_hash(chars, np.arange(0, len(chars), n), n)
                order = np.argsort(h)
                self.grams.append((h[order], order))
        self.hashes, self.begin, self.count, self.table, self.lang, self.more = self.start

    def _backed_off(self, found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each word its table, how many numbers it has, and all their languages and values: the mean of its known n-grams of the greatest order that has any, else of no table."""
        langs = len(self.langs)
        chars = np.frombuffer(f" {' '.join(found)} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
        size = np.array([len(w) for w in found], np.int64) + 2
        first = np.cumsum(size - 1) - (size - 1)  # each word's first blank is the last one of the word before
        table, total, known = np.full(len(found), len(self.items)), np.zeros((len(found), langs)), np.zeros(len(found), np.int64)
        for n in range(LONGEST, 0, -1):
            k = LONGEST - n + 1
            hashes, order = self.grams[k]
            todo = np.flatnonzero((table == len(self.items)) & (size >= n))
            if not len(todo) or not len(hashes):
                continue
            windows = size[todo] - n + 1
            upto = np.cumsum(windows)
            at = np.repeat(first[todo] - upto + windows, windows) + np.arange(upto[-1])
            of = np.repeat(todo, windows)
            h = gram_hash(chars, at, n)
            place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[place] == h
            row, of = order[place[hit]], of[hit]
            begin, lang, more = self.items[k]
            count = begin[row + 1] - begin[row]
            ends = np.cumsum(count)
            entry = np.repeat(begin[row] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)
            total += np.bincount(np.repeat(of, count) * langs + lang[entry], weights=more[entry], minlength=total.size).reshape(total.shape)
            known += np.bincount(of, minlength=len(found))
            table[of] = k
        total /= np.maximum(known, 1)[:, None]
        word, lang = np.nonzero(total)
        return table, np.bincount(word, minlength=len(found)), lang, total[word, lang]

    def _learn(self, hashes: np.ndarray, found: list[str]) -> None:
        """Remembers words not known."""
        each = max(1, SUMS // max(1, len(self.langs)))
        got = [self._backed_off(found[a:b]) for a, b in textvec.chunks([each // 4096 + len(w) for w in found], each)]
        table, count, lang, more = (np.concatenate(c) for c in zip(*got, strict=True))
        begin = len(self.lang) + np.cumsum(count) - count
        self.lang, self.more = np.concatenate([self.lang, lang]), np.concatenate([self.more, more])
        at = np.searchsorted(self.hashes, hashes)
        new = hashes, begin, count, table
        self.hashes, self.begin, self.count, self.table = (np.insert(old, at, x) for old, x in zip((self.hashes, self.begin, self.count, self.table), new, strict=True))

    def _means(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The number of words, and the mean of their log frequencies in each language, of each text."""
        data, begins = textvec.joined(texts)
        data = data.copy()
        data[(data >= 65) & (data <= 90) | (data >= 128) & (data < 159) & (data != 151) & (np.concatenate(([0], data[:-1])) == 0xC3)] += 32
        starts, ends = textvec.runs((data >= 97) & (data <= 122) | (data >= 128))
        hashes, where, inverse = np.unique(textvec.span_hash(data, starts, ends), return_index=True, return_inverse=True)
        if self.start is None or len(self.lang) > len(self.start[4]) + CACHE or len(self.hashes) > len(self.start[0]) + CACHE:
            self._forget()
        at = np.searchsorted(self.hashes, hashes)
        new = np.ones(len(hashes), bool)
        new[at < len(self.hashes)] = self.hashes[at[at < len(self.hashes)]] != hashes[at < len(self.hashes)]
        if new.any():
            raw = data.tobytes()
            self._learn(hashes[new], [raw[starts[j] : ends[j]].decode() for j in where[new].tolist()])
        slot = np.searchsorted(self.hashes, hashes)[inverse]
        text = np.searchsorted(begins, starts, "right") - 1
        tables, langs = len(self.items) + 1, len(self.langs)
        by_table = np.bincount(text * tables + self.table[slot], minlength=len(texts) * tables).reshape(-1, tables)
        total = np.zeros((len(texts), langs))
        for k, floor in enumerate(self.floors):
            total += by_table[:, k, None] * floor
        count = self.count[slot]
        upto = np.concatenate(([0], np.cumsum(count)))
        edges = np.searchsorted(upto, np.arange(0, upto[-1], SUMS)).tolist() + [len(slot)]
        for a, b in zip(edges, edges[1:], strict=False):
            place = np.repeat(self.begin[slot[a:b]] - upto[a:b], count[a:b]) + np.arange(upto[a], upto[b])
            into = np.repeat(text[a:b], count[a:b]) * langs + self.lang[place]
            total += np.bincount(into, weights=self.more[place], minlength=total.size).reshape(total.shape)
        n = by_table.sum(axis=1)
        return n, total / np.maximum(n, 1)[:, None]

    def predictions(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The best language and its share for each text: the softmax of mean log frequencies over words."""
        out = [(UNKNOWN, 0.0)] * len(texts)
        if not self.langs:
            return out
        ready, at = [], []
        for i, t in enumerate(texts):
            if t and OTHER.search(t):
                found = words(t)
                t = " ".join(found) if any(c.isalpha() for w in found for c in w) else ""
            if t:
                ready.append(t.encode("utf-8", "surrogatepass"))
                at.append(i)
        for a, b in textvec.chunks([len(t) for t in ready], AT_ONCE):
            n, mean = self._means(ready[a:b])
            best = np.argmax(mean, axis=1)
            share = 1 / np.exp(mean - mean[np.arange(len(best)), best][:, None]).sum(axis=1)
            for i, some, j, x in zip(at[a:b], n.tolist(), best.tolist(), share.tolist(), strict=True):
                if some:
                    out[i] = self.langs[j], x
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predictions([text])[0]


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; not so for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, *, rows: int = FIT_ROWS, most_words: int = MOST_WORDS, most_grams: int = MOST_GRAMS, most_langs: int | None = None) -> Model:
    """Learns from text and lang of rows that are not held out, from a sample of bounded expected size for each language.

    All languages are learned, or on request the ``most_langs`` with the most rows. A language takes ``most_words`` and
    LONGEST times ``most_grams`` items of the driver's and each worker's memory at most.
    """
    known = small_batches(docs).where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = known.groupBy("lang").count().orderBy(F.desc("count"), "lang")
    n = {r["lang"]: r["count"] for r in (counted if most_langs is None else counted.limit(most_langs)).collect()}
    if not n:
        return Model([], [{} for _ in range(LONGEST + 1)])
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, rows / c)) for lang, c in n.items()], "lang string, _share double")
    drawn = known.select("lang", "text", (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(1 << 30)).alias("_at"))
    drawn = drawn.join(F.broadcast(shares), "lang").where("_at < _share").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[Counter]] = {}

        def out() -> pa.RecordBatch:
            flat = [(lang, k, x, n) for lang, tables in held.items() for k, t in enumerate(tables) for x, n in t.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*flat, strict=True), (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["lang", "k", "item", "n"])

        for batch in batches:
            by_lang: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, Counter()).update(words(text))
            for lang, seen in by_lang.items():
                tables = held.setdefault(lang, [Counter() for _ in range(LONGEST + 1)])
                for w, c in seen.items():
                    tables[0][w] += c
                    for k in range(1, LONGEST + 1):
                        for g in grams(w, LONGEST + 1 - k):
                            tables[k][g] += c
            if sum(len(t) for tables in held.values() for t in tables) > 500_000:
                yield out()
        if any(t for tables in held.values() for t in tables):
            yield out()

    counted = drawn.mapInArrow(tidy(count), "lang string, k int, item string, n long").groupBy("lang", "k", "item").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    # What reaches the driver is bounded: so many items of each language and table.
    most = F.when(F.col("k") == 0, most_words).otherwise(most_grams)
    place = F.row_number().over(Window.partitionBy("lang", "k").orderBy(F.desc("n"), "item"))
    best = counted.withColumn("place", place).where((F.col("place") <= max(most_words, most_grams)) & (F.col("place") <= most)).drop("place").toPandas()
    tables: list[dict[str, dict[str, int]]] = [{} for _ in range(LONGEST + 1)]
    for (lang, k), g in best.groupby(["lang", "k"]):
        tables[k][lang] = dict(zip(g.item.tolist(), g.n.tolist(), strict=True))
    return Model(sorted(n), tables)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Every row with held_out, lang_pred and score.

    Only the text decides. Null texts and texts without a letter are ``und`` with score 0, and so is all where nothing can be
    learned. Equal texts get equal results; equal scores go to the language first by code point. All columns of docs
    pass (lang_pred, score and held_out are replaced); an empty table gives an empty one.
    """
    model = model or fit(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = small_batches(docs).drop("held_out", "lang_pred", "score")
    at = docs.columns.index("text")
    names = [*docs.columns, "held_out", "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            got = m.predictions(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", held_out boolean, lang_pred string, score double"
    return docs.withColumn("held_out", held_out() if "doc_id" in docs.columns else F.lit(False)).mapInArrow(tidy(run), schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs.select("doc_id", "text"), fit(docs)).select("doc_id", "held_out", "lang_pred", "score")
