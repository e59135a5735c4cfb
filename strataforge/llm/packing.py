"""Vector bin packing of documents into fixed-length sequences."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.llm import textvec
from strataforge.llm.common import small_batches, table, tidy

SEQUENCE, END_ID = 4096, 2
#: A sequence holds at most so many pieces, and so many tokens that bear loss.
MAX_SEGMENTS, MAX_LOSS = 32, 2560
#: So many characters or documents are packed together; what they leave over is cut into powers of two, so nothing is lost at the edges.
GROUP_CHARS, GROUP_DOCS = 1 << 22, 2048
#: Words whose ids a worker remembers.
CACHE = 1_200_000

#: Texts of these characters alone, outside what may be a special token or a contraction, are split by their bytes: there lower case and NFC act on each letter alone. Others go through the whole tokenizer, word by word.
UNSAFE = re.compile(r"[^\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ÿ]|<\||'[a-zA-Z]")
#: Bytes split by numpy at a time.
AT_ONCE = 1 << 19

LETTER, DIGIT, OTHER, BLANK = 0, 1, 2, 3
KIND = np.full(256, OTHER, np.uint8)
KIND[[*range(97, 123), *range(128, 256)]] = LETTER
KIND[[*range(48, 58)]] = DIGIT
KIND[[32, *range(9, 14)]] = BLANK


class WordTokenizer:
    """Token ids of whole texts, each distinct word encoded once.

    The vocabulary never joins what white space parts, and the ids of a word (a run of letters, a digit, a run of
    other signs) don't depend on its neighbours, so a text's ids are those of its words in order.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        # Byte-level vocabularies write a byte that prints as itself and the others, in order, from 256 on.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.as_char = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.chunks: dict[str, np.ndarray] = {}
        self._forget()

    def _forget(self) -> None:
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Encodes words not seen before."""
        tokenize, as_char = self.model.tokenize, self.as_char
        ids = [[t.id for t in tokenize(w.decode("latin-1") if w.isalpha() else w.decode("latin-1").translate(as_char))] for w in words]
        n = len(self.keys)
        while n + len(words) > len(self.begin):
            self.begin, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count))
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        self.count[n : n + len(ids)] = counts
        self.begin[n : n + len(ids)] = self.used + np.cumsum(counts) - counts
        new = np.fromiter((i for x in ids for i in x), np.uint32, int(counts.sum()))
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(new)] = new
        self.used += len(new)
        at = np.searchsorted(self.keys, hashes)
        self.keys, self.values = np.insert(self.keys, at, hashes), np.insert(self.values, at, np.arange(n, n + len(ids)))

    def _plain(self, texts: list[bytes]) -> list[np.ndarray]:
        data, begins = textvec.joined(texts)
        data = data.copy()
        upper = (data >= 65) & (data <= 90)
        accented = (data >= 128) & (data < 159) & (np.concatenate(([0], data[:-1])) == 0xC3)
        data[upper | accented] += 32
        kind = KIND[data]
        first = kind != BLANK
        first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        starts = np.flatnonzero(first)
        last = kind != BLANK
        last[:-1] &= (kind[1:] != kind[:-1]) | (kind[:-1] == DIGIT)
        ends = np.flatnonzero(last) + 1
        hashes, where, inverse = np.unique(textvec.span_hash(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE:
            self._forget()
        at = np.searchsorted(self.keys, hashes)
        new = np.ones(len(hashes), bool)
        new[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] != hashes[at < len(self.keys)]
        if new.any():
            raw = data.tobytes()
            self._learn(hashes[new], [raw[starts[j] : ends[j]] for j in where[new].tolist()])
        word = self.values[np.searchsorted(self.keys, hashes)][inverse]
        counts = self.count[word]
        sums = np.concatenate(([0], np.cumsum(counts)))
        ids = self.flat[np.repeat(self.begin[word] - sums[:-1], counts) + np.arange(sums[-1])]
        return np.split(ids, sums[np.searchsorted(starts, begins[1:-1])]) if len(texts) > 1 else [ids]

    def _chunk(self, chunk: str) -> np.ndarray:
        if chunk not in self.chunks:
            if len(self.chunks) > CACHE // 20:
                self.chunks.clear()
            self.chunks[chunk] = np.array(self.whole.encode(chunk, add_special_tokens=False).ids, np.uint32)
        return self.chunks[chunk]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if not UNSAFE.search(t)]
        coded = [texts[i].encode() for i in plain]
        for a, b in textvec.chunks([len(x) for x in coded], AT_ONCE):
            for i, ids in zip(plain[a:b], self._plain(coded[a:b]), strict=True):
                out[i] = ids
        for i, t in enumerate(texts):
            if out[i] is None:
                words = re.split(r"[ \t\n\r]+", t)
                odd = [bool(UNSAFE.search(w)) for w in words]
                easy = iter(self._plain([w.encode() for w, o in zip(words, odd, strict=True) if not o] or [b""]))
                out[i] = np.concatenate([self._chunk(w) if o else next(easy) for w, o in zip(words, odd, strict=True)])
        return out


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process, kept between tasks."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def _powers(n: int) -> list[int]:
    """The powers of two whose sum n is, largest first."""
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


def pack_group(tokens: np.ndarray, loss: np.ndarray, length: int = SEQUENCE, segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS) -> list[list[tuple[int, int, int]]]:
    """Sequences, each a list of (item, start, length), of all items, none empty.

    The open sequence takes the item with the greatest dot product of its needs (tokens, loss-bearing
    tokens, one segment, each a share of its limit) with what is left of the limits, among those that fit.
    When none fits, the one of which most fits is cut to fill the sequence. Where the segment or loss limit closes a
    sequence early, it keeps a power of two, which needs no padding, and the rest goes back; the last one is
    cut to powers of two. An item's loss-bearing tokens count as spread evenly over it.
    """
    tokens, loss = tokens.astype(np.int64), loss.astype(np.int64)
    start, left = np.zeros(len(tokens), np.int64), tokens.copy()
    share = loss / np.maximum(tokens, 1)
    out: list[list[tuple[int, int, int]]] = []
    limits = np.array([length, max_loss, segments], float)
    for i in np.flatnonzero((left >= length) & (share * length <= max_loss)):
        whole = int(left[i] // length)
        out += [[(int(i), k * length, length)] for k in range(whole)]
        start[i], left[i] = whole * length, left[i] - whole * length
    alive = np.flatnonzero(left > 0)
    alive = alive[np.argsort(-left[alive], kind="stable")]
    while len(alive):
        room, now = limits.copy(), []
        while len(alive) and room[0] >= 1 and room[2] >= 1:
            need_t, need_l = left[alive], np.ceil(share[alive] * left[alive])
            fits = (need_t <= room[0]) & (need_l <= room[1])
            if fits.any():
                score = need_t * (room[0] / limits[0] ** 2) + need_l * (room[1] / limits[1] ** 2) + room[2] / limits[2] ** 2
                at = int(np.argmax(np.where(fits, score, -1.0)))
                take = int(need_t[at])
            else:
                # Cut the item that fills most of what is left, the largest among equals.
                s = share[alive]
                upto = np.minimum(np.minimum(need_t, room[0]), np.where(s > 0, np.floor(room[1] / np.maximum(s, 1e-12)), room[0]))
                at = int(np.argmax(upto))
                take = int(upto[at])
                if take < 1:
                    break
            i = int(alive[at])
            now.append((i, int(start[i]), take))
            start[i] += take
            left[i] -= take
            room -= (take, np.ceil(share[i] * take), 1)
            if left[i] == 0:
                alive = np.delete(alive, at)
            elif at + 1 < len(alive) and left[i] < left[alive[at + 1]]:
                alive = alive[np.argsort(-left[alive], kind="stable")]
        if not now:
            raise ValueError("an item bears more loss than a sequence may hold")
        used = sum(x[2] for x in now)
        if used == length:
            out.append(now)
            continue
        sizes = _powers(used)
        if len(alive):
            # What is beyond the largest power of two goes back: other items may fill a sequence with it.
            back = used - sizes[0]
            while back:
                i, s, n = now.pop()
                more = min(n, back)
                start[i], left[i], back = s + n - more, left[i] + more, back - more
                if more < n:
                    now.append((i, s, n - more))
            alive = np.flatnonzero(left > 0)
            alive = alive[np.argsort(-left[alive], kind="stable")]
            sizes = sizes[:1]
        for size in sizes:
            part: list[tuple[int, int, int]] = []
            while size:
                i, s, n = now[0]
                take = min(n, size)
                part.append((i, s, take))
                now[0] = (i, s + take, n - take)
                size -= take
                if take == n:
                    now.pop(0)
            out.append(part)
    return out


def pack(items: DataFrame, *, path: str | None = None, length: int = SEQUENCE, segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, id_col: str = "doc_id", text_col: str = "text", loss_share: Column | None = None) -> DataFrame:
    """Pieces of all rows in sequences of at most ``length`` tokens, none of which needs padding.

    Every row gets its text's ids and one end id. loss_share: the share of a row's tokens that bear loss, as an expression of
    its columns (default: answer_share() of the text; null counts as 0), taken as spread evenly over the row.
    Null and empty texts are the end id alone; repeated rows are packed each; null ids stay null; other columns are
    not read. Each task packs what it reads, in groups of bounded size, so no row is shuffled and no key gathers;
    a sequence's id is its task's number and its place there, the same when a task runs again.
    """
    path = path or word_vocabulary()
    share = answer_share(F.col(text_col)) if loss_share is None else loss_share
    cols = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(share.cast("double"), F.lit(0.0)))).alias("share")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = tokenizer(path)
        end = np.array([END_ID], np.uint32)
        task, done = TaskContext.get().partitionId(), 0

        def packed(docs: list, texts: list, shares: list) -> pa.RecordBatch:
            nonlocal done
            ids = [np.concatenate([x, end]).astype("<u4") for x in encode([t or "" for t in texts])]
            n = np.array([len(x) for x in ids], np.int64)
            loss = np.floor(np.array(shares) * n).astype(np.int64)
            rows: list[tuple] = []
            for piece in pack_group(n, loss, length, segments, max_loss):
                at, seq = 0, (task << 36) + done
                done += 1
                for i, s, k in piece:
                    rows.append((docs[i], s, k, zlib.crc32(ids[i][s : s + k]), len(ids[i]), seq, at))
                    at += k
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=NAMES)

        held: list[list] = [[], [], []]
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for h, x in zip(held, row, strict=True):
                    h.append(x)
                size += len(row[1] or "")
                if size >= GROUP_CHARS or len(held[0]) >= GROUP_DOCS:
                    yield packed(*held)
                    held, size = [[], [], []], 0
        if held[0]:
            yield packed(*held)

    return small_batches(items).select(*cols).mapInArrow(tidy(run), ", ".join(f"{c} long" for c in NAMES))


def answer_share(text: Column) -> Column:
    """The share of a text's characters in its even lines: a text is read as prompts and answers in turn, a line each, and answers bear loss."""
    answers = F.filter(F.split(text, "\n", -1), lambda x, i: i % 2 == 1)
    return F.length(F.array_join(answers, "")) / F.greatest(F.lit(1), F.length(text))


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
