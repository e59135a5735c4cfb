"""Media columns: byte payloads as animated GIFs, decoded to timed frames with colour histograms."""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.llm.common import small_batches, table, tidy

WIDTH, ROWS = 64, 1024
#: Hundredths of a second that a written frame shows.
DELAY = 10
#: Bins of a frame's histogram for each of red, green and blue.
BINS = 8
CLEAR, END = 256, 257


def lzw(data: bytes) -> bytes:
    """The usual greedy code stream, with codes of 9 to 12 bits and a clear code when the table is full."""
    # Codes stand 8 bits higher, so a code and a byte make a key in one step.
    codes, table, n = [CLEAR << 8], {}, CLEAR + 2 << 8
    put, it = codes.append, iter(data)
    w = next(it) << 8
    for b in it:
        k = w | b
        if k in table:
            w = table[k]
            continue
        put(w)
        if n == 4096 << 8:
            put(CLEAR << 8)
            table, n = {}, CLEAR + 2 << 8
        else:
            table[k] = n
            n += 256
        w = b << 8
    codes += [w, END << 8]
    # A clear code comes after 3,839 others: the first adds no entry, and 3,838 fill the table.
    widths = np.concatenate([[9], np.resize(_steps(8, 0, 4096 - CLEAR)[0], len(codes) - 1)])
    return _packed(np.array(codes, np.int64) >> 8, widths)


def unlzw(stream: bytes, bits: int, size: int) -> np.ndarray:
    """The ``size`` colour indexes of a code stream whose first codes are ``bits`` + 1 wide.

    Codes are cut out of the bytes in runs between clear codes, whose widths are known beforehand, and looked up one by
    one. Missing pixels are refused, more than ``size`` are an error of the writer and ignored.
    """
    if not 0 < bits < 9:
        raise ValueError("GIF: codes of no possible width")
    clear, end = 1 << bits, (1 << bits) + 1
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    known, out, made, prev = base[:], [], 0, b""
    every, total = np.frombuffer(stream + b"\0\0", np.uint8).astype(np.int64), 8 * len(stream)
    at, done, stop = 0, 0, -1  # the next code's first bit; codes read since the last clear code
    while made < size and stop != end:
        widths, ends = _steps(bits, min(done, 4096), 4096 if done else 512)
        n = int(np.searchsorted(ends, total - at, "right"))
        if not n:
            break
        starts = at + ends[:n] - widths[:n]
        low = starts >> 3
        codes = (every[low] | every[low + 1] << 8 | every[low + 2] << 16) >> (starts & 7) & (1 << widths[:n]) - 1
        signs = np.flatnonzero((codes == clear) | (codes == end))
        own = codes[: signs[0]].tolist() if len(signs) else codes.tolist()
        first, room = len(out), 4096 - len(known) + (not prev)
        put, grow = out.append, known.append
        try:
            for code in own[:room]:
                try:
                    now = known[code]
                except IndexError:
                    if not prev or code != len(known):
                        raise
                    now = prev + prev[:1]
                if prev:
                    grow(prev + now[:1])
                put(now)
                prev = now
            out += map(known.__getitem__, own[room:])
        except IndexError:
            if made + sum(map(len, out[first:])) < size:
                raise ValueError("GIF: a code that the table doesn't hold") from None
        made += sum(map(len, out[first:]))
        stop, at, done = -1, at + int(ends[n - 1]), done + n
        if len(signs):
            stop, at, done = int(codes[signs[0]]), int(starts[signs[0]] + widths[signs[0]]), 0
            known, prev = base[:], b""
    return _fit(np.frombuffer(b"".join(out), np.uint8), size)


def _widths(bits: int, first: int, n: int) -> np.ndarray:
    """Widths of the codes ``first`` to ``first + n`` after a clear code: they grow with the table, which has an entry more for each code but the first."""
    size = (1 << bits) + 2 + np.maximum(0, np.arange(first, first + n) - 1)
    return np.minimum(12, bits + 1 + sum((size >= 1 << w).astype(np.int64) for w in range(bits + 1, 12)))


@functools.lru_cache(64)
def _steps(bits: int, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """_widths(), and the bits up to the end of each code."""
    widths = _widths(bits, first, n)
    return widths, np.cumsum(widths)


def _packed(codes: np.ndarray, widths: np.ndarray) -> bytes:
    every = np.unpackbits(codes.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(every[np.arange(16) < widths[:, None]], bitorder="little").tobytes()


def _fit(a: np.ndarray, size: int) -> np.ndarray:
    if len(a) < size:
        raise ValueError("GIF: pixels are missing")
    return a[:size]


def _blocks(data: bytes) -> bytes:
    """Sub-blocks of at most 255 bytes, and the empty one that ends them."""
    full = len(data) // 255 * 255
    a = np.frombuffer(data[:full], np.uint8).reshape(-1, 255)
    out = np.concatenate([np.full((len(a), 1), 255, np.uint8), a], axis=1).tobytes()
    rest = data[full:]
    return out + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


#: The written palette: a colour of its own for each byte, so that histograms tell letters from signs and other bytes.
PALETTE = np.stack([np.arange(256), np.arange(256) * 37 % 256, np.arange(256) * 101 % 256], axis=1).astype(np.uint8)


def encode(payload: bytes, padding: int = 0) -> bytes:
    """A GIF of frames, 64 wide and at most 1024 high, whose samples are the payload's bytes (a positive multiple of 64).

    Frames are cleared before the next one (disposal 2). The last ``padding`` bytes, all 0, are written as transparent
    pixels where the last frame leaves a colour index unused; what shows through is the background, index 0.
    """
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0), PALETTE.tobytes()]
    out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00")
    for at in range(0, rows, ROWS):
        part, through = payload[at * WIDTH : (at + ROWS) * WIDTH], None
        if padding and at + ROWS >= rows:
            used = np.bincount(np.frombuffer(part, np.uint8), minlength=256)
            if not used.all():
                through = 255 - int(np.argmin(used[::-1] > 0))
                part = part[:-padding] + bytes([through]) * padding
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 2 << 2 | (through is not None), DELAY, through or 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0) + b"\x08")
        out.append(_blocks(lzw(part)))
    return b"".join(out) + b"\x3b"


def _gather(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def _deinterlaced(a: np.ndarray) -> np.ndarray:
    order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, len(a), step)]
    out = np.empty_like(a)
    out[order] = a
    return out


def frames(data: bytes) -> Iterator[dict]:
    """Each image of a GIF: the colour indexes as stored, its samples (the indexes, with the screen's background where they are transparent), and a copy of the canvas (height, width, red-green-blue-alpha) after it is drawn.

    Palettes are the image's own or else the screen's; transparent indexes leave the canvas as it is; disposal
    2 clears the image's place before the next one, 3 puts back what was there. Images out of the screen are cut.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, ground, _ = struct.unpack_from("<HHBBB", data, 6)
    at, screen = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        screen, at = np.frombuffer(data, np.uint8, 3 * n, at).reshape(-1, 3), at + 3 * n
    canvas = np.zeros((height, width, 4), np.uint8)
    clock, disposal, delay, through = 0, 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        kind, at = data[at], at + 1
        if kind == 0x21:
            label, at = data[at], at + 1
            body, at = _gather(data, at)
            if label == 0xF9 and len(body) >= 4:
                packed, delay, index = struct.unpack_from("<BHB", body)
                disposal, through = packed >> 2 & 7, index if packed & 1 else None
        elif kind == 0x2C:
            x, y, w, h, packed = struct.unpack_from("<HHHHB", data, at)
            at += 9
            palette = screen
            if packed & 0x80:
                n = 2 << (packed & 7)
                palette, at = np.frombuffer(data, np.uint8, 3 * n, at).reshape(-1, 3), at + 3 * n
            if palette is None:
                raise ValueError("GIF: an image without a palette")
            bits, at = data[at], at + 1
            stream, at = _gather(data, at)
            index = unlzw(stream, bits, w * h).reshape(h, w)
            if packed & 0x40:
                index = _deinterlaced(index)
            shown = index[: max(0, height - y), : max(0, width - x)]
            place = canvas[y : y + shown.shape[0], x : x + shown.shape[1]]
            before = place.copy() if disposal == 3 else None
            colours = np.full((256, 4), 255, np.uint8)
            colours[: len(palette), :3], colours[len(palette) :, :3] = palette, palette[-1]
            painted = colours.view("<u4").ravel()[shown]
            over = place.view("<u4")[..., 0]
            if through is None:
                over[...] = painted
            else:
                over[shown != through] = painted[shown != through]
            counts = _binned(np.bincount(shown.ravel(), minlength=256), colours) if through is None else histogram(place)
            samples = index if through is None else np.where(index == through, np.uint8(ground), index)
            yield {"index": index, "samples": samples, "canvas": canvas.copy(), "histogram": counts, "start_ms": clock, "delay_ms": 10 * delay, "disposal": disposal, "x": x, "y": y}
            clock += 10 * delay
            if disposal == 2:
                place[...] = 0
            elif disposal == 3:
                place[...] = before
            disposal, delay, through = 0, 0, None
        else:
            raise ValueError("GIF: an unknown block")


def _binned(counts: np.ndarray, colours: np.ndarray) -> list[int]:
    """histogram() of pixels given as counts of opaque colours."""
    return [int(n) for c in range(3) for n in np.bincount(colours[:, c] >> 5, weights=counts, minlength=BINS)]


def histogram(pixels: np.ndarray) -> list[int]:
    """Counts of opaque pixels in eight equal bins of red, then green, then blue."""
    flat = pixels.reshape(-1, 4)
    if not flat[:, 3].all():
        flat = flat[flat[:, 3] > 0]
    return [int(n) for c in range(3) for n in np.bincount(flat[:, c] >> 5, minlength=BINS)]


MEDIA = "doc_id long, n_bytes long, media binary"


def encode_texts(docs: DataFrame) -> DataFrame:
    """Each row's text (null: empty) in UTF-8, with bytes 0 up to a positive multiple of 64, as a GIF: doc_id, n_bytes, media.

    Rows are independent: repeated rows give equal media, null ids stay null, other columns are not read, an empty
    table gives an empty one. The payload's own length stands beside the media, as bytes 0 may end a text, too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or b""
                padding = -len(text) % WIDTH if text else WIDTH
                held.append((doc, len(text), encode(text + b"\0" * padding, padding)))
                size += len(held[-1][2])
                if size > 16 << 20:
                    yield _batch(held, MEDIA)
                    held, size = [], 0
            if held:
                yield _batch(held, MEDIA)

    return small_batches(docs).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(tidy(run), MEDIA)


ARROW = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "int": pa.int32()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split(" ") for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


FRAMES = "doc_id long, frame int, start_ms long, delay_ms long, disposal int, samples binary, histogram array<long>"


def decode_frames(media: DataFrame) -> DataFrame:
    """The timed frames of a media column: one row for each image, with its samples and what it drew as a histogram.

    Null and empty media have no frame, so no row; repeated rows give repeated frames; other columns are not read; an empty
    table gives an empty one. Bytes that are no GIF, or lack pixels, are an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(doc, k, f["start_ms"], f["delay_ms"], f["disposal"], f["samples"].tobytes(), f["histogram"]) for k, f in enumerate(frames(data or b""))] if data else []
                if rows:
                    yield _batch(rows, FRAMES)

    return media.select("doc_id", "media").mapInArrow(tidy(run), FRAMES)


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames int, shown_ms long"


def digests(media: DataFrame) -> DataFrame:
    """What the stored media of encode_texts() hold, read back image by image: lengths, digests and the summed histogram.

    Null media hold nothing: n_bytes stays, lengths and counts are 0, digests and feature null. Repeated rows give equal rows;
    null ids stay null; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, n, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if data is None:
                    rows.append((doc, n, 0, None, None, 0, None, None, 0, 0))
                    continue
                sha, total, size, count, shown, tail = hashlib.sha256(), np.zeros(3 * BINS, np.int64), 0, 0, 0, b""
                for f in frames(data):
                    part = f["samples"].tobytes()
                    sha.update(part)
                    tail = part[-64:]
                    total += f["histogram"]
                    size, count, shown = size + len(part), count + 1, shown + f["delay_ms"]
                feature = ",".join(map(str, total.tolist()))
                rows.append((doc, n, size, sha.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), feature, count, shown))
            if rows:
                yield _batch(rows, DIGESTS)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(tidy(run), DIGESTS)


def op9_media_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_texts(table(spark, sf_dir, "documents")))
