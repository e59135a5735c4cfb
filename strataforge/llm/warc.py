"""WARC archives in Zstandard: one frame for each record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.llm.common import cut, join_hot, maybe_in, scratch, small_batches, table, tidy

#: Fixed values of the format: magic of the skippable frame that holds the dictionary, of a frame, of a dictionary.
DICT_FRAME, FRAME, DICT = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
REVISIT_FROM = 100
#: An archive is closed once it has so many bytes.
ARCHIVE_BYTES = 32 << 20
#: The dictionary is fitted on so many payloads at most, each up to so many characters.
SAMPLE_PAGES, SAMPLE_CHARS, DICT_BYTES = 400, 16_384, 65_536
LEVEL = 3
RECORD_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def fit_dictionary(pages: DataFrame, payload: str = "html") -> bytes:
    """A Zstandard dictionary of a bounded sample of payloads, by a hash of the page's id; empty where there are too few to fit one."""
    some = pages.where(F.length(payload) > 0).select(F.xxhash64("page_id").alias("h"), F.substring(payload, 1, SAMPLE_CHARS).alias("p"))
    # The hashes first, which are short, then one payload for each of the smallest ones.
    least = [r.h for r in some.select("h").distinct().orderBy("h").limit(SAMPLE_PAGES).collect()]
    rows = some.where(F.col("h") <= least[-1]).groupBy("h").agg(F.min("p").alias("p")).orderBy("h").collect() if least else []
    samples = [r.p.encode() for r in rows]
    total = sum(map(len, samples))
    if len(samples) < 8 or total < 8192:
        return b""
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, total // 8), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(RECORD_ID, str(page_id))}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has the response's headers only; the length of the payload it stands for is in X-Payload-Length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}", f"X-Refers-To-Page: {'' if refers_to is None else refers_to}"]
    head += [f"X-Page: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of one record, after checks of its version, headers, lengths and, for a response, the payload's digest."""
    end = raw.find(b"\r\n\r\n")
    if end < 0 or not raw.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n")):
        raise ValueError("WARC: no version line or header end")
    head: dict[str, str] = {}
    for line in raw[:end].decode().split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in head:
            raise ValueError(f"WARC: bad header line {line[:60]!r}")
        head[name.lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - head.keys()
    if missing:
        raise ValueError(f"WARC: missing {sorted(missing)}")
    size = int(head["content-length"])
    if size < 0 or len(raw) != end + 4 + size + 4 or raw[-4:] != b"\r\n\r\n":
        raise ValueError("WARC: Content-Length differs from the block")
    http, gap, payload = raw[end + 4 : -4].partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise ValueError("WARC: no HTTP headers in the block")
    digest = head.get("warc-payload-digest", "").removeprefix("sha256:")
    kind = head["warc-type"]
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(head.get("x-payload-length", len(payload)))):
        raise ValueError("WARC: the payload doesn't match its digest or length")
    if kind == "revisit" and payload:
        raise ValueError("WARC: a revisit with a payload")
    number = lambda x: int(x) if x else None
    return {"page_id": number(head.get("x-page")), "url": head.get("warc-target-uri"), "record_type": kind, "payload_digest": digest, "payload_bytes": int(head.get("x-payload-length", len(payload))), "refers_to": number(head.get("x-refers-to-page")), "payload": payload if kind == "response" else None}


def records(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an archive that comes in blocks: one for each frame, whose stated size must hold."""
    data, at, ended = bytearray(), 0, False

    def fill(n: int) -> bool:
        nonlocal at, ended
        while len(data) - at < n and not ended:
            block = next(blocks, b"")
            ended = not block
            if at > 1 << 20:
                del data[:at]
                at = 0
            data.extend(block)
        return len(data) - at >= n

    dictionary = None
    if fill(8) and struct.unpack_from("<I", data, at)[0] == DICT_FRAME:
        size = struct.unpack_from("<I", data, at + 4)[0]
        if not fill(8 + size):
            raise ValueError("WARC: the dictionary frame is cut off")
        content = bytes(data[at + 8 : at + 8 + size])
        at += 8 + size
        if content[:4] == struct.pack("<I", FRAME):
            content = zstandard.ZstdDecompressor().decompress(content, max_output_size=64 << 20)
        if content[:4] != struct.pack("<I", DICT):
            raise ValueError("WARC: the leading frame holds no dictionary")
        dictionary = zstandard.ZstdCompressionDict(content)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while fill(4):
        magic = struct.unpack_from("<I", data, at)[0]
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            if not fill(8) or not fill(8 + (n := struct.unpack_from("<I", data, at + 4)[0])):
                raise ValueError("WARC: a skippable frame is cut off")
            at += 8 + n
            continue
        if magic != FRAME:
            raise ValueError("WARC: no frame where one is due")
        fill(18)
        stated = zstandard.frame_content_size(bytes(data[at : at + 18]))
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            if at == len(data) and not fill(1):
                raise ValueError("WARC: a frame is cut off")
            piece = bytes(data[at : at + (1 << 16)])
            parts.append(frame.decompress(piece))
            at += len(piece) - len(frame.unused_data)
        raw = b"".join(parts)
        if stated >= 0 and len(raw) != stated:
            raise ValueError("WARC: a frame's size differs from the stated one")
        yield raw
    if len(data) > at:
        raise ValueError("WARC: bytes after the last frame")


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def plan_records(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Each row with its payload's digest and, where it repeats an equal payload of at least revisit_from bytes, the page it revisits.

    The page with the smallest id is the response (null ids come after all others); rows that repeat that id are responses too.
    Other columns are not read; an empty table gives an empty one. Only rows whose payload may be repeated are moved, and
    of those the ones with very common payloads stay where they are, too.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    pages = pages.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload")})
    firsts = pages.where(F.col("size") >= revisit_from).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = cut(firsts)
    repeated, total = firsts.agg(F.count("*"), F.sum("n")).first()
    some = maybe_in(pages, "digest", firsts.select("digest"), repeated)
    moved = join_hot(some.where("_maybe").drop("_maybe"), firsts, "digest", "n", total or 0, "left")
    joined = moved.unionByName(some.where("NOT _maybe").drop("_maybe").withColumn("first", F.lit(None).cast("long")))
    return joined.withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))


def write_archives(pages: DataFrame, folder: str, dictionary: bytes | None = None) -> DataFrame:
    """Writes plan_records() rows to .warc.zst files in a folder that all executors reach; returns the archives written.

    A task that runs again writes files of its own, and only those of the attempt that Spark kept are in the list. Null ids and
    urls are written as such, rows that repeat an id or a payload are records of their own, other columns are not read, and an
    empty table writes nothing.
    """
    dictionary = fit_dictionary(pages.select("page_id", F.col("payload").cast("string").alias("html"))) if dictionary is None else dictionary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, place = _open(folder)
        task = TaskContext.get()
        head = struct.pack("<II", DICT_FRAME, len(dictionary)) + dictionary if dictionary else b""
        writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)
        out, path, size, count, done = None, "", 0, 0, []

        def close() -> None:
            nonlocal out
            if out:
                out.close()
                done.append((path, count, size))
                out = None

        for batch in batches:
            for page, url, payload, digest, first, revisit in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if out is None:
                    files.create_dir(place, recursive=True)
                    path = f"{place}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.warc.zst"
                    out, size, count = files.open_output_stream(path), len(head), 0
                    out.write(head)
                frame = writer.compress(record(page, url, payload, digest, first, revisit))
                out.write(frame)
                size, count = size + len(frame), count + 1
                if size >= ARCHIVE_BYTES:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["archive", "records", "bytes"])

    listed = scratch(pages.sparkSession, "warc-list")
    small_batches(pages).select("page_id", "url", "payload", "digest", "first", "revisit").mapInArrow(tidy(run), "archive string, records long, bytes long").write.parquet(listed)
    return pages.sparkSession.read.parquet(listed)


RECORDS = pa.schema([("archive", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_archives(archives: DataFrame, folder: str, *, payloads: bool = True) -> DataFrame:
    """The records of listed archives (archive, records), read block by block; a wrong record count is an error. No archive gives no record; null ids and empty payloads come back as they were; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _open(folder)
        for batch in batches:
            for path, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with files.open_input_stream(path) as f:
                    held, size, seen = [], 0, 0
                    for raw in records(iter(lambda f=f: f.read(1 << 20), b"")):
                        row = parse(raw) | {"archive": path}
                        if not payloads:
                            row["payload"] = None
                        held.append(row)
                        seen, size = seen + 1, size + len(raw)
                        if size > 8 << 20 or len(held) >= 5000:
                            yield pa.RecordBatch.from_pylist(held, RECORDS)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, RECORDS)
                    if seen != count:
                        raise ValueError(f"WARC: {path} has {seen} records, {count} were written")

    n = max(1, archives.count())
    spread = archives.select("archive", "records").repartition(min(n, 10_000), "archive")
    return spread.mapInArrow(tidy(run), "archive string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to archives in the shared folder and back. Null html is an empty payload; an empty table gives no archive."""
    folder = scratch(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    archives = write_archives(plan_records(pages), folder, fit_dictionary(pages))
    back = read_archives(archives, folder, payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
