"""WARC archives compressed with Zstandard (operator 4).

An archive starts with a skippable frame that holds the compression dictionary; then each record is one frame,
compressed with it, so that any record can be read alone. Of records with equal payloads (of at least
`min_bytes`), that of the smallest key is a response and the others are revisits that refer to it and carry no
payload. The reader takes the dictionary from the archive, decodes frame by frame and validates the version
line, the headers it needs, lengths and digests; whatever doesn't fit raises ValueError.

Null payloads count as empty; null urls are written as an empty target. Rows that repeat a key are all written;
if it is the smallest of its payload, each of them is a response. Rows with a null key never are referred to.
Empty tables give no archives and no rows. Only the columns named are used. A payload must fit in a task's memory;
one of 2 GB or more fails, as no column of Spark can hold it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the formats.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
VERSION, END = b"WARC/1.1\r\n", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes after which a task begins a new archive; a dictionary is trained on the first records of a task.
ARCHIVE_BYTES, SAMPLE_RECORDS, DICTIONARY_BYTES = 64 << 20, 200, 32 << 10
#: Tasks at most that the rows of one payload are dealt to.
SALTS = 256


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(key: object, url: str, payload: bytes, sha1: str, size: int, refers_to: object) -> bytes:
    """One record, not compressed. size and sha1 are those of the full payload, also in revisits."""
    revisit = refers_to is not None
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if key is None else key}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{sha1}"),
        ("X-Payload-Length", str(size)),
        ("Content-Type", "text/html; charset=utf-8"),
    ]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    block = b"" if revisit else payload
    headers.append(("Content-Length", str(len(block))))
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + END


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found or not head.startswith(VERSION):
        raise ValueError("no WARC/1.1 record")
    headers = {}
    for line in head[len(VERSION) :].decode().split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or name.lower() in headers:
            raise ValueError(f"bad header line {line!r}")
        headers[name.lower()] = value.strip(" ")
    needed = {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest", "warc-target-uri", "x-payload-length"}
    if needed - headers.keys() or not headers["content-length"].isdigit():
        raise ValueError("headers are missing")
    size = int(headers["content-length"])
    if len(rest) != size + len(END) or not rest.endswith(END):
        raise ValueError("Content-Length is wrong")
    block = rest[:size]
    if headers["warc-type"] == "response":
        if headers["warc-payload-digest"] != f"sha1:{digest(block)}" or headers["x-payload-length"] != str(size):
            raise ValueError("payload and digest differ")
    elif headers["warc-type"] != "revisit" or size or "warc-refers-to" not in headers:
        raise ValueError("bad record type")
    return headers, block


def preamble(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


def trained(samples: list[bytes]) -> bytes:
    """A dictionary; empty where the samples are too few for one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _frame_end(data: memoryview, start: int) -> int:
    """Where the frame at `start` ends, from its headers alone."""
    try:
        magic, descriptor = struct.unpack_from("<IB", data, start)
        if magic != FRAME:
            raise ValueError("no Zstandard frame")
        single, checksum = descriptor >> 5 & 1, descriptor >> 2 & 1
        content = (single, 2, 4, 8)[descriptor >> 6]
        at = start + 5 + (not single) + (0, 1, 2, 4)[descriptor & 3] + content
        while True:
            header = int.from_bytes(data[at : at + 3], "little")
            if at + 3 > len(data) or header >> 1 & 3 == 3:
                raise ValueError("broken frame")
            at += 3 + (1 if header >> 1 & 3 == 1 else header >> 3)
            if header & 1:
                break
    except struct.error as e:
        raise ValueError("broken frame") from e
    if at + 4 * checksum > len(data):
        raise ValueError("broken frame")
    return at + 4 * checksum


def records(archive: bytes | memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and blocks of an archive's records, one frame at a time."""
    data = memoryview(archive)
    if len(data) < 8:
        raise ValueError("no archive")
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE or 8 + size > len(data):
        raise ValueError("no dictionary frame")
    raw = bytes(data[8 : 8 + size])
    if raw[:4] == struct.pack("<I", FRAME):  # the dictionary may itself be compressed
        raw = zstandard.ZstdDecompressor().decompress(raw)
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor()
    at = 8 + size
    while at < len(data):
        end = _frame_end(data, at)
        one = decoder.decompressobj()  # the frame's header may lack the size of its content
        try:
            content = one.decompress(data[at:end])
        except zstandard.ZstdError as e:
            raise ValueError("broken frame") from e
        if not one.eof:
            raise ValueError("broken frame")
        yield parse(content)
        at = end


class _Archives:
    """Writes a task's records to archives. An archive gets its name when it is complete."""

    def __init__(self, out: str):
        self.store, self.root = FileSystem.from_uri(out)
        context = TaskContext.get()
        self.name = f"{self.root}/part-{context.partitionId():06d}"
        self.attempt, self.count, self.sink, self.coder = context.taskAttemptId(), 0, None, None

    def add(self, data: bytes) -> None:
        if self.sink is None:
            self.store.create_dir(self.root, recursive=True)
            self.sink = self.store.open_output_stream(f"{self.name}-{self.count:04d}.{self.attempt}.part")
            self.sink.write(preamble(self.dictionary))
        self.sink.write(self.coder.compress(data))
        if self.sink.tell() >= ARCHIVE_BYTES:
            self.close()

    def begin(self, samples: list[bytes]) -> None:
        self.dictionary = trained(samples)
        with_dictionary = {"dict_data": zstandard.ZstdCompressionDict(self.dictionary)} if self.dictionary else {}
        self.coder = zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=True, **with_dictionary)

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()
            name = f"{self.name}-{self.count:04d}"
            self.store.move(f"{name}.{self.attempt}.part", f"{name}.warc.zst")
            self.sink, self.count = None, self.count + 1


def resolved(df: DataFrame, key: str, url: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """(key, url, payload, sha1, size, first) of each row; first is the key it revisits, or null. The smallest key
    of each digest and length is found without payloads; it comes back to the rows salted, so that those of a very
    common payload are dealt to up to SALTS tasks."""
    data = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"), data.alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "size": F.octet_length("payload").cast("long"), "salt": F.pmod(F.xxhash64("key", "url"), F.lit(SALTS)).cast("int")})
    alike = rows.where(F.col("size") >= min_bytes).groupBy("sha1", "size", "salt").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("of"))
    whole = Window.partitionBy("sha1", "size")  # SALTS rows at most
    firsts = alike.select("sha1", "size", "salt", F.min("least").over(whole).alias("first"), F.sum("of").over(whole).alias("of"))
    revisits = ~F.col("key").eqNullSafe(F.col("first"))
    joined = rows.join(firsts.where("of > 1 and first is not null").drop("of"), ["sha1", "size", "salt"], "left")
    return joined.withColumn("first", F.when(revisits, F.col("first"))).drop("salt")


def write(df: DataFrame, key: str, url: str, payload: str, out: str, min_bytes: int = 0) -> None:
    """Writes df's rows as archives below the URI `out`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives, waiting, n = _Archives(out), [], 0
        for batch in batches:
            for row in batch.to_pylist():
                sha1 = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                waiting.append(record(row["key"], row["url"], row["payload"], sha1, row["size"], row["first"]))
                if archives.coder is None and len(waiting) < SAMPLE_RECORDS:
                    continue
                if archives.coder is None:
                    archives.begin(waiting)
                for data in waiting:
                    archives.add(data)
                n, waiting = n + len(waiting), []
        if waiting:
            archives.begin(waiting)
            for data in waiting:
                archives.add(data)
        archives.close()
        yield pa.RecordBatch.from_arrays([pa.array([n + len(waiting)], pa.int64())], names=["n"])

    resolved(df, key, url, payload, min_bytes).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def read(spark: SparkSession, path: str, key_type: T.DataType) -> DataFrame:
    """(key, url, payload_bytes, payload_digest, record_type, refers_to, block) of each record below path."""
    kind = key_type.simpleString()

    def key_of(value: str | None) -> str | None:
        return value.removeprefix("<urn:page:").removesuffix(">") or None if value else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "block"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for h, block in records(content.as_buffer()):
                    rows.append((key_of(h["warc-record-id"]), h["warc-target-uri"], int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], key_of(h.get("warc-refers-to")), block))
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("content")
    found = files.mapInArrow(run, "key string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, block binary")
    return found.withColumns({c: F.col(c).cast(kind) for c in ("key", "refers_to")})
