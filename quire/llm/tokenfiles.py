"""Token ids as Arrow files of equal-length sequences (operator 6).

Each file (Arrow's file format, several record batches of fixed-size lists, not compressed) holds sequences of
`length` ids (16 bits each where the vocabulary allows) and as many mask bits: a token, or past the end. A
reader maps a file and takes any sequence without decoding or copying anything. Beside it stands an index file
with key and n_tokens in file order. Documents stand in ascending order of their keys, in and across files.

Null texts count as empty (the end id alone). A null key sorts first. Rows that repeat a key are all written,
ordered by key and text. An empty table gives no files and no rows. Texts of any length are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.ipc
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.shared import parts_for, small_batches

#: Bytes of texts in a range of keys, and of ids in a file.
RANGE_BYTES, FILE_BYTES = 64 << 20, 64 << 20
#: After how many words a worker forgets those that it has not met for a while; texts that are encoded together;
#: sequences in a record batch.
REMEMBERED, TOGETHER, BATCH = 400_000, 1024, 64
#: Words of these letters stay letters in lower case and in composed form, so that each is one pre-token, as is
#: a run of stops.
_WORD = re.compile("[a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u024f]+|[.,;:!?]+").fullmatch
_STOPS = ".,;:!?"
#: A stop that is no run of its own between a letter or digit and a blank; what might begin a special token; and
#: characters that are not printing ASCII or Latin ones, for which lower case and composed form need a closer look.
_CLOSER = re.compile("[.,][^ \n]|[^A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f][.,]|<\\||[^ \n\x21-\x7e\u00a1-\u012f\u0131-\u024f]").search


# Fixed value: the pattern that such a tokenizer cuts texts by.
_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Recent:
    """What was met lately: at least the last REMEMBERED keys, at most twice as many and a batch."""

    def __init__(self):
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def unknown(self, keys: set[str]) -> list[str]:
        """Keys to look up; all others stand in `now` afterwards."""
        if len(self.now) > REMEMBERED:
            self.now, self.before = {}, self.now
        now, before, out = self.now, self.before, []
        for k in keys:
            if k not in now:
                if k in before:
                    now[k] = before[k]
                else:
                    out.append(k)
        return out


def units(text: str) -> list[str]:
    """Parts of a text that are encoded apart. The tokenizer composes and lowers characters, then takes runs of
    letters, digits, and runs of other marks, and drops white space; nothing is composed or merged across a blank,
    nor between a letter and a stop that a blank follows. Special tokens hold no blank."""
    if not _CLOSER(text):
        return text.lower().replace("\n", " ").replace(".", " .").replace(",", " ,").split(" ")
    out = []
    for chunk in text.replace("\n", " ").split(" "):
        word = chunk.rstrip(_STOPS)
        low = word.lower()
        if _WORD(low):
            out.append(low)
            if word is not chunk:
                out.append(chunk[len(word) :])
        else:
            out.append(chunk)
    return out


def _cut_as_here(settings: dict) -> bool:
    """Whether a tokenizer composes, lowers and cuts texts as units() takes for granted."""
    model, normal, cut = settings["model"], settings.get("normalizer") or {}, settings.get("pre_tokenizer") or {}
    split = (cut.get("pretokenizers") or [{}])[0]
    return (
        model.get("type") == "BPE" and bool(model.get("end_of_word_suffix")) and not model.get("dropout")
        and [n["type"] for n in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        and split.get("type") == "Split" and split.get("behavior") == "Removed" and (split.get("pattern") or {}).get("Regex") == _CUTS
        and all(" " not in t["content"] and not t["normalized"] for t in settings.get("added_tokens", []))
    )


class Coder:
    """Encodes texts unit by unit and remembers the ids of recent units."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.known = Recent()
        self.tokenizer = Tokenizer.from_file(path)
        #: Whether units() and _WORD hold for this tokenizer; of any other, texts are encoded whole.
        self.apart = _cut_as_here(json.loads(self.tokenizer.to_str()))
        ids, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(max(ids.values()) + 1, bool)
        self.last[[i for piece, i in ids.items() if suffix and piece.endswith(suffix)]] = True
        self.kind = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)

    def _learn(self, new: list[str]) -> None:
        """Words are pre-tokens, so that joined by blanks each gives ids up to a piece that ends a word."""
        plain, other, known = [], [], self.known.now
        for u in new:
            (plain if _WORD(u) else other).append(u)
        if plain:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, self.kind)
            ends = ((np.flatnonzero(self.last[ids]) + 1) * self.kind.itemsize).tolist()
            data, start = ids.tobytes(), 0
            for u, end in zip(plain, ends, strict=True):
                known[u] = data[start:end]
                start = end
        for u, found in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            known[u] = np.array(found.ids, self.kind).tobytes()

    def encode(self, texts: list[str], end_id: int) -> Iterator[np.ndarray]:
        if not self.apart:
            for text in texts:
                yield np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, end_id], self.kind)
            return
        split = list(map(units, texts))
        self._learn(self.known.unknown(set(chain.from_iterable(split))))
        end = np.array([end_id], self.kind).tobytes()
        for parts in split:
            yield np.frombuffer(b"".join(map(self.known.now.__getitem__, parts)) + end, self.kind)


@lru_cache(maxsize=4)
def coder(path: str) -> Coder:
    """One per Python worker."""
    return Coder(path)


class _Writer:
    """Sequences of one file; it holds one unfinished record batch at most."""

    def __init__(self, out: pa.NativeFile, length: int, kind: np.dtype):
        self.length, self.kind, self.ids, self.size = length, kind, [], 0
        kinds = [pa.list_(pa.from_numpy_dtype(kind), length), pa.list_(pa.bool_(), length)]
        self.writer = pa.ipc.new_file(out, pa.schema(list(zip(("ids", "mask"), kinds, strict=True))))

    def add(self, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.size += len(ids)
        if self.size >= self.length * BATCH:
            whole = np.concatenate(self.ids)
            n = self.size // self.length * self.length
            self._batch(whole[:n], np.ones(n, bool))
            self.ids, self.size = [whole[n:]], self.size - n

    def _batch(self, ids: np.ndarray, mask: np.ndarray) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, names=["ids", "mask"]))

    def close(self) -> None:
        if self.size:
            rest = -self.size % self.length
            self._batch(np.concatenate([*self.ids, np.zeros(rest, self.kind)]), np.arange(self.size + rest) < self.size)
        self.writer.close()


class _Files:
    """Files of one partition, one after the other; each gets its name when it is complete, so that an attempt
    that dies leaves none and a second one gives the same files."""

    def __init__(self, out: str, length: int, kind: np.dtype):
        self.store, root = FileSystem.from_uri(out)
        self.store.create_dir(root, recursive=True)
        context = TaskContext.get()
        self.name, self.aside = f"{root}/part-{context.partitionId():06d}", context.taskAttemptId()
        self.length, self.kind, self.at, self.sink = length, kind, 0, None

    def add(self, ids: np.ndarray) -> None:
        if self.sink is None:
            self.sink = self.store.open_output_stream(f"{self.name}-{self.at:04d}.{self.aside}.part")
            self.writer, self.counts, self.keys = _Writer(self.sink, self.length, self.kind), [], []
        self.writer.add(ids)
        self.counts.append(len(ids))

    def full(self) -> bool:
        return self.sink is not None and sum(self.counts) * self.kind.itemsize >= FILE_BYTES

    def close(self) -> None:
        """Ends a file, if one is open."""
        if self.sink is None:
            return
        self.writer.close()
        self.sink.close()
        name, aside = f"{self.name}-{self.at:04d}", f"{self.name}-{self.at:04d}.{self.aside}.part"
        index = pa.table({"key": pa.chunked_array(self.keys), "n_tokens": pa.array(self.counts, pa.int64())})
        with self.store.open_output_stream(f"{aside}.index") as f, pa.ipc.new_file(f, index.schema) as w:
            w.write_table(index)
        self.store.move(f"{aside}.index", f"{name}.index.arrow")
        self.store.move(aside, f"{name}.arrow")
        self.sink, self.at = None, self.at + 1


def write(df: DataFrame, key: str, text: str, path: str, out: str, end_id: int = 1, length: int = 2048) -> None:
    """Writes df's texts below the URI `out`: part-N-M.arrow and part-N-M.index.arrow, the M-th file of range N of
    the keys. Ranges hold about RANGE_BYTES of text each, files about FILE_BYTES of ids."""
    spark = df.sparkSession
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, files, n = coder(path), None, 0
        for batch in batches:
            if files is None and batch.num_rows:
                files = _Files(out, length, code.kind)
            texts = batch.column(1).to_pylist()
            for i in range(0, len(texts), TOGETHER):
                part = texts[i : i + TOGETHER]
                for ids in code.encode(part, end_id):
                    files.add(ids)
                    n += len(ids)
                files.keys.append(batch.column(0).slice(i, len(part)))
                if files.full():
                    files.close()
        if files is not None:
            files.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ordered = rows.repartitionByRange(parts_for(size, RANGE_BYTES, 12), "key").sortWithinPartitions("key", "text")
    ordered.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def mapped(store: FileSystem, name: str) -> pa.NativeFile:
    """A file of ids: mapped where it lies on a disk, else read, as a store has nothing to map."""
    if isinstance(store, LocalFileSystem):
        return pa.memory_map(name)
    with store.open_input_file(name) as f:
        return pa.BufferReader(f.read_buffer())


def sequences(source: pa.NativeFile) -> list[tuple[np.ndarray, pa.BooleanArray]]:
    """By record batch: ids as an array of shape (sequences, length) over the file's own bytes, and the mask."""
    reader = pa.ipc.open_file(source)
    batches = [reader.get_batch(i) for i in range(reader.num_record_batches)]
    return [(b.column(0).values.to_numpy(zero_copy_only=True).reshape(len(b), -1), b.column(1).values) for b in batches]


def _checksums(batches: list[np.ndarray], sizes: list[int]) -> list[int]:
    """Of each document, whose ids may lie in several batches."""
    out, at, place = [], 0, 0
    for n in sizes:
        crc = 0
        while n:
            part = batches[at][place : place + n]
            crc = zlib.crc32(part.astype("<u4"), crc)
            n, place = n - len(part), place + len(part)
            if place == len(batches[at]):
                at, place = at + 1, 0
        out.append(crc)
    return out


def read(spark: SparkSession, path: str, kind: T.DataType) -> DataFrame:
    """(file, key, place, n_tokens, ids_crc32) of each document in the files below path, whose keys are of this
    kind: its place among the tokens of its file, and the CRC of its ids as little-endian unsigned 32-bit integers."""
    fields = [T.StructField("file", T.StringType()), T.StructField("key", kind)]
    fields += [T.StructField(x, T.LongType()) for x in ("place", "n_tokens", "ids_crc32")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = FileSystem.from_uri(path)
                with store.open_input_file(name.removesuffix(".arrow") + ".index.arrow") as f:
                    index = pa.ipc.open_file(f).read_all()
                sizes = index["n_tokens"].to_numpy()
                ends = np.cumsum(sizes)
                with mapped(store, name) as source:
                    found = sequences(source)
                    if sum(m.true_count for _, m in found) != sizes.sum():
                        raise ValueError(f"{path}: index and masks differ")
                    crc = _checksums([x.reshape(-1) for x, _ in found], sizes.tolist())
                    del found
                columns = [pa.array([os.path.basename(name)] * len(ends)), index["key"].combine_chunks(), *(pa.array(x, pa.int64()) for x in (ends - sizes, sizes, crc))]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*[0-9].arrow").load(path)
    return files.select("path").repartition(F.col("path")).mapInArrow(run, T.StructType(fields))


def with_starts(read_back: DataFrame, key: str) -> DataFrame:
    """(key under its name, start, n_tokens, ids_crc32); start counts the ids of all documents in earlier files and
    earlier places. One row a file is summed up in order; documents never meet in one task."""
    from pyspark.sql import Window

    sizes = read_back.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    joined = read_back.join(bases, "file")
    return joined.select(F.col("key").alias(key), (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
