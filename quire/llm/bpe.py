"""Byte-level BPE through sentencepiece (operator 2).

The vocabulary of ranks becomes a sentencepiece BPE model without any training: each byte is written as one
character, each piece is scored by its negative rank, and normalisation is the identity. sentencepiece then
merges the pair of the best score, which is the pair of the lowest rank. Pre-tokens come from a pattern and
are encoded one by one; decoding maps ids back to pieces and pieces back to bytes.

Null texts count as empty and give no ids. Ids outside the vocabulary raise. Rows are independent: repeated
rows, extra columns and empty tables need no care. Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct pre-tokens whose ids a Python worker remembers; beyond that it starts afresh.
REMEMBERED = 200_000


def read_ranks(path: str) -> list[bytes]:
    """Pieces by rank, from lines of base64 and rank."""
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0 to n - 1")
    return [ranks[i] for i in range(len(ranks))]


def as_chars(piece: bytes) -> str:
    """Byte b as chr(0x100 + b): letters, no white space."""
    pairs = bytearray(b"\x01" * (2 * len(piece)))  # 16-bit units 0x0100 + byte
    pairs[::2] = piece
    return pairs.decode("utf-16-le")


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def model_bytes(pieces: list[bytes]) -> bytes:
    """The serialised model: piece i has id i; the unknown piece comes last and is never used."""
    normal, unknown, bpe = 1, 2, 2
    body = [_block(1, _block(1, as_chars(p).encode()) + b"\x15" + struct.pack("<f", -i) + _number(3, normal)) for i, p in enumerate(pieces)]
    body.append(_block(1, _block(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, unknown)))
    trainer = _number(3, bpe) + _number(4, len(pieces) + 1) + _number(40, len(pieces)) + b"".join(_number(f, -1) for f in (41, 42, 43))
    identity = _block(1, b"identity") + b"".join(_number(f, 0) for f in (3, 4, 5))
    return b"".join(body) + _block(2, trainer) + _block(3, identity)


class _Remembered(dict):
    """Ids of the pre-tokens met so far; of others they are found when asked for."""

    def __init__(self, pieces: list[bytes]):
        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(pieces))
        self.whole = {p: (i,) for i, p in enumerate(pieces)}

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        raw = token.encode()  # a pre-token that is itself a piece is that piece, even if no merges lead to it
        ids = self.whole.get(raw) or tuple(self.model.encode(as_chars(raw)))
        self[token] = ids
        return ids


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        self.pieces = read_ranks(path)
        self.decimals = [str(i) for i in range(len(self.pieces))]
        self.split = regex.compile(pattern).findall
        self.known = _Remembered(self.pieces)

    def encode(self, text: str) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.known.__getitem__, self.split(text))), np.int32)

    def decode(self, ids: list[int]) -> bytes:
        if ids and min(ids) < 0:
            raise ValueError("negative id")
        return b"".join(map(self.pieces.__getitem__, ids))


@lru_cache(maxsize=4)
def coder(path: str, pattern: str) -> ByteBpe:
    """One per Python worker."""
    return ByteBpe(path, pattern)


def _forgetting(code: ByteBpe, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of a task's batches; a worker that goes on to other tasks keeps no pre-tokens."""
    yield from _slices(batches)
    code.known.clear()


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that little more than the input's own batch is held at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))


def encode(df: DataFrame, key: str, text: str, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """(key, ids array<int>) for each row of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path, pattern)
        for batch in _forgetting(code, batches):
            found = [code.encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, np.concatenate(found))], names=[key, ids])

    return _texts(df, key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, `{ids}` array<int>")


def round_trip(df: DataFrame, key: str, text: str, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): each text encoded and its ids decoded again, in one pass
    that hands digests of ids (decimal, with commas) and bytes to Spark; the ids themselves too if asked for."""
    names = [key, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path, pattern)
        for batch in _forgetting(code, batches):
            rows = []
            for t in batch.column(1).to_pylist():
                ids = (array := code.encode(t)).tolist()
                listed = ",".join(map(code.decimals.__getitem__, ids)).encode()
                rows.append((len(ids), sha256(listed).hexdigest(), sha256(code.decode(ids)).hexdigest(), array))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns][: len(names)], names=names)

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return _texts(df, key, text).mapInArrow(run, schema)


def decode(df: DataFrame, ids: str, path: str, pattern: str, out: str = "decoded") -> DataFrame:
    """df with the bytes that its ids stand for; null ids give no bytes."""
    from pyspark.sql.types import BinaryType, StructType

    schema = StructType([*df.schema.fields]).add(out, BinaryType())
    at, names = df.columns.index(ids), [*df.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path, pattern)
        for batch in _forgetting(code, batches):
            decoded = [code.decode(x or []) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], names=names)

    return df.mapInArrow(run, schema)
