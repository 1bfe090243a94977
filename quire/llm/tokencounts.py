"""Token counts of texts, without a shuffle of pre-tokens (operator 13).

A sentencepiece model whose pieces hold its blank mark only in front never merges across the border between a word
and the blanks behind it, so that the pre-tokens of a text (blanks and the word behind them) have lengths of their own.
Lengths are looked up in two tiers where the text is read: a compact table of the frequent pre-tokens, which is
broadcast, then a cache of the worker, which encodes what it has not met. A model of another kind gets whole texts.

Frequent are pre-tokens that make up a share of SHARE or more of what some task of a pass over all texts reads. Each task
keeps a summary of bounded size (Misra and Gries) that misses none of them, and sends those alone; the sums of these few
rows are all that is shuffled. The table holds at most 1 / SHARE pre-tokens of at most LONGEST characters, and whatever it
holds, counts are the same.

Null texts count as empty and have no tokens. A null key is a key like others. Rows that repeat a key are all counted.
An empty table gives no rows. Texts of any length are counted whole, part by part; further columns play no part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import small_batches, tidy

#: A pre-token of at least this share of a task's is frequent; characters of the longest one that any table holds.
SHARE, LONGEST = 1 / 8192, 48
#: Pre-tokens that a worker remembers besides the frequent ones; characters of a text that are split at once.
REMEMBERED, PART = 400_000, 1 << 16
#: sentencepiece's mark of a blank.
BLANK = "▁"
_UNITS = re.compile(f"{BLANK}*+[^{BLANK}]+|{BLANK}+").findall
_BORDER = re.compile(f"(?<=[^{BLANK}]){BLANK}").search


def units(text: str) -> Iterator[list[str]]:
    """The pre-tokens of a text in lists of about PART characters. Each begins with the mark of a blank, which
    the model puts before a text as well."""
    if not text:
        return
    marked, at = BLANK + text.replace(" ", BLANK), 0
    while at < len(marked):
        found = _BORDER(marked, at + PART) if len(marked) - at > PART else None
        end = found.start() if found else len(marked)
        yield _UNITS(marked, at, end)
        at = end


class Model:
    def __init__(self, path: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        inside = any(_BORDER(self.pieces.id_to_piece(i)) for i in range(self.pieces.get_piece_size()))
        as_is = self.pieces.normalize("ﬁ  Å　x ") == f"{BLANK}ﬁ{BLANK * 2}Å　x{BLANK}"
        #: Whether pre-tokens can be encoded apart: no piece spans two, and the model changes nothing but blanks.
        self.separable = as_is and not inside
        self._lone = self.length("a ") - self.length("a")

    def length(self, text: str) -> int:
        return len(self.pieces.encode(text, num_threads=1))

    def unit(self, unit: str) -> int:
        """Tokens of a pre-token, whose first mark the model adds itself; a mark alone only ends a text."""
        return self.length(unit[1:]) if len(unit) > 1 else self._lone


@lru_cache(maxsize=4)
def model(path: str) -> Model:
    """One per Python worker."""
    return Model(path)


class Table:
    """Pre-tokens and their lengths in three buffers."""

    def __init__(self, lengths: dict[str, int]):
        keys = [k.encode() for k in lengths]
        self.keys = b"".join(keys)
        self.ends = pa.array([len(k) for k in keys], pa.uint8()).buffers()[1].to_pybytes() if keys else b""
        self.lengths = bytes(lengths.values())  # LONGEST characters are four bytes each at most, and a byte a token

    def read(self) -> dict[str, int]:
        out, at = {}, 0
        for size, n in zip(self.ends, self.lengths, strict=True):
            out[self.keys[at : at + size].decode()] = n
            at += size
        return out


class Lengths(dict):
    """Both tiers: the frequent pre-tokens, which stay, and what a worker has met since."""

    def __init__(self, model: Model, frequent: dict[str, int]):
        super().__init__(frequent)
        self.model, self.frequent = model, frequent

    def __missing__(self, unit: str) -> int:
        n = self.model.unit(unit)
        if len(unit) <= LONGEST:
            if len(self) >= len(self.frequent) + REMEMBERED:
                self.clear()
                self.update(self.frequent)
            self[unit] = n
        return n

    def count(self, text: str) -> int:
        if not self.model.separable:
            return self.model.length(text)
        return sum(sum(map(self.__getitem__, part)) for part in units(text))


class Summary:
    """Counts of the most frequent among any number of keys: no count is too high, nor too low by more than
    `short`, which is at most seen / size."""

    def __init__(self, size: int):
        self.size, self.counts, self.seen, self.short = size, Counter(), 0, 0

    def add(self, keys: list[str]) -> None:
        self.seen += len(keys)
        self.counts.update(keys)
        if len(self.counts) > 2 * self.size:
            less = sorted(self.counts.values(), reverse=True)[self.size]
            self.counts = Counter({k: n - less for k, n in self.counts.items() if n > less})
            self.short += less

    def frequent(self, share: float) -> dict[str, int]:
        """All keys of at least this share of what was seen, and no more than some of a little less."""
        return {k: n for k, n in self.counts.items() if n + self.short >= share * self.seen}


def frequent(df: DataFrame, text: str, path: str, share: float = SHARE) -> DataFrame:
    """(unit, n): pre-tokens that are frequent in some task, and how often they were counted there. All texts are
    read; a task sends at most about 1 / share rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Summary(round(10 / share))
        if model(path).separable:
            for batch in batches:
                for i in range(batch.num_rows):
                    for part in units(batch.column(0)[i].as_py()):
                        found.add([u for u in part if len(u) <= LONGEST])
        rows = found.frequent(share)
        yield pa.RecordBatch.from_arrays([pa.array(rows.keys(), pa.string()), pa.array(rows.values(), pa.int64())], names=["unit", "n"])

    small_batches(df.sparkSession)
    sent = df.select(F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(tidy(run), "unit string, n long")
    return sent.groupBy("unit").agg(F.sum("n").alias("n"))


def table(df: DataFrame, text: str, path: str, share: float = SHARE) -> Table:
    """The first tier: the 1 / share most frequent pre-tokens at most, with their lengths."""
    most = frequent(df, text, path, share).orderBy(F.desc("n"), "unit").limit(round(1 / share))
    known = model(path)
    return Table({r.unit: known.unit(r.unit) for r in most.collect()})  # at most 1 / share rows of LONGEST characters


def count(df: DataFrame, key: str, text: str, path: str, limit: int = 4096, share: float = SHARE) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of each row of df: UTF-8 bytes and tokens of its text as the library
    counts them, without added ones, and whether these are more than `limit`."""
    sent = df.sparkSession.sparkContext.broadcast(table(df, text, path, share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lengths(model(path), sent.value.read())
        for batch in batches:
            n = [known.count(batch.column(2)[i].as_py()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["key", "n_bytes", "n_tokens"])

    small_batches(df.sparkSession)
    whole = F.coalesce(F.col(text), F.lit(""))
    kind = df.schema[key].dataType.simpleString()
    found = df.select(F.col(key).alias("key"), F.octet_length(whole).cast("long").alias("n_bytes"), whole.alias("t")).mapInArrow(tidy(run), f"key {kind}, n_bytes long, n_tokens long")
    return found.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
