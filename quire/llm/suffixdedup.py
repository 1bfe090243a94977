"""Repeated byte strings by prefix-free parsing (operator 7).

Every byte covered by a string of `length` bytes that also starts anywhere else is removed. Rolling-hash
triggers cut texts into phrases, from one trigger to the end of the next. A string is known by the suffix of
the phrase it starts in, which ends at its first trigger, and by what the parse has behind. Equal strings have
the same triggers at the same places and so the same whole phrases in between. As suffix arrays of dictionary
and parse would, the work goes from whole phrases to what the parse has behind them, and then to suffixes:

1. The dictionary: each phrase. A phrase found once rules out all strings that hold it whole.
2. The parse: of each phrase that a string without such phrases begins with, the extended phrase, which is all
   strings of which it is the first whole phrase. An extended phrase found twice proves all its strings repeated.
3. Suffixes: a phrase with several extensions branches. There the strings of each distinct extension are compared
   one by one; so are the few strings without a whole phrase.
4. Each text learns which of its extended phrases and strings are repeated.

Order is needed only as far as it brings equal strings together, so that sorted fingerprints stand in for the
lexicographic order; no suffix array of the whole corpus is ever held. What proves a repetition is compared by
128 bits (extended phrases) or 96 bits (strings), so that two different strings count as equal with a probability
of n^2 / 2^97 for n strings compared; what only rules out is compared by 64 bits.

Texts are spread over blocks of about `block_bytes`; a block sends each phrase, extension or string once however
often it holds it, so that copies and common passages meet in as many rows as there are blocks, at most.

Where shorter strings are asked for as well, they come first. A repeated string of `length` bytes lies within one run
of bytes that repeated shorter strings cover, so that only such runs of at least `length` bytes are gone through again,
each as a text of its own.

Null texts count as empty; texts shorter than `length` stay whole. Repeated rows are texts of their own, which
repeat each other. Empty tables give no rows. Of the input, only the columns in `keep` go on, without any that
is named like a result. A text must fit in a task's memory, with its fingerprints 40 times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import textbytes as tb
from quire.llm.shared import bucketed, bucketed_from, parts_for, released, small_batches, tidy

TRIGGER = 16
RESULTS = ("n_bytes", "n_removed", "n_spans", "kept")
#: The further result where shorter strings are asked for.
SHORTER = "n_repeated"
#: What comes back to a block: phrases found twice; phrases with several extensions; extended phrases found twice,
#: of which one block speaks for their strings; strings found twice.
_MET, _BRANCHING, _REPEATED, _REPEATED_HERE_FIRST, _STRING = range(5)
#: Flags in what a block sends: found twice in the block; an extended phrase (else a phrase and one of its
#: extensions); a phrase with several.
_TWICE, _EXTENDED, _SEVERAL = 1, 2, 4
_FAR = np.iinfo(np.int64).max // 2


def spacing(length: int) -> int:
    """Bytes from one trigger to the next, on average, so that few strings hold no whole phrase."""
    return max(8, length // 8)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All positions in [lo, hi] of each pair."""
    sizes = hi - lo + 1
    return np.repeat(lo - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(lo) else lo


class _Learnt:
    """What came back to a block: fingerprints by kind, and the bits that check them."""

    def __init__(self, table: pa.Table):
        h, x, kind = table["h"].to_numpy().view(np.uint64), table["x"].to_numpy().view(np.uint64), table["kind"].to_numpy()
        self.known = {}
        for name, kinds in (("met", [_MET]), ("branching", [_BRANCHING]), ("repeated", [_REPEATED, _REPEATED_HERE_FIRST]), ("first", [_REPEATED_HERE_FIRST]), ("strings", [_STRING])):
            take = np.isin(kind, kinds)
            order = np.lexsort((x[take], h[take]))
            self.known[name] = h[take][order], x[take][order]

    def has(self, name: str, h: np.ndarray, x: np.ndarray | None = None) -> np.ndarray:
        known, checks = self.known[name]
        if not len(known):
            return np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        found = known[at] == h
        if x is None:
            return found
        same = found & (checks[at] == x)
        more = found & ~same
        while more.any():  # equal fingerprints, other checks
            at = at + more
            more &= at < len(known)
            at = np.minimum(at, len(known) - 1)
            more &= known[at] == h
            same |= more & (checks[at] == x)
            more &= ~same
        return same


class _Parse:
    """Phrases [at, end) of several texts that lie behind one another. Strings that start in [lo, hi] of a phrase
    hold it as their first whole one; loose are the starts of strings that hold none."""

    def __init__(self, texts: list[bytes], length: int):
        self.length, self.n = length, sum(map(len, texts))
        data = np.frombuffer(b"".join(texts), np.uint8)
        self.first, self.second = tb.FIRST.prefix(data), tb.SECOND.prefix(data)
        self.offsets = offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        at = np.zeros(0, np.int64)
        if self.n > TRIGGER:
            rolled = (self.first[TRIGGER:] - self.first[:-TRIGGER]) * tb.FIRST.inverses[: self.n - TRIGGER + 1]
            at = np.flatnonzero(rolled < np.uint64((1 << 64) // spacing(length)))
        text = np.searchsorted(offsets, at, side="right") - 1
        inside = at + TRIGGER <= offsets[text + 1]
        at, text = at[inside], text[inside]
        before = np.where(np.diff(text, prepend=-1) == 0, np.concatenate([[0], at[:-1] + 1])[: len(at)], offsets[text])
        followed = np.diff(text, append=-1) == 0
        end = (np.append(at[1:], 0)[: len(at)] + TRIGGER)[followed]
        at, before, last = at[followed], before[followed], offsets[text[followed] + 1] - length
        self.end = end
        self.lo, self.hi = np.maximum(before, end - length), np.minimum(at, last)
        self.some = self.lo <= self.hi
        self.phrase = tb.FIRST.windows(self.first, at, end)
        starts = np.zeros(self.n + 1, np.int32)
        long = np.diff(offsets) >= length
        starts[offsets[:-1][long]] += 1
        starts[offsets[1:][long] - length + 1] -= 1
        starts[self.lo[self.some]] -= 1
        starts[self.hi[self.some] + 1] += 1
        self.loose = np.flatnonzero(np.cumsum(starts[:-1]) == 1)

    def strings(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = starts + self.length
        return tb.FIRST.windows(self.first, starts, ends), tb.SECOND.windows(self.second, starts, ends) >> np.uint64(32)

    def open(self, known: _Learnt) -> tuple[np.ndarray, np.ndarray]:
        """Of each phrase, the last start of a string that it is the first whole phrase of and that holds no phrase
        found once, and whether there is any."""
        met = known.has("met", self.phrase)
        ends = self.end[~met]
        hi = np.minimum(self.hi, np.append(ends, _FAR)[np.searchsorted(ends, self.end, side="right")] - self.length - 1)
        return hi, met & self.some & (self.lo <= hi)

    def extended(self, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, end = self.lo[take], self.hi[take] + self.length
        return tb.FIRST.windows(self.first, lo, end), tb.SECOND.windows(self.second, lo, end)

    def settled(self, known: _Learnt) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which phrases are proven with all their strings; which of these this block speaks for, where others
        may need it; and the starts of strings that have to be compared one by one."""
        hi, is_open = self.open(known)
        proven, spoken = np.zeros(len(hi), bool), np.zeros(len(hi), bool)
        whole = np.flatnonzero(is_open & (hi == self.hi))
        extended = self.extended(whole)
        proven[whole] = known.has("repeated", *extended)
        branching = known.has("branching", self.phrase)
        spoken[whole] = known.has("first", *extended) & branching[whole]
        take = is_open & ~proven & branching
        return proven, spoken, np.concatenate([self.loose, _ranges(self.lo[take], hi[take])])


def _parses(texts: list[bytes], length: int) -> Iterator[tuple[int, int, _Parse]]:
    for a, b in tb.chunks(texts):
        yield a, b, _Parse(texts[a:b], length)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where equal keys, of sorted ones, begin."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _distinct(h: np.ndarray, x: np.ndarray, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct fingerprints, and whether any was marked as repeated or stands here more than once."""
    order = np.lexsort((x, h))
    h, x, repeated = h[order], x[order], repeated[order]
    at = _runs(h, x)
    if not len(at):
        return h, x, repeated
    twice = np.diff(np.append(at, len(h))) > 1
    return h[at], x[at], np.logical_or.reduceat(repeated, at) | twice


def _table(kinds: dict[str, pa.DataType], *columns: np.ndarray) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c if t != pa.int64() else c.view(np.int64), t) for c, t in zip(columns, kinds.values(), strict=True)], names=[*kinds])


#: Sent: a fingerprint; the block, and flags in the lowest bits. Of extensions also 64 bits more (of a phrase, those
#: of its extension), of strings 32 bits more.
_PHRASES, _EXTENSIONS, _STRINGS = ({"h": pa.int64(), **more} for more in ({"v": pa.int32()}, {"x": pa.int64(), "v": pa.int32()}, {"v": pa.int64()}))
_BACK = {"block": pa.int32(), "h": pa.int64(), "x": pa.int64(), "kind": pa.int8()}
_SQL = {pa.int64(): "long", pa.int32(): "int", pa.int8(): "byte"}


def _sql(kinds: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{c} {_SQL[t]}" for c, t in kinds.items())


def _texts(table: pa.Table) -> list[bytes]:
    """All texts of a block; of rows with runs, these, one by one."""
    texts = [x or b"" for x in table["_text"].to_pylist()]
    if "_runs" not in table.column_names:
        return texts
    cuts = [np.concatenate([[0], np.cumsum(b - a)]).tolist() for a, b in map(_ends, table["_runs"].to_pylist())]
    return [t[a:b] for t, c in zip(texts, cuts, strict=True) for a, b in zip(c, c[1:], strict=False)]


def _ends(runs: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends in the whole text of a row's runs."""
    pairs = np.frombuffer(runs, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _joined(parts: list[np.ndarray], kind: type = np.uint64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _phrases(length: int):
    """Of a block: each phrase once."""

    def run(table: pa.Table) -> pa.Table:
        h, n = np.unique(_joined([p.phrase for _, _, p in _parses(_texts(table), length)]), return_counts=True)
        return _table(_PHRASES, h, (table["block"][0].as_py() << 1 | (n > 1)).astype(np.int32))

    return run


def _extensions(length: int):
    """Of a block: each extended phrase without phrases found once, and of each phrase that a string without such
    phrases begins with one extension, or the mark of several."""

    def run(table: pa.Table, back: pa.Table) -> pa.Table:
        known, found, more = _Learnt(back), [], []
        for _, _, p in _parses(_texts(table), length):
            hi, is_open = p.open(known)
            whole = is_open & (hi == p.hi)
            extended = p.extended(whole)
            found.append((p.phrase[whole], *extended))
            more.append(p.phrase[is_open & ~whole])
        phrase, h, x = (_joined(list(c)) for c in zip(*found, strict=True)) if found else [np.zeros(0, np.uint64)] * 3
        block = table["block"][0].as_py() if table.num_rows else 0
        eh, ex, twice = _distinct(h, x, np.zeros(len(h), bool))
        cut = _joined(more)  # strings that end before a phrase found once are an extension of another kind
        ph, px, several = np.concatenate([phrase, cut]), np.concatenate([h, np.zeros(len(cut), np.uint64)]), np.arange(len(phrase) + len(cut)) >= len(phrase)
        order = np.lexsort((px, ph))
        ph, px, several = ph[order], px[order], several[order]
        at = _runs(ph)
        if len(at):
            last = np.append(at[1:], len(ph)) - 1
            ph, px, several = ph[at], px[last], np.logical_or.reduceat(several, at) | (px[at] != px[last])
        v = np.concatenate([block << 3 | _EXTENDED | twice * _TWICE, block << 3 | several * _SEVERAL])
        return _table(_EXTENSIONS, np.concatenate([eh, ph]), np.concatenate([ex, px]), v.astype(np.int32))

    return run


def _strings(length: int):
    """Of a block: strings to be compared one by one, and those of proven extensions that it speaks for."""

    def run(table: pa.Table, back: pa.Table) -> pa.Table:
        known, found = _Learnt(back), []
        for _, _, p in _parses(_texts(table), length):
            _, spoken, starts = p.settled(known)
            for at, mark in ((starts, False), (_ranges(p.lo[spoken], p.hi[spoken]), True)):
                found.append((*p.strings(at), np.full(len(at), mark)))
        h, x, repeated = _distinct(*(_joined(list(c)) for c in zip(*found, strict=True))) if found else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool))
        block = table["block"][0].as_py() if table.num_rows else 0
        return _table(_STRINGS, h, x << np.uint64(32) | np.uint64(block << 3) | repeated.astype(np.uint64))

    return run


def _partition(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray] | None:
    """All rows of a shuffle partition, whose number is chosen so that they fit, in order; None if it has none."""
    kept = [b for b in batches if b.num_rows]
    if not kept:
        return None
    columns = [np.concatenate([b.column(i).to_numpy() for b in kept]) for i in range(kept[0].num_columns)]
    columns = [c.view(np.uint64) if c.dtype == np.int64 else c for c in columns]
    order = np.lexsort(columns[::-1])
    return [c[order] for c in columns]


def _back(take: np.ndarray, block: np.ndarray, h: np.ndarray, x: np.ndarray, kind: np.ndarray) -> list[pa.RecordBatch]:
    return _table(_BACK, block[take].astype(np.int32), h[take], x[take], kind[take].astype(np.int8)).to_batches()


def _compare_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if rows := _partition(batches):
        h, v = rows
        at = _runs(h)
        sizes = np.diff(np.append(at, len(h)))
        met = np.repeat(np.logical_or.reduceat(v & 1 == 1, at) | (sizes > 1), sizes)
        yield from _back(met, v >> 1, h, np.zeros(len(h), np.uint64), np.full(len(h), _MET))


def _compare_extensions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not (rows := _partition(batches)):
        return
    extended = rows[2] & _EXTENDED != 0
    h, x, v = (c[extended] for c in rows)
    if len(h):
        at = _runs(h, x)
        sizes = np.diff(np.append(at, len(h)))
        twice = np.repeat(np.logical_or.reduceat(v & _TWICE != 0, at) | (sizes > 1), sizes)
        kind = np.full(len(h), _REPEATED)
        kind[at] = _REPEATED_HERE_FIRST
        yield from _back(twice, v >> 3, h, x, kind)
    h, x, v = (c[~extended] for c in rows)
    if len(h):
        at = _runs(h)
        sizes = np.diff(np.append(at, len(h)))
        several = np.logical_or.reduceat(v & _SEVERAL != 0, at) | (x[at] != x[at + sizes - 1])
        yield from _back(np.repeat(several, sizes), v >> 3, h, np.zeros(len(h), np.uint64), np.full(len(h), _BRANCHING))


def _compare_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if rows := _partition(batches):
        h, v = rows
        x = v >> np.uint64(32)
        at = _runs(h, x)
        sizes = np.diff(np.append(at, len(h)))
        take = np.repeat(np.logical_or.reduceat(v & np.uint64(1) == 1, at) | (sizes > 1), sizes)
        yield from _back(take, (v >> np.uint64(3) & np.uint64(0x1FFFFFFF)), h, x, np.full(len(h), _STRING))


def _removed(p: _Parse, known: _Learnt) -> np.ndarray:
    """A mark for each byte to go."""
    proven, _, starts = p.settled(known)
    starts = starts[known.has("strings", *p.strings(starts))]
    depth = np.zeros(p.n + 1, np.int32)
    np.add.at(depth, np.concatenate([starts, p.lo[proven]]), 1)
    np.add.at(depth, np.concatenate([starts + p.length, p.hi[proven] + p.length]), -1)
    return np.cumsum(depth[:-1]) > 0


def _masks(texts: list[bytes], length: int, known: _Learnt) -> Iterator[np.ndarray]:
    """For each text a mark for each byte to go."""
    for a, b, p in _parses(texts, length):
        gone = _removed(p, known)
        for i in range(b - a):
            yield gone[p.offsets[i] : p.offsets[i + 1]]


def _split(length: int, longer: int, kept: int):
    """Of each row: the bytes that strings of `length` bytes cover, and its text, split into the runs of at least
    `longer` such bytes and the rest."""

    def run(table: pa.Table, back: pa.Table) -> pa.Table:
        known, texts, rows = _Learnt(back), _texts(table), []
        for text, mask in zip(texts, _masks(texts, length, known), strict=True):
            pairs = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
            pairs = pairs[pairs[:, 1] - pairs[:, 0] >= longer]
            at = [0, *pairs.ravel().tolist(), len(text)]
            pieces = [text[a:b] for a, b in zip(at, at[1:], strict=False)]
            rows.append((b"".join(pieces[1::2]), pairs.astype(np.int64).tobytes(), b"".join(pieces[::2]), int(np.count_nonzero(mask))))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        del known
        released()
        out = [table["block"], *(table[f"_{i}"] for i in range(kept))]
        out += [pa.array(c, pa.binary()) for c in columns[:3]] + [pa.array(columns[3], pa.int64())]
        return pa.Table.from_arrays(out, names=["block", *(f"_{i}" for i in range(kept)), "_text", "_runs", "_rest", "_repeated"])

    return run


def _whole(table: pa.Table, masks: Iterator[np.ndarray]) -> Iterator[tuple[bytes, np.ndarray]]:
    """Each row's whole text with its marks, put together again from runs and rest where it was split."""
    if "_runs" not in table.column_names:
        yield from zip(_texts(table), masks, strict=True)
        return
    for runs, text, rest in zip(*(table[c].to_pylist() for c in ("_runs", "_text", "_rest")), strict=True):
        mask, pieces, in_text, in_rest, last = np.zeros(len(text) + len(rest), bool), [], 0, 0, 0
        for a, b in zip(*(x.tolist() for x in _ends(runs)), strict=True):
            mask[a:b] = next(masks)
            pieces += [rest[in_rest : in_rest + a - last], text[in_text : in_text + b - a]]
            in_text, in_rest, last = in_text + b - a, in_rest + a - last, b
        yield b"".join([*pieces, rest[in_rest:]]), mask


def _cut(length: int, names: list[str], kept: int, as_text: bool):
    def run(table: pa.Table, back: pa.Table) -> pa.Table:
        known, rows = _Learnt(back), []
        for text, mask in _whole(table, _masks(_texts(table), length, known)):
            spans = int(np.count_nonzero(np.diff(mask.astype(np.int8), prepend=0) == 1))
            left = np.frombuffer(text, np.uint8)[~mask].tobytes() if spans else text
            rows.append((len(mask), int(np.count_nonzero(mask)), spans, left))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        del known
        released()
        out = [table[f"_{i}"] for i in range(kept)]
        out += [pa.array(c, pa.int64()) for c in columns[:3]]
        out.append(pa.array([x.decode(errors="ignore") for x in columns[3]], pa.string()) if as_text else pa.array(columns[3], pa.binary()))
        out += [table["_repeated"]] if "_repeated" in table.column_names else []
        return pa.Table.from_arrays(out, names=names)

    return run


def _compared(table: DataFrame, buckets: int, parts: int, length: int) -> DataFrame:
    """What comes back to each block of a bucketed table about the strings of its texts, dealt as that is."""

    def dealt(back: DataFrame) -> DataFrame:
        return back.repartition(buckets, "block")

    texts = table.select("block", "_text", *(c for c in table.columns if c == "_runs")).groupBy("block")
    sent = texts.applyInArrow(_phrases(length), _sql(_PHRASES))
    met = bucketed(dealt(sent.repartition(parts, "h").mapInArrow(tidy(_compare_phrases), _sql(_BACK))), buckets, "block")
    sent = texts.cogroup(met.groupBy("block")).applyInArrow(_extensions(length), _sql(_EXTENSIONS))
    extensions = sent.repartition(parts, "h").mapInArrow(tidy(_compare_extensions), _sql(_BACK))
    learnt = bucketed(dealt(met.unionByName(extensions)), buckets, "block")
    sent = texts.cogroup(learnt.groupBy("block")).applyInArrow(_strings(length), _sql(_STRINGS))
    strings = sent.repartition(2 * parts, "h").mapInArrow(tidy(_compare_strings), _sql(_BACK))
    return dealt(learnt.unionByName(strings))


def dedup(df: DataFrame, text: str, keep: list[str], length: int = 400, block_bytes: int = 8 << 20, as_text: bool = False, shorter: int | None = None) -> DataFrame:
    """Columns `keep` of df (without text), n_bytes, n_removed, n_spans and the bytes kept, of each row; as text,
    these are without characters that were cut in two. With `shorter`, also n_repeated, the bytes that a string of so
    few bytes covers which starts anywhere else too; they stay, as far as no string of `length` bytes covers them. The
    result reads scratch, which a scratch_scope() around it and whatever writes it deletes."""
    if shorter is not None and not 0 < shorter <= length:
        raise ValueError("shorter must be from 1 to length")
    spark = df.sparkSession
    small_batches(spark)
    results = [*RESULTS, *([SHORTER] if shorter else [])]
    keep = [c for c in keep if c not in results and c != text]
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    blocks = max(12, -(-size // block_bytes), -(-rows // 100_000))
    buckets = max(12, blocks // 4)
    columns = [F.col(c).alias(f"_{i}") for i, c in enumerate(keep)]
    block = F.pmod(F.xxhash64(*keep[:1], data), F.lit(blocks)).cast("int").alias("block")
    kept = [T.StructField(f"_{i}", df.schema[c].dataType) for i, c in enumerate(keep)]

    def parts(length: int) -> int:
        return parts_for(size // spacing(length), 1_000_000, 12)

    def whole() -> DataFrame:
        return df.select(*columns, data.alias("_text"), block).repartition(buckets, "block")

    def split() -> DataFrame:
        table = bucketed(whole(), buckets, "block")
        back = _compared(table, buckets, parts(shorter), shorter).groupBy("block")
        binary = [T.StructField(c, T.BinaryType()) for c in ("_text", "_runs", "_rest")]
        schema = T.StructType([T.StructField("block", T.IntegerType()), *kept, *binary, T.StructField("_repeated", T.LongType())])
        return table.groupBy("block").cogroup(back).applyInArrow(_split(shorter, length, len(keep)), schema)

    # bucketed by block, so that the four passes over the texts need one shuffle of them
    table = bucketed_from(spark, split if shorter else whole, buckets, "block")
    back = _compared(table, buckets, parts(length), length).groupBy("block")
    names = [*keep, *results]
    types = [*(f.dataType for f in kept), *[T.LongType()] * 3, T.StringType() if as_text else T.BinaryType(), *([T.LongType()] if shorter else [])]
    schema = T.StructType([T.StructField(c, t) for c, t in zip(names, types, strict=True)])
    return table.groupBy("block").cogroup(back).applyInArrow(_cut(length, names, len(keep), as_text), schema)
