"""Benchmark decontamination with a generalised suffix automaton (operator 9).

The test items, as sequences of lower-cased words, become one suffix automaton. Documents stream through it
word by word; at each word the automaton tells the length of the longest match that ends there. Where that
reaches `window` words (or a whole item that is shorter), those words are hit. `clean` cuts hit words out of
texts and drops documents that consist of them for the most part.

Only stretches of two or more known neighbours are walked; the others leave the automaton at length 1 or 0.

The automaton is built from at most `block_bytes` of items, which the driver fetches and sends to all tasks block
by block; more items take more passes, with the documents written between them.
Null texts have no words; items without words match nothing; an item with a null id marks words but is not
listed; repeated items count once. Repeated documents each get a row. Empty tables give empty results. Of the
input, only the columns in `keep` go on, without any that is named like a result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quire.llm import textbytes as tb
from quire.llm.shared import delete, scratch, small_batches

SPAN = "struct<first_word:long,last_word:long,first_byte:long,end_byte:long>"


def word_list(text: bytes) -> list[bytes]:
    return text.translate(tb.ALNUM_OR_SPACE).split()


#: No items; most states share it.
_NONE: set = set()


class SuffixAutomaton:
    """Of several word sequences. For each state: its transitions, suffix link, longest length, the items whose
    windows end there, and the shorter items that end there."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.step: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.words: dict[bytes, int] = {}
        items = [(i, [self.words.setdefault(w, len(self.words)) for w in ws]) for i, ws in items if ws]
        self.shortest = min((min(window, len(ws)) for _, ws in items), default=0)
        self.pairs = {(a, b) for _, ws in items for a, b in zip(ws, ws[1:], strict=False)}
        for _, ws in items:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        self.items: list[set] = [_NONE] * len(self.step)
        whole: dict[int, dict[int, set]] = {}
        for item, ws in items:
            state = length = 0
            for w in ws:
                state, length = self.step[state][w], length + 1
                if length >= window:
                    at = self._at(state, window)
                    if self.items[at] is _NONE:
                        self.items[at] = set()
                    self.items[at].add(item)
            if length < window:
                whole.setdefault(self._at(state, length), {}).setdefault(length, set()).add(item)
        self.short: list[list[tuple[int, set]]] = [[]] * len(self.step)
        for s in sorted(range(1, len(self.step)), key=self.size.__getitem__):
            own, shorter = whole.get(s), self.short[self.link[s]]
            self.short[s] = shorter + sorted(own.items()) if own else shorter
        self.of_window = [self.items[self._at(s, window)] if self.size[s] >= window else _NONE for s in range(len(self.step))]

    def _at(self, state: int, length: int) -> int:
        """The state of the last `length` words of state's longest match."""
        while self.size[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _copy(self, of: int, size: int) -> int:
        self.step.append(dict(self.step[of]))
        self.size.append(size)
        self.link.append(self.link[of])
        return len(self.step) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """q if it holds p's strings plus w alone, else a new state that does."""
        if self.size[p] + 1 == self.size[q]:
            return q
        new = self._copy(q, self.size[p] + 1)
        self.link[q] = new
        while p != -1 and self.step[p].get(w) == q:
            self.step[p][w] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, w: int) -> int:
        if w in self.step[last]:
            return self._split(last, w, self.step[last][w])
        self.step.append({})
        self.size.append(self.size[last] + 1)
        self.link.append(0)
        new, p = len(self.step) - 1, last
        while p != -1 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        if p != -1:
            self.link[new] = self._split(p, w, self.step[p][w])
        return new

    def walk(self, ids: list[int]) -> tuple[list[tuple[int, int]], set, int]:
        """Spans (first, end) of hit words, items hit, and the longest matching length."""
        spans, found, longest, state, length = [], set(), 0, 0, 0
        for i, w in enumerate(ids):
            while state and w not in self.step[state]:
                state = self.link[state]
                length = self.size[state]
            if w in self.step[state]:
                state, length = self.step[state][w], length + 1
            longest = max(longest, length)
            if length >= self.window:
                spans.append((i + 1 - self.window, i + 1))
                found |= self.of_window[state]
            for size, items in self.short[state]:
                if size <= length:
                    spans.append((i + 1 - size, i + 1))
                    found |= items
        return spans, found, longest


class _Scanner:
    """A suffix automaton, and sorted fingerprints of its words and of its pairs of neighbours."""

    def __init__(self, automaton: SuffixAutomaton):
        self.automaton = automaton
        words = sorted(automaton.words, key=automaton.words.get)
        data, starts, ends, _ = tb.words(words, alnum=True)
        marks = tb.FIRST.windows(tb.FIRST.prefix(data), starts, ends)
        self.ids = np.argsort(marks)
        self.marks = marks[self.ids]
        self.n = max(1, len(words))
        self.pairs = np.array(sorted(a * self.n + b for a, b in automaton.pairs), np.int64)
        self.single = np.array([False, *(bool(automaton.short[s] and automaton.short[s][0][0] == 1) for s in (automaton.step[0][i] for i in range(len(words))))])

    def scan(self, texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int, int, int]], set, int]]:
        """(words, merged spans, items, longest match) of each text."""
        for a, b in tb.chunks(texts):
            data, starts, ends, first = tb.words(texts[a:b], alnum=True)
            n = len(starts)
            ids = np.full(n + 1, -1, np.int64)
            if n and len(self.marks):
                marks = tb.FIRST.windows(tb.FIRST.prefix(data), starts, ends)
                at = np.minimum(np.searchsorted(self.marks, marks), len(self.marks) - 1)
                ids[:n] = np.where(self.marks[at] == marks, self.ids[at], -1)
            keys = ids[:-1] * self.n + ids[1:]
            known = np.zeros(n, bool)
            if len(self.pairs):
                at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
                known = (self.pairs[at] == keys) & (ids[:-1] >= 0) & (ids[1:] >= 0)
            known[first[1:][first[1:] > 0] - 1] = False  # the last word of a text has no neighbour
            edges = np.diff(np.concatenate([[0], known.astype(np.int8), [0]]))
            runs = np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) + 1], axis=1)
            runs = runs[runs[:, 1] - runs[:, 0] >= self.automaton.shortest]
            if self.single.any():
                inside = np.zeros(n + 1, np.int64)
                for s, e in runs:
                    inside[s:e] = 1
                alone = np.flatnonzero(self.single[ids[:-1] + 1] & (inside[:-1] == 0))
                runs = np.concatenate([runs, np.stack([alone, alone + 1], axis=1)])
            owner = np.searchsorted(first, runs[:, 0], side="right") - 1
            of: dict[int, list] = {}
            for doc, (s, e) in zip(owner.tolist(), runs.tolist(), strict=True):
                of.setdefault(doc, []).append((s, e))
            base = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[a:b]])])
            for i in range(b - a):
                spans, found, longest, f = [], set(), 0, int(first[i])
                for s, e in sorted(of.get(i, ())):
                    more, items, length = self.automaton.walk(ids[s:e].tolist())
                    spans += [(s + x - f, s + y - f) for x, y in more]
                    found |= items
                    longest = max(longest, length)
                merged: list[list[int]] = []
                for s, e in sorted(spans):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                placed = [(s, e - 1, int(starts[f + s] - base[i]), int(ends[f + e - 1] - base[i])) for s, e in merged]
                yield int(first[i + 1] - first[i]), placed, found, longest


def item_blocks(items: DataFrame, key: str, text: str, block_bytes: int) -> Iterator[list[tuple[object, bytes]]]:
    """Rows of the item table, fetched in turn, in blocks of at most block_bytes (or one item)."""
    block, size = [], 0
    for item, data in items.select(key, F.col(text).cast("binary")).toLocalIterator():
        if data is not None:
            if block and size + len(data) > block_bytes:
                yield block
                block, size = [], 0
            block.append((item, bytes(data)))
            size += len(data)
    yield block


def _marked(blocks: Iterator[list]) -> Iterator[tuple[list, bool, bool]]:
    """Each block, and whether it is the first and the last one."""
    before, first = next(blocks), True
    for block in blocks:
        yield before, first, False
        before, first = block, False
    yield before, first, True


#: The scanner of the block that a Python worker works with; a worker of several tasks builds it once.
_SCANNERS: dict[str, _Scanner] = {}


def _scanner(token: str, sent: Broadcast, window: int) -> _Scanner:
    if token not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[token] = _Scanner(SuffixAutomaton([(i, word_list(t)) for i, t in sent.value], window))
    return _SCANNERS[token]


RESULTS = ("n_words", "spans", "items", "longest", "cleaned")
_FIELDS = ("first_word", "last_word", "first_byte", "end_byte")


def _merged(spans: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Overlapping or touching spans as one."""
    out: list[tuple[int, ...]] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1] + 1:
            old = out.pop()
            s = (old[0], max(old[1], s[1]), old[2], max(old[3], s[3]))
        out.append(s)
    return out


def _without(text: bytes, spans: list[tuple[int, ...]]) -> bytes:
    ends = [0, *(s[3] for s in spans)]
    return b"".join(text[a:b] for a, b in zip(ends, [*(s[2] for s in spans), len(text)], strict=True))


def scan(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, window: int = 10, block_bytes: int = 2 << 20, keep: list[str] | None = None) -> DataFrame:
    """(key, keep..., n_words, spans, items, longest, cleaned) of each document; spans are maximal runs of hit
    words, cleaned is the text without them."""
    keep = [key, *(c for c in keep or [] if c != key and c not in RESULTS)]
    item_type = items.schema[item_key].dataType
    kinds = ", ".join(f"_{i} {documents.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    schema = f"{kinds}, _text string, n_words long, spans array<{SPAN}>, items array<{item_type.simpleString()}>, longest long"
    k = len(keep)
    names = [*(f"_{i}" for i in range(k)), "_text", *RESULTS[:4]]
    df = documents.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.col(text).alias("_text"))
    arrow_item = to_arrow_type(item_type)
    at = pa.list_(pa.struct([(f, pa.int64()) for f in _FIELDS]))
    small_batches(documents.sparkSession)
    before = None
    for block, first, last in _marked(item_blocks(items, item_key, item_text, block_bytes)):
        sent = documents.sparkSession.sparkContext.broadcast(block)  # at most block_bytes of items
        token = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, token=token, first=first, last=last) -> Iterator[pa.RecordBatch]:
            scanner = _scanner(token, sent, window)
            for whole in batches:
                for i in range(0, whole.num_rows, 1000):
                    batch, rows = whole.slice(i, 1000), []
                    texts = [(t or "").encode() for t in batch.column(k).to_pylist()]
                    before = [batch.column(c).to_pylist() for c in (k + 2, k + 3, k + 4)] if not first else [[[]] * len(texts), [[]] * len(texts), [0] * len(texts)]
                    for t, (words, spans, found, longest), *old in zip(texts, scanner.scan(texts), *before, strict=True):
                        spans = _merged(spans + [tuple(s[f] for f in _FIELDS) for s in old[0]])
                        found = sorted({*(x for x in found if x is not None), *old[1]})
                        rows.append((_without(t, spans).decode() if last else t.decode(), words, [dict(zip(_FIELDS, s, strict=True)) for s in spans], found, max(longest, old[2])))
                    columns = [pa.array(c, x) for c, x in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), at, pa.list_(arrow_item), pa.int64()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:k], *columns], names=names)

        df = df.mapInArrow(run, schema)
        if not last:  # the next block works on what is written, so that the driver and a task hold one block each
            path = scratch(documents.sparkSession, "decontam")
            df.write.parquet(path)
            df = documents.sparkSession.read.schema(schema).parquet(path)
            if before:
                delete(documents.sparkSession, before)
            before = path
            sent.destroy()
    return df.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], *RESULTS[:4], F.col("_text").alias("cleaned"))


def hit_words(spans: str = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["last_word"] - s["first_word"] + 1)


def clean(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, keep: list[str], covered: float = 0.8, longest: int | None = None) -> DataFrame:
    """Columns `keep` and `cleaned` of the documents that stay: all but those of whose words a share of `covered`
    or more is hit, or that match `longest` words or more in a row (if given)."""
    found = scan(documents, key, text, items, item_key, item_text, keep=keep)
    gone = (F.col("n_words") > 0) & (hit_words() >= covered * F.col("n_words"))
    if longest is not None:
        gone |= F.col("longest") >= longest
    return found.where(~gone).drop("n_words", "spans", "items", "longest")
