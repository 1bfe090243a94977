"""Segments of a kept index: the terms of one part of all terms, each with nodes and term frequencies, as an Arrow batch
in one row. They are made from texts and brought together in numpy within tasks; a frequency that is no number says that the
node has the term no more."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.ipc
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as tx

#: A row; its segment is an Arrow batch of _schema(), zstd, of so many bytes.
ROW = "term_part int, size int, segment binary"
#: Bytes of texts and entries that are looked at together, a document or part at least; rows that are handed on at once.
PIECE, LOT, ROWS = 8 << 20, 1 << 21, 1 << 18

_LETTERS = bytes(chr(i) in "abcdefghijklmnopqrstuvwxyz0123456789" for i in range(256))


def part(term: Column, parts: int) -> Column:
    """The part of a term, of one word or two; the same as _parts()."""
    crc = lambda i: F.crc32(F.split_part(term, F.lit(" "), F.lit(i)).cast("binary"))
    return F.pmod(31 * crc(1) + crc(2), F.lit(parts)).cast("int")


def _parts(words: pa.Array, first: np.ndarray, second: np.ndarray, parts: int) -> np.ndarray:
    """Of terms by the numbers of their words; a second one below 0 is none."""
    crc = np.fromiter([*map(zlib.crc32, words.cast(pa.binary()).to_pylist()), 0], np.int64)  # that of none is last
    return ((31 * crc[first] + crc[second]) % parts).astype(np.uint16 if parts <= 1 << 16 else np.int64)  # sorted sooner if short


def _changed(x: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    new = np.ones(len(x), bool)
    new[1:] = np.logical_or.reduce([y[1:] != y[:-1] for y in (x, *more)])
    return np.flatnonzero(new)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text, word) of each word that tx.terms() takes, in order, both as numbers, and the words. Texts are normal."""
    texts = texts.cast(pa.large_string())
    _, ends, held = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held is not None else np.zeros(0, np.uint8)
    starts = ends[:-1] - ends[0]
    letter = np.frombuffer(bytearray(data.tobytes().translate(_LETTERS)), bool)
    inner = letter[1:] & letter[:-1]  # whether a word goes on from one byte to the next
    inner[starts[(starts > 0) & (starts < len(data))] - 1] = False
    first = np.flatnonzero(letter & np.concatenate([[True], ~inner])[: len(data)])
    last = np.flatnonzero(letter & np.concatenate([~inner, [True]])[: len(data)])
    short = last - first < 2
    letter[first[short]] = letter[last[short]] = False
    first, last = first[~short], last[~short]
    bounds = np.concatenate([[0], np.cumsum(last + 1 - first)])
    words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(bounds), pa.py_buffer(data[letter])).dictionary_encode()
    known = words.dictionary.cast(pa.string())
    codes = np.asarray(words.indices)
    kept = ~np.asarray(pa.compute.is_in(known, value_set=pa.array(tx.STOPWORDS)))[codes]
    return (np.searchsorted(starts, first, "right") - 1)[kept], codes[kept], known


def _schema(kind: pa.DataType) -> pa.Schema:
    """`entries` has the (nodes, tfs) of each term."""
    return pa.schema([("terms", pa.string()), ("entries", pa.list_(pa.struct([("nodes", kind), ("tfs", pa.float64())])))])


def _rows(of_part: np.ndarray, terms: pa.Array, sizes: np.ndarray, nodes: pa.Array, tfs: np.ndarray) -> pa.RecordBatch:
    """A segment for each part; terms are in order of their parts."""
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    entries = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([nodes, pa.array(tfs)], ["nodes", "tfs"]))
    each = pa.RecordBatch.from_arrays([terms, entries], schema=_schema(nodes.type))
    at = _changed(of_part)
    held = [each.slice(a, b - a).serialize() for a, b in zip(at, [*at[1:], len(of_part)])]
    packed = [pa.compress(x, "zstd", asbytes=True) for x in held]
    return pa.RecordBatch.from_arrays([pa.array(of_part[at].astype(np.int32)), pa.array([x.size for x in held], pa.int32()), pa.array(packed, pa.binary())], ["term_part", "size", "segment"])


def _piece(batch: pa.RecordBatch, parts: int) -> Iterator[pa.RecordBatch]:
    """The segments of some documents: (node_id, texts, weights, old, old_weights)."""
    each = np.arange(len(batch))
    counts = [_lengths(batch[c]) for c in ("texts", "old")]
    doc = np.concatenate([np.repeat(each, n) for n in counts])
    old = np.repeat([False, True], [n.sum() for n in counts])
    weight = np.concatenate([np.asarray(batch[c].flatten()) for c in ("weights", "old_weights")])
    text, word, known = _words(pa.concat_arrays([batch[c].flatten() for c in ("texts", "old")]))
    if not len(word):
        return
    # texts numbered anew, so that those of a document follow each other
    order = np.argsort(doc, kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    doc, old, weight = doc[order], old[order], weight[order]
    n, bits = len(known), len(order).bit_length()
    if (n + n * n).bit_length() + bits > 63 and len(batch) > 1:
        half = len(batch) // 2
        yield from _piece(batch.slice(0, half), parts)
        yield from _piece(batch.slice(half), parts)
        return
    word = word.astype(np.int64)
    pair = np.flatnonzero(text[1:] == text[:-1])
    keys = np.concatenate([word, n + word[pair] * n + word[pair + 1]])
    found = np.sort((keys << bits) | number[np.concatenate([text, text[pair]])])
    key, text = found >> bits, found & ((1 << bits) - 1)
    at = _changed(key, doc[text])
    if old.any():
        total = lambda mine: (np.add.reduceat(np.where(mine, weight[text], 0.0), at), np.logical_or.reduceat(mine, at))
        (tf, live), (was, had) = total(~old[text]), total(old[text])
        tf, at = np.where(live, tf, np.nan), at[changes := ~(live & had & (tf == was))]
        tf = tf[changes]
    else:
        tf = np.add.reduceat(weight[text], at)
    key, node = key[at], doc[text[at]]
    if not len(key):
        return
    at = _changed(key)
    sizes, key = np.diff(np.append(at, len(key))), key[at]
    one = key < n
    first, second = np.where(one, key, (key - n) // n), np.where(one, -1, (key - n) % n)
    of_part = _parts(known, first, second, parts)
    order = np.argsort(of_part, kind="stable")
    entries = np.repeat(at[order] - np.concatenate([[0], np.cumsum(sizes[order])[:-1]]), sizes[order]) + np.arange(len(node))
    first, second = first[order], second[order]
    terms = pa.compute.binary_join_element_wise(known.take(pa.array(first)), known.take(pa.array(second, mask=second < 0)), " ", null_handling="skip")
    yield _rows(of_part[order], terms, sizes[order], batch["node_id"].take(pa.array(node[entries])), tf[entries])


def _lengths(lists: pa.Array) -> np.ndarray:
    """Of null, 0."""
    return np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))


def _bytes(texts: pa.Array) -> np.ndarray:
    """Of each row's list."""
    ends = np.cumsum(_lengths(texts))
    total = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.binary_length(texts.flatten()), np.int64))])
    return np.diff(total[ends], prepend=0)


def of_texts(parts: int) -> Callable:
    """For mapInArrow: (node_id, texts, weights, old, old_weights) of documents to segments of what changes, ROW.
    Weights go with texts; a term's frequency is the sum over its texts."""
    def run(batches):
        for batch in batches:
            cuts = np.flatnonzero(np.diff(np.cumsum(_bytes(batch["texts"]) + _bytes(batch["old"])) // PIECE, prepend=0))
            for a, b in zip([0, *cuts], [*cuts, len(batch)]):
                if a < b:
                    yield from _piece(batch.slice(a, b - a), parts)

    return run


def _lots(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[list[tuple[int, int, pa.RecordBatch]]]:
    """(part, version, segment) of rows in order of their parts, many at a time; all of a part are in one lot."""
    held, n, schema = [], 0, _schema(kind)
    for batch in batches:
        for of_part, version, size, packed in zip(*(batch[c].to_pylist() for c in ("term_part", "version", "size")), batch["segment"]):
            if n >= LOT and held[-1][0] != of_part:
                yield held
                held, n = [], 0
            segment = pa.ipc.read_record_batch(pa.decompress(packed.as_buffer(), size, "zstd"), schema)
            held.append((of_part, version, segment))
            n += len(segment["entries"].flatten())
    if held:
        yield held


def _newest(lot: list[tuple[int, int, pa.RecordBatch]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array, np.ndarray]:
    """(part of each term, term, sizes, terms, nodes, tfs): of each term and node the entry of the newest version, where
    that has the term, in order of their terms, which are in order of their parts. A node is once in a version."""
    of_part, version, each = zip(*lot)
    entries = pa.concat_arrays([x["entries"] for x in each])
    sizes, (nodes, tf) = _lengths(entries), entries.flatten().flatten()
    words, tf = pa.concat_arrays([x["terms"] for x in each]).dictionary_encode(), np.asarray(tf)
    codes = np.asarray(words.indices)
    parts = np.empty(len(words.dictionary), np.int32)
    parts[codes] = np.repeat(of_part, [len(x) for x in each])
    term = np.repeat(codes, sizes).astype(np.int64)
    versions, place = np.unique(version, return_inverse=True)
    if len(versions) == 1:
        bits = len(term).bit_length()
        kept = np.sort((term << bits) | np.arange(len(term))) & ((1 << bits) - 1)
    else:
        place = np.repeat(np.repeat(place, [len(x) for x in each]), sizes)
        node = np.asarray(nodes.dictionary_encode(null_encoding="encode").indices).astype(np.int64)
        bits = len(node).bit_length(), len(versions).bit_length()
        few = len(parts).bit_length() + sum(bits) < 64
        order = np.argsort((((term << bits[0]) | node) << bits[1]) | place) if few else np.lexsort((place, node, term))
        kept = order[np.append(_changed(term[order], node[order])[1:], len(order)) - 1]
    kept = kept[~np.isnan(tf[kept])]
    term = term[kept]
    at = _changed(term)
    return parts[term[at]], term[at], np.diff(np.append(at, len(term))), words.dictionary, nodes.take(pa.array(kept)), tf[kept]


def merged(kind: pa.DataType) -> Callable:
    """For mapInArrow: ROW and version, in order of term_part, to a segment for each part."""
    def run(batches):
        for lot in _lots(batches, kind):
            of_part, term, sizes, terms, nodes, tfs = _newest(lot)
            if len(term):
                yield _rows(of_part, terms.take(pa.array(term)), sizes, nodes, tfs)

    return run


def opened(kind: pa.DataType) -> Callable:
    """For mapInArrow: the same rows to (term, node_id, tf, df)."""
    def run(batches):
        for lot in _lots(batches, kind):
            _, term, sizes, terms, nodes, tfs = _newest(lot)
            df, term = np.repeat(sizes, sizes), np.repeat(term, sizes)
            for a in range(0, len(term), ROWS):
                b = a + ROWS
                yield pa.RecordBatch.from_arrays([terms.take(pa.array(term[a:b])), nodes[a:b], pa.array(tfs[a:b]), pa.array(df[a:b])], ["term", "node_id", "tf", "df"])

    return run
