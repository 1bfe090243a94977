"""Windows of a few bytes in texts and markers, by which markers are looked for, counted in numpy within tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of the longest window; bits of the map that rules windows out; positions that are looked at together.
LONGEST, MAP_BITS, PIECE = 8, 22, 1 << 20


def _slot(codes: np.ndarray, width: int) -> np.ndarray:
    return ((codes + np.uint64(width)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MAP_BITS)


def _found(texts: pa.Array, width: int, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, codes) of windows that lie within one text, once a row and piece: all of them, or those whose slot is wanted."""
    texts = texts.cast(pa.large_string())
    _, ends, held = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if held is None or ends[0] == ends[-1]:
        return
    data, ends = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]], ends - ends[0]
    padded = np.concatenate([data, np.zeros(LONGEST, np.uint8)])
    each = np.ndarray(len(data), "<u8", padded, strides=(1,))  # eight bytes from every position on
    mask = np.uint64((1 << 8 * width) - 1)
    for start in range(0, len(data), PIECE):
        codes = each[start : start + PIECE] & mask
        at = np.arange(len(codes)) if wanted is None else np.flatnonzero(wanted[_slot(codes, width)])
        rows = np.searchsorted(ends, at + start, "right") - 1
        inside = at + start + width <= ends[rows + 1]
        rows, codes = rows[inside], codes[at[inside]]
        order = np.lexsort((codes, rows))
        rows, codes = rows[order], codes[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (codes[1:] != codes[:-1])
        yield rows[new], codes[new]


def of_markers(markers: DataFrame, marker: str, longest: int) -> DataFrame:
    """(_m, _w, _g, _s): the windows of each marker that is neither null nor empty, as wide as the marker at most; their
    width, bytes as a number and slot in the map. A long marker's window may come twice."""
    def run(batches):
        for batch in batches:
            lengths = np.minimum(np.asarray(pa.compute.binary_length(batch[0])), longest)
            for width in np.unique(lengths):
                some = batch[0].filter(pa.array(lengths == width))
                for rows, codes in _found(some, int(width)):
                    slots = _slot(codes, int(width)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([some.take(pa.array(rows)), pa.array(np.full(len(rows), width, np.int32)), pa.array(codes.view(np.int64)), pa.array(slots)], ["_m", "_w", "_g", "_s"])

    return markers.where(F.length(marker) > 0).select(F.col(marker).alias("_m")).distinct().mapInArrow(run, "_m string, _w int, _g long, _s int")


def in_texts(texts: DataFrame, key: str, text: str, runs: DataFrame) -> DataFrame:
    """(_k, _w, _g): windows of texts that may be among runs (of_markers(), kept). What rules others out is a map of as
    many bits for any list, which is made here; a few windows that are none of the runs pass it. A long text's
    window may come twice."""
    word = F.shiftright("_s", 6)
    bits = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    for at, held in runs.groupBy(word.alias("_at")).agg(F.bit_or(F.expr("shiftleft(1L, _s & 63)"))).collect():  # as many rows as the map has words, at most
        bits[at] = np.uint64(held & ((1 << 64) - 1))
    widths = sorted(r[0] for r in runs.select("_w").distinct().collect())  # eight at most

    def run(batches):
        wanted = np.unpackbits(bits.view(np.uint8), bitorder="little").view(bool)
        for batch in batches:
            for width in widths:
                for rows, codes in _found(batch[1], width, wanted):
                    yield pa.RecordBatch.from_arrays([batch[0].take(pa.array(rows)), pa.array(np.full(len(rows), width, np.int32)), pa.array(codes.view(np.int64))], ["_k", "_w", "_g"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.where(F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.col(text).alias("_t")).mapInArrow(run, f"_k {kind}, _w int, _g long")
