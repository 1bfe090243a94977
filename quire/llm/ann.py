"""Nearest neighbours by additive quantisation (operator 5).

A vector is written as a sum of full-dimensional codewords, one from each of `BOOKS` codebooks that were fitted
to residuals one after the other; a beam search picks the codewords together. Scores against a query are sums
of entries of a lookup table (query times every codeword), divided by the stored norm of the sum. Each block of
queries meets each block of codes and keeps its best `keep` per query; what every block kept is scored again with
the original vectors, so that the shortlist grows with the table.

Codebooks are fitted to at most `SAMPLE` vectors, taken by hash; every vector is encoded. Measured recall is in
the README.

Vectors that are null, of another length than most, zero, or that hold null or non-finite components take no
part. Ties go to the smaller id. A null id takes no part either. Rows that repeat an id are candidates each.
Fewer candidates than asked for are all returned. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import checkpointed, parts_for

BOOKS, WORDS, BEAM, SAMPLE, ROUNDS = 16, 256, 4, 8192, 8
#: Vectors in a block of codes, queries in a block of queries.
CODE_BLOCK, QUERY_BLOCK = 65_536, 256
#: Partitions of query blocks at most; each meets each block of codes in a task.
MOST_PARTS = 64


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words**2).sum(axis=1) - 2 * x @ words.T, axis=1)


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 7) -> np.ndarray:
    """Codebooks (books, words, dimensions): k-means of what the books before leave over."""
    r = np.random.default_rng(seed)
    out, rest = [], x.astype(np.float64)
    for _ in range(books):
        k = min(words, len(rest))
        centres = rest[r.permutation(len(rest))[:k]].copy()
        for _ in range(ROUNDS):
            of = _nearest(rest, centres)
            count = np.bincount(of, minlength=k)
            sums = np.zeros_like(centres)
            np.add.at(sums, of, rest)
            centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], rest[r.integers(len(rest), size=k)])
        rest = rest - centres[_nearest(rest, centres)]
        out.append(np.concatenate([centres, np.zeros((words - k, x.shape[1]))]))
    return np.stack(out)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, books) and norms of the sums: the best of `beam` partial sums that survive each book."""
    n, (m, k, _) = len(x), books.shape
    codes = np.zeros((n, 1, 0), np.int64)
    rest = x[:, None, :].astype(np.float64)
    for b in range(m):
        error = (rest**2).sum(axis=2)[:, :, None] - 2 * rest @ books[b].T + (books[b] ** 2).sum(axis=1)
        width = min(beam, error.shape[1] * k)
        flat = error.reshape(n, -1)
        best = np.argpartition(flat, width - 1, axis=1)[:, :width]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, axis=1), axis=1, kind="stable"), axis=1)
        parent, word = best // k, best % k
        codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], axis=1), word[:, :, None]], axis=2)
        rest = np.take_along_axis(rest, parent[:, :, None], axis=1) - books[b][word]
    sums = x - rest[:, 0]
    return codes[:, 0].astype(np.uint8), np.sqrt((sums**2).sum(axis=1))


def scores(queries: np.ndarray, codes: np.ndarray, norms: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(queries, codes) table of approximate cosines of unit queries."""
    out = np.zeros((len(queries), len(codes)), np.float32)
    for b in range(len(books)):
        table = (queries @ books[b].T).astype(np.float32)
        out += table[:, codes[:, b]]
    return out / np.maximum(norms, 1e-12).astype(np.float32)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows, in double precision; equal rows give equal results wherever they stand."""
    dot = (a * b).sum(axis=1)
    return dot / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists are equally long and hold no nulls."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def valid(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(finite)
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (usual.d if usual else 0))


def _sample(rows: DataFrame) -> np.ndarray:
    """At most SAMPLE vectors: those of the smallest hashes of their ids, so of any size of table."""
    found = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    x = _matrix(found["v"].combine_chunks())
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _blob(*arrays: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """One row that holds whole arrays."""
    return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], names=names)


def _first_of_equal(ids: np.ndarray, marks: np.ndarray, k: int) -> np.ndarray:
    """Places of the k + 1 smallest ids of each mark. Of equal vectors no more can be among the k nearest."""
    order = np.lexsort((ids, marks))
    start = np.flatnonzero(np.append(True, marks[order][1:] != marks[order][:-1])) if len(order) else order
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[rank <= k]


def _codes(rows: DataFrame, books: np.ndarray, blocks: int, k: int) -> DataFrame:
    """Every vector encoded, in blocks: ids in order, codes and norms."""
    sent = rows.sparkSession.sparkContext.broadcast(books)  # BOOKS x WORDS vectors, whatever the table's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                ids, marks = batch.column(0).to_numpy().astype(np.int64), batch.column(2).to_numpy()
                take = _first_of_equal(ids, marks, k)
                x = _matrix(batch.column(1))[take]
                codes, norms = encode(x / np.sqrt((x * x).sum(axis=1, keepdims=True)), sent.value)
                yield _blob(ids[take], marks[take], codes, norms, names=["ids", "marks", "codes", "norms"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [r for b in batches for r in b.to_pylist()]
        if kept:
            ids, marks, codes, norms = (np.frombuffer(b"".join(r[c] for r in kept), t) for c, t in (("ids", np.int64), ("marks", np.int64), ("codes", np.uint8), ("norms", np.float64)))
            take = _first_of_equal(ids, marks, k)
            take = take[np.argsort(ids[take], kind="stable")]
            yield _blob(ids[take], codes.reshape(len(ids), -1)[take], norms[take], names=["ids", "codes", "norms"])

    small = rows.select("id", "v", F.xxhash64("v").alias("mark")).mapInArrow(run, "ids binary, marks binary, codes binary, norms binary")
    return small.repartition(blocks).mapInArrow(pack, "ids binary, codes binary, norms binary")


def _tiles(queries: DataFrame, codes: DataFrame, books: np.ndarray, keep: int, parts: int) -> DataFrame:
    """(query, id, approximate score): the best `keep` of each block of codes for each query. Each block of
    queries, dealt to `parts` partitions, meets each block of codes; a task holds one of each at a time."""
    sent = queries.sparkSession.sparkContext.broadcast(books)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, QUERY_BLOCK):
                batch = whole.slice(i, QUERY_BLOCK)
                yield _blob(batch.column(0).to_numpy().astype(np.int64), _matrix(batch.column(1)), names=["qids", "queries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qids, ids = np.frombuffer(row["qids"], np.int64), np.frombuffer(row["ids"], np.int64)
                q = np.frombuffer(row["queries"], np.float64).reshape(len(qids), -1)
                q = q / np.sqrt((q * q).sum(axis=1, keepdims=True))
                codes, norms = np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1), np.frombuffer(row["norms"])
                n = min(keep, len(ids))
                for i in range(0, len(qids), 32):
                    s = scores(q[i : i + 32], codes, norms, sent.value)
                    s[qids[i : i + 32, None] == ids[None, :]] = -np.inf  # a query is no candidate of its own
                    least = np.partition(s, len(ids) - n, axis=1)[:, len(ids) - n, None]
                    over, ties = s > least, s == least  # of those that tie for the last place, the smaller ids
                    take = over | ties & (np.cumsum(ties, axis=1, dtype=np.int32) <= n - over.sum(axis=1, keepdims=True))
                    a, b = np.nonzero(take & np.isfinite(s))
                    columns = [pa.array(qids[i + a]), pa.array(ids[b]), pa.array(s[a, b].astype(np.float64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["query", "id", "near"])

    blocks = queries.mapInArrow(pack, "qids binary, queries binary").repartition(parts)
    return blocks.crossJoin(codes).mapInArrow(run, "query long, id long, near double")


def search(df: DataFrame, key: str, vector: str, is_query: Callable[[Column], Column], k: int = 5, keep: int = 512) -> DataFrame:
    """(query_id, rank, id, score) of the k nearest of each row of df where the condition is_query(id) holds, of
    the best `keep` of every block of codes."""
    rows = checkpointed(valid(df, key, vector))
    sample = _sample(rows)
    if not len(sample):
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), "id", F.lit(0.0).alias("score")).limit(0)
    books = fit(sample)
    queries = rows.where(is_query(F.col("id"))).dropDuplicates(["id"])
    codes = checkpointed(_codes(rows, books, parts_for(rows.count(), CODE_BLOCK, 1), k))
    parts = min(MOST_PARTS, parts_for(queries.count(), QUERY_BLOCK, 1))
    short = _tiles(queries, codes, books, keep, parts).select("query", "id").distinct()
    asked = queries.select(F.col("id").alias("query"), F.col("v").alias("q"))
    pairs = short.join(asked, "query").join(rows, "id")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = cosines(_matrix(batch.column(2)), _matrix(batch.column(3))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["query_id", "id", "score"])

    exact = pairs.select("query", "id", "q", "v").mapInArrow(rerank, "query_id long, id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return exact.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
