"""Toxic passages by maximum-scoring segments (operator 8).

Words, and the beginnings of words (3 to 6 bytes, for inflected and compound forms), are counted in toxic and in
other labelled documents, once a document. Each feature has a log-odds ratio under an informative Dirichlet prior
(all labelled text in proportion, as if `PRIOR` times as many documents had been seen), of which `ERRORS` standard
errors are taken off, so that rare features count little. A word takes the largest of its features, if any exceeds
`DRIFT`, less `DRIFT`, so that words of clean text score negatively on the whole. Both were chosen by folds of the
training rows of tables with 296 and 2,897 labels (README).

A linear scan finds the maximal scoring segments of a text. Best segments of random text follow an extreme value
law: the count expected at score s or more in n words is E = K n exp(-lambda s). K and lambda are fitted to clean
training texts in stretches of `STRETCH` words; segments with E below `SIGNIFICANT` are the toxic passages. The
surprise -log E of a text's best segment becomes a probability by a logistic curve fitted to the labels. (The law of
sums over several segments was tried and ranked held-out texts worse: AUC 0.984 for 0.998.)

The model is fitted to at most `SAMPLE` labelled rows, taken by hash of their keys, of which equal texts with
equal labels count once. Features fall into 2**`HASH_BITS` hashed counts, so that the model is bounded. Every
text is scored, by its words alone.

Labels are a frame (key, label): of several labels of a key the largest counts; null ones are ignored. If the
training rows hold one class alone or none, every score is that class (0 without rows). Null texts count as
empty and score like any text without a toxic word. Repeated rows each get a row. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import textbytes as tb
from quire.llm.shared import parts_for, scratch_scope, small_batches, text_bytes, tidy, written

SAMPLE, HASH_BITS, PRIOR, ERRORS, DRIFT, STRETCH, SIGNIFICANT = 50_000, 22, 0.05, 1.0, 1.5, 100, 1e-3
PREFIXES = (3, 4, 5, 6)
PASSAGE = "struct<first_byte:long,end_byte:long,score:double>"


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of each word (words, 1 + prefixes), its start and end, and the first word of each text."""
    _, starts, ends, first = data = tb.words(texts, alnum=True)
    prefix = tb.FIRST.prefix(data[0])
    out = np.empty((len(starts), 1 + len(PREFIXES)), np.int32)
    for i, n in enumerate((0, *PREFIXES)):  # a word that is no longer than a prefix is its own
        stop = np.minimum(starts + n, ends) if n else ends
        out[:, i] = tb.mix(tb.FIRST.windows(prefix, starts, stop) + np.uint64(n)) >> np.uint64(64 - HASH_BITS)
    return out, starts, ends, first


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) from left to right, in one pass: a stack of candidates
    with the running sums before and after each, and of each the nearest earlier one that starts at a smaller sum.
    Those links are followed instead of the stack, so that each candidate is passed once."""
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    out: list[tuple[int, int]] = []
    smaller: list[int] = []
    for i in np.flatnonzero(scores > 0).tolist():
        start, j = i, len(out) - 1
        while True:
            while j >= 0 and sums[out[j][0]] >= sums[start]:
                j = smaller[j]
            if j < 0 or sums[out[j][1]] >= sums[i + 1]:
                out.append((start, i + 1))
                smaller.append(j)
                break
            start, linked = out[j][0], smaller[j]
            del out[j:], smaller[j:]
            j = linked
    return [(a, b, float(sums[b] - sums[a])) for a, b in out]


@dataclass
class Model:
    """Positive scores of hashed features, the extreme value law, and the logistic curve."""

    hashed: np.ndarray
    scores: np.ndarray
    decay: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    offset: float = 0.0

    def word_scores(self, feats: np.ndarray) -> np.ndarray:
        if not len(self.hashed):
            return np.full(len(feats), -DRIFT)
        at = np.minimum(np.searchsorted(self.hashed, feats), len(self.hashed) - 1)
        return np.where(self.hashed[at] == feats, self.scores[at], 0.0).max(axis=1, initial=0.0) - DRIFT

    def surprise(self, best: float, n: int) -> float:
        return best * self.decay - math.log(max(n, STRETCH) * self.k)  # fitted to stretches, so for no shorter texts

    def probability(self, surprise: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * surprise + self.offset))))


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, tuple]]:
    for whole in batches:
        texts = whole.column(column).to_pylist()
        for a, b in tb.chunks(texts):
            yield whole.slice(a, b - a), features(texts[a:b])


def _counted(train: DataFrame) -> DataFrame:
    """(feature, toxic, clean): documents of each class that hold it. A task sums before it sends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << HASH_BITS), np.int32)
        for batch, (feats, _, _, first) in _chunks(batches, 1):
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))
            once = np.unique((row[:, None] << HASH_BITS | feats).ravel())
            toxic = batch.column(0).to_numpy()[once >> HASH_BITS]
            for y in (0, 1):
                np.add.at(counts[y], once[toxic == y] & (1 << HASH_BITS) - 1, 1)
        found = np.flatnonzero(counts.any(axis=0))
        for i in range(0, len(found), 100_000):
            part = found[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[1][part]), pa.array(counts[0][part])], names=["feature", "toxic", "clean"])

    sent = train.select("toxic", "text").mapInArrow(tidy(run), "feature int, toxic int, clean int")
    return sent.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _log_odds(counts: DataFrame, n_toxic: int, n_clean: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and scores of those that point to toxic text: at most 2**HASH_BITS, in fact far fewer."""
    prior = PRIOR * (n_toxic + n_clean)
    a = (F.col("toxic") + F.col("clean")) * PRIOR
    odds = [F.log((F.col(c) + a) / F.greatest(n + prior - F.col(c) - a, F.lit(0.5))) for c, n in (("toxic", n_toxic), ("clean", n_clean))]
    error = F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("clean") + a))
    score = (odds[0] - odds[1] - ERRORS * error).alias("score")
    found = counts.select("feature", score).where(F.col("score") > DRIFT).toPandas().sort_values("feature")
    return found["feature"].to_numpy(np.int32), found["score"].to_numpy(np.float64)


def _measured(train: DataFrame, model: Model) -> DataFrame:
    """(toxic, n, best, stretches, positive, excess) of each training text; the last three are of stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["toxic", "n", "best", "stretches", "positive", "excess"]
        for batch, (feats, _, _, first) in _chunks(batches, 1):
            scores, rows = model.word_scores(feats), []
            for a, b in zip(first[:-1], first[1:], strict=True):
                s = scores[a:b]
                best = max((x for _, _, x in segments(s)), default=0.0)
                each = [max((x for _, _, x in segments(s[i : i + STRETCH])), default=0.0) for i in range(0, len(s), STRETCH)] if best else []
                rows.append((int(b - a), best, -(-int(b - a) // STRETCH), sum(x > 0 for x in each), sum(each)))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return train.select("toxic", "text").mapInArrow(run, "toxic int, n long, best double, stretches long, positive long, excess double")


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, with a little ridge."""
    w = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + 1e-2 * w
        step = np.linalg.solve(design.T @ (design * (weight * p * (1 - p))[:, None]) + 1e-2 * np.eye(2), gradient)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(documents: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, label: str, sample: int = SAMPLE) -> Model:
    """A model of documents whose key has a label; a text is toxic if its label is positive."""
    spark = documents.sparkSession
    small_batches(spark)
    marked = labels.where(F.col(label).isNotNull() & F.col(label_key).isNotNull()).groupBy(F.col(label_key).alias("_id")).agg((F.max(label) > 0).cast("int").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("_id"), "_id").limit(sample)  # the documented bound of the training sample
    rows = documents.select(F.col(key).alias("_id"), text_bytes(text).alias("text")).join(F.broadcast(chosen), "_id")
    parts = parts_for(sample, 4_000, 1)  # of a bounded sample
    with scratch_scope(spark):
        return _fitted(written(rows.select("toxic", "text").dropDuplicates().coalesce(parts), "toxicity"))


def _fitted(train: DataFrame) -> Model:
    sizes = {r.toxic: r["count"] for r in train.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Model(np.zeros(0, np.int32), np.zeros(0), offset=500.0 if sizes.get(1) else -500.0)
    model = Model(*_log_odds(_counted(train), sizes[1], sizes[0]))
    measured = written(_measured(train, model), "toxicity")
    clean = measured.where("toxic = 0").agg(*[F.sum(c).alias(c) for c in ("stretches", "positive", "excess")]).first()
    model.decay = (clean.positive + 1) / (clean.excess + 1)  # one stretch more, of score 1, so that both exist
    model.k = (clean.positive + 1) / ((clean.stretches + 1) * STRETCH)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [round(max(-50.0, min(200.0, model.surprise(f, n))), 1) for f, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.float64())], names=["toxic", "x"])

    bins = measured.select("toxic", "best", "n").mapInArrow(steps, "toxic int, x double").groupBy("x", "toxic").count().toPandas()  # 2,501 steps at most
    model.slope, model.offset = _logistic(bins["x"].to_numpy(float), bins["toxic"].to_numpy(float), bins["count"].to_numpy(float))
    model.slope = max(0.0, model.slope)
    return model


def score(documents: DataFrame, key: str, text: str, model: Model, keep: list[str] | None = None) -> DataFrame:
    """(key, keep..., n_words, score, passages) of each document: significant passages, best first. Columns of
    `keep` that are named like a result are left out."""
    keep = [key, *(c for c in keep or [] if c not in (key, "n_words", "score", "passages"))]
    names = [*keep, "n_words", "score", "passages"]
    sent = documents.sparkSession.sparkContext.broadcast(model)  # bounded by HASH_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        kind = pa.list_(pa.struct([("first_byte", pa.int64()), ("end_byte", pa.int64()), ("score", pa.float64())]))
        for batch, (feats, starts, ends, first) in _chunks(batches, len(keep)):
            scores, rows, base = model.word_scores(feats), [], 0
            for t, a, b in zip(batch.column(len(keep)), first[:-1], first[1:], strict=True):
                found = sorted(segments(scores[a:b]), key=lambda s: (-s[2], s[0]))
                surprise = model.surprise(found[0][2] if found else 0.0, int(b - a))
                toxic = [s for s in found if model.surprise(s[2], int(b - a)) > -math.log(SIGNIFICANT)]
                passages = [{"first_byte": int(starts[a + i] - base), "end_byte": int(ends[a + j - 1] - base), "score": s} for i, j, s in toxic]
                rows.append((int(b - a), model.probability(surprise), passages))
                base += len(t.as_buffer()) + 1
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.float64(), kind), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=names)

    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    rows = documents.select(*[F.col(c) for c in keep], text_bytes(text).alias("_text"))
    return rows.mapInArrow(tidy(run), f"{kinds}, n_words long, score double, passages array<{PASSAGE}>")
