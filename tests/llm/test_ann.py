import math

import numpy as np
import pytest

from quire.llm import ann


def brute(rows, asked, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if asked(i):
            near = [(-ann.cosines(v[None], w[None])[0], j) for j, w in good if j != i]
            out[i] = [(j, -s) for s, j in sorted(near)[:k]]
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(2)
    centres = r.normal(size=(20, 16))
    x = (centres[r.integers(20, size=1500)] + 0.4 * r.normal(size=(1500, 16))).astype(np.float32)
    x[1000:1300] = x[40]  # a vector with many copies
    return [(i, v.tolist()) for i, v in enumerate(x)]


def test_recall_and_odd_rows(spark, vectors):
    odd = [(2000, None), (2020, [0.0] * 16), (2040, [None] + [1.0] * 15), (2060, [float("nan")] * 16), (2080, [float("inf")] * 16), (2100, [1.0]), (None, vectors[3][1]), (2120, [])]
    got = {}
    for r in ann.search(table(spark, vectors + odd).repartition(5), "vec_id", "embedding", lambda i: i % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    want = brute(vectors + odd, lambda i: i % 20 == 0, 5)
    assert got.keys() == want.keys() and all(len(x) == 5 for x in got.values())
    found = [{*got[q]} & {*want[q]} for q in want]
    assert sum(map(len, found)) >= 0.97 * 5 * len(want)
    assert got[40] == want[40] and [j for j, _ in got[1100]] == [40, 1000, 1001, 1002, 1003]


def test_every_block_is_reranked(spark, vectors, monkeypatch):
    """Three blocks of 512 codes, too coarse to tell anything: what is kept of each block is all of it."""
    fit = ann.fit
    monkeypatch.setattr(ann, "CODE_BLOCK", 512)
    monkeypatch.setattr(ann, "fit", lambda x: fit(x, 1, 2))
    found = ann.search(table(spark, vectors).coalesce(1), "vec_id", "embedding", lambda i: i % 20 == 0).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {q: [j for j, _ in near] for q, near in brute(vectors, lambda i: i % 20 == 0, 5).items()}


def test_few_and_repeated(spark):
    few = [(0, [1.0, 0.0]), (20, [1.0, 1.0]), (3, [2.0, 2.0]), (3, [0.0, 1.0])]
    got = ann.search(table(spark, few), "vec_id", "embedding", lambda i: i % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.id) for r in got] == [(0, 1, 3), (0, 2, 20), (0, 3, 3), (20, 1, 3), (20, 2, 0), (20, 3, 3)]
    assert ann.search(table(spark, []), "vec_id", "embedding", lambda i: i % 20 == 0).count() == 0


def test_encoding_improves_with_the_beam():
    x = np.random.default_rng(3).normal(size=(400, 16))
    books = ann.fit(x, 4, 32)
    errors = []
    for beam in (1, 8):
        codes, norms = ann.encode(x, books, beam)
        sums = sum(books[b][codes[:, b]] for b in range(4))
        assert np.allclose(norms, np.sqrt((sums**2).sum(axis=1)))
        errors.append(((x - sums) ** 2).sum())
        assert np.allclose(ann.scores(x[:3], codes, norms, books), x[:3] @ sums.T / norms, atol=1e-4)
    assert errors[1] < errors[0] < (x**2).sum()
