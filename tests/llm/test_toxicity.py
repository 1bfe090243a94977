import itertools
import math
import random
import re
import time

import numpy as np
import pytest

from quire.llm import toxicity
from tests.llm.conftest import prose


def brute_segments(scores):
    """Of the segments with the largest score, the leftmost and shortest, then the same on both its sides."""
    n = len(scores)
    best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(n) for b in range(a + 1, n + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    a, b = -best[2], -best[2] - best[1]
    return [*brute_segments(scores[:a]), (a, b, best[0]), *[(x + b, y + b, s) for x, y, s in brute_segments(scores[b:])]]


def test_segments():
    r = random.Random(1)
    for _ in range(300):
        scores = [r.choice([-7, -3, -1.5, -1, 2, 4, 5.25]) + r.random() / 64 for _ in range(r.randint(0, 14))]
        got, want = toxicity.segments(np.array(scores)), brute_segments(scores)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert all(abs(a[2] - b[2]) < 1e-9 for a, b in itertools.zip_longest(got, want))


def test_segments_of_clean_text_are_linear():
    """Every positive word starts lower than all before it; walking over them takes 200 million steps."""
    scores = np.tile([1.0, -3.0], 20_000)
    start = time.process_time()
    got = toxicity.segments(scores)
    assert time.process_time() - start < 3
    assert got == [(i, i + 1, 1.0) for i in range(0, 40_000, 2)]


@pytest.fixture(scope="module")
def model_rows(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        words, toxic = prose(i, r.randint(20, 200)).split(" "), i % 6 == 0
        if toxic:
            for _ in range(r.randint(2, 5)):
                words[r.randrange(len(words))] = r.choice(["nasty", "vile", "grobian" + r.choice(["en", "s", "isch"])])
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels + [(3, None), (None, 1), (9999, 1), (6, 0)], "doc_id long, toxic int")


def test_held_out(spark, model_rows):
    docs, labels = model_rows
    model = toxicity.fit(docs, "doc_id", "text", labels.where("doc_id % 4 != 1 or doc_id is null"), "doc_id", "toxic")
    got = {r.doc_id: r for r in toxicity.score(docs, "doc_id", "text", model, ["score"]).collect()}
    held = [i for i in got if i % 4 == 1 or i % 4 == 2]
    right = sum((got[i].score >= 0.3) == (i % 6 == 0) for i in held)
    assert right >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got.values())
    text = {r.doc_id: r.text for r in docs.collect()}
    for i in range(0, 600, 30):
        p = got[i].passages[0]
        assert any(w in text[i].encode()[p.first_byte : p.end_byte].decode() for w in ("nasty", "vile", "grobian"))


def test_odd_rows(spark, docs, empty_docs, model_rows):
    model = toxicity.fit(*model_rows[:1], "doc_id", "text", model_rows[1], "doc_id", "toxic")
    got = toxicity.score(docs, "doc_id", "text", model).collect()
    assert len(got) == docs.count() and all(0 <= r.score < 0.3 and r.passages == [] for r in got if r.n_words < 3)
    assert toxicity.score(empty_docs, "doc_id", "text", model).count() == 0
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    one_class = spark.createDataFrame([(3, 1)], "doc_id long, toxic int")
    for labels, want in ((no_labels, 0), (one_class, 1)):
        one = toxicity.fit(docs, "doc_id", "text", labels, "doc_id", "toxic")
        assert all(abs(r.score - want) < 1e-9 for r in toxicity.score(docs, "doc_id", "text", one).collect())


def plain_scores(texts, labels):
    """The model by dictionaries of strings, sums of all stretches of words, and loops."""

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))

    def feats(w):
        raw = w.encode()
        return {(0, raw), *((n, raw[:n]) for n in toxicity.PREFIXES)}

    train = {(labels[i], t) for i, t in enumerate(texts) if i in labels}
    n = {y: sum(x == y for x, _ in train) for y in (0, 1)}
    counts = {}
    for y, t in train:
        for f in {f for w in words(t) for f in feats(w)}:
            counts.setdefault(f, [0, 0])[y] += 1
    weight = {}
    for f, (clean, toxic) in counts.items():
        a, prior = (clean + toxic) * toxicity.PRIOR, toxicity.PRIOR * len(train)
        odds = [math.log((c + a) / max(m + prior - c - a, 0.5)) for c, m in ((toxic, n[1]), (clean, n[0]))]
        score = odds[0] - odds[1] - toxicity.ERRORS * math.sqrt(1 / (toxic + a) + 1 / (clean + a))
        if score > toxicity.DRIFT:
            weight[f] = score

    def best(ws):
        s = [max(weight.get(f, 0.0) for f in feats(w)) - toxicity.DRIFT for w in ws]
        return max((sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=0.0) if any(x > 0 for x in s) else 0.0

    stretches = [best(words(t)[i : i + toxicity.STRETCH]) for y, t in train if not y for i in range(0, len(words(t)), toxicity.STRETCH)]
    positive = [x for x in stretches if x > 0]
    decay, k = (len(positive) + 1) / (sum(positive) + 1), (len(positive) + 1) / ((len(stretches) + 1) * toxicity.STRETCH)
    surprise = lambda t: best(words(t)) * decay - math.log(max(len(words(t)), toxicity.STRETCH) * k)
    bins = {}
    for y, t in train:
        x = round(max(-50.0, min(200.0, surprise(t))), 1)
        bins[x, y] = bins.get((x, y), 0) + 1
    slope, offset = 0.0, 0.0
    for _ in range(100):  # Newton's steps, written out
        p = {b: 1 / (1 + math.exp(-(slope * b[0] + offset))) for b in bins}
        g = [sum(c * (p[b] - b[1]) * v for b, c in bins.items() for v in [b[0] if i == 0 else 1.0]) + 1e-2 * (slope, offset)[i] for i in (0, 1)]
        h = [sum(c * p[b] * (1 - p[b]) * b[0] ** e for b, c in bins.items()) for e in (2, 1, 0)]
        a, b_, d = h[0] + 1e-2, h[1], h[2] + 1e-2
        step = ((d * g[0] - b_ * g[1]) / (a * d - b_ * b_), (a * g[1] - b_ * g[0]) / (a * d - b_ * b_))
        most = min(1.0, 5 / max(1e-9, *map(abs, step)))
        slope, offset = slope - most * step[0], offset - most * step[1]
    return [1 / (1 + math.exp(-(max(0.0, slope) * surprise(t) + offset))) for t in texts]


def test_scores_equal_a_plain_model(spark):
    r = random.Random(11)
    texts, labels = [], {}
    for i in range(150):
        ws = prose(900 + i, r.randint(1, 60)).split()
        if i % 5 == 0:
            for _ in range(4):
                ws[r.randrange(len(ws))] = r.choice(["nasty", "nastily", "Vile", "filth"])
        elif i % 7 == 0:
            ws[0] = "vile"
        texts.append(" ".join(ws))
        if i % 3:
            labels[i] = int(i % 5 == 0)
    texts += ["", "nasty filth"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = spark.createDataFrame(list(labels.items()), "d long, toxic int")
    got = {x.doc_id: x.score for x in toxicity.score(df, "doc_id", "text", toxicity.fit(df, "doc_id", "text", known, "d", "toxic")).collect()}
    want = plain_scores(texts, labels)
    assert max(got.values()) > 0.9 and min(got.values()) < 0.1
    assert all(abs(got[i] - x) < 1e-6 for i, x in enumerate(want))
