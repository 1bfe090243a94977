import random
import re

import numpy as np
import pytest

from quire.llm import neardup
from quire.llm import textbytes as tb
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    ws = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} - {()}


def brute(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for j in range(len(sets)):
        for i in range(j):
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= 75 * len(x | y) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return {i: (len(s), root[i], root[i] == i) for i, s in enumerate(sets)}


def edited(r, text, n):
    ws = text.split(" ")
    for _ in range(n):
        ws[r.randrange(len(ws))] = r.choice(["new", "Words", "x"])
    return " ".join(ws)


@pytest.mark.parametrize("seed, few", [(1, 64), (2, 3)])
def test_against_brute_force(spark, seed, few, monkeypatch):
    monkeypatch.setattr(neardup, "FEW", few)
    r = random.Random(seed)
    texts = [prose(50 * seed + i, r.choice([1, 3, 5, 9, 40, 120, 150, 200, 500])) for i in range(60)]
    passage = prose(9999, 60)
    for t in r.choices(texts, k=120):
        texts.append(edited(r, t, r.randint(0, 6)).upper() if r.random() < 0.2 else edited(r, t, r.randint(0, 8)))
    texts += [edited(r, texts[9], n % 16) for n in range(60)] + [edited(r, prose(777, 180), n % 16) for n in range(60)]
    texts += [prose(i, 40) + " " + passage for i in range(300, 320)] + [None, "", " \n", "a b", "A\tb", prose(1, 500).replace(" ", " \n ")]
    r.shuffle(texts)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    got = neardup.near_duplicates(df, "doc_id", "text", ["kept"])
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in got.collect()}
    want = brute(texts)
    assert 50 < sum(x[2] for x in want.values()) < len(texts) - 50
    assert got == want


def test_odd_rows(spark, docs, empty_docs):
    got = sorted((x.doc_id, x.component_id) for x in neardup.near_duplicates(docs, "doc_id", "text").collect())
    assert got == [(0, 0), (1, 1), (2, 2), (3, 3), (3, 3), (4, 4), (5, 5), (6, 5), (7, 7), (8, 7), (9, 9), (10, 10)]
    assert neardup.near_duplicates(empty_docs, "doc_id", "text").count() == 0


def test_estimates():
    r = np.random.default_rng(1)
    pool = r.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    regs = neardup.registers([a, b])
    n = np.array([2000])
    assert abs(neardup.estimate(regs[:1], regs[1:], n, n)[0] - 0.6) < 0.12
    assert neardup.chance(n, n)[0] < 1e-3
    assert [len(s) for s in tb.shingle_sets([b"a b c d e f", b"A  b\nc", b""], 5)] == [2, 1, 0]
