import random
import re

import pytest

from quire.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(text, items, window=10):
    ws = WORD.findall(lowered(text))
    hit, found = set(), set()
    for item, t in items:
        iw = WORD.findall(lowered(t))
        n = min(window, len(iw))
        for a in range(len(iw) - n + 1) if n else ():
            for i in range(len(ws) - n + 1):
                if ws[i : i + n] == iw[a : a + n]:
                    hit |= {*range(i, i + n)}
                    found.add(item)
    return len(ws), len(hit), sorted(i for i in found if i is not None)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
@pytest.mark.parametrize("least", [1, 4])
def test_against_brute_force(spark, block_bytes, least):
    r = random.Random(least)
    say = lambda n: " ".join(r.choice(["a", "B", "c9", "dé"]) + r.choice(["", ".", "\n"]) for _ in range(n))
    items = [(i, say(r.randint(least, 14))) for i in range(12)] + [(3, "zz yy xx ww vv"), (90, None), (91, "--"), (None, say(11))]
    texts = [say(r.randint(0, 60)) for _ in range(60)] + [None, "", "zz YY,xx ww vv", "zz yy xx ww", "a " * 30]
    docs = spark.createDataFrame([(i, t, "n_words") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: x for x in decontam.scan(docs, "doc_id", "text", bench, "item_id", "text", block_bytes=block_bytes).withColumn("n_hit", decontam.hit_words()).collect()}
    assert any(x.n_hit for x in got.values()) and not all(x.n_hit for x in got.values())
    for i, t in enumerate(texts):
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == brute(t, items), t
        assert (got[i].cleaned == (t or "")) == (not got[i].n_hit)
        assert len(WORD.findall(lowered(got[i].cleaned))) == got[i].n_words - got[i].n_hit
    left = decontam.clean(docs, "doc_id", "text", bench, "item_id", "text", ["doc_id"], covered=0.5).collect()
    assert {r.doc_id for r in left} == {i for i, r in got.items() if not r.n_hit or r.n_hit < 0.5 * r.n_words}


def test_empty_tables(spark, docs, empty_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.scan(empty_docs, "doc_id", "text", bench, "item_id", "text").count() == 0
    assert all(r.spans == [] for r in decontam.scan(docs, "doc_id", "text", bench, "item_id", "text").collect())
