import random

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import tokencounts as tc
from tests.llm.conftest import prose

PATH = public_tokenizers.path("piece_bpe_32k.model")
PEER = sentencepiece.SentencePieceProcessor(model_file=PATH)
PARTS = [" ", "  ", "▁", "\n", "\t", "a", "the", " the", "é", "é", "日", "😀", "ing", "\x00", "12", "<s>", "</s>", "<0x0A>", "　"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=15).map("".join) | st.text(max_size=30))
def test_any_text(text):
    assert tc.Lengths(tc.model(PATH), {}).count(text) == len(PEER.encode(text))


def test_long_texts():
    known = tc.Lengths(tc.model(PATH), {})
    for text in (prose(3, 60_000), "x" * 200_000, " " * 200_001, " a" * 100_000, "日本" * 50_000):
        assert known.count(text) == len(PEER.encode(text))


def test_wrong_model_gets_whole_texts(monkeypatch):
    model = tc.Model(PATH)
    model.separable = False
    monkeypatch.setattr(model, "unit", None)
    assert tc.Lengths(model, {}).count("a  b c ") == len(PEER.encode("a  b c "))


def test_the_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tc, "REMEMBERED", 50)
    known = tc.Lengths(tc.model(PATH), {"▁the": 1})
    text = " ".join(f"w{i} the" for i in range(500))
    assert known.count(text) == len(PEER.encode(text)) and len(known) <= 51 and known["▁the"] == 1
    assert known.count("y" * 1000) == len(PEER.encode("y" * 1000)) and "▁" + "y" * 1000 not in known


def test_summary_misses_nothing_frequent():
    r = random.Random(5)
    keys = [f"k{int(r.paretovariate(0.6))}" if r.random() < 0.7 else f"rare{i}" for i in range(60_000)]
    found = tc.Summary(1000)
    for i in range(0, len(keys), 777):
        found.add(keys[i : i + 777])
        assert len(found.counts) <= 2000
    assert {k for k in set(keys) if keys.count(k) >= 600} <= found.frequent(0.01).keys()
    assert all(found.counts[k] <= keys.count(k) <= found.counts[k] + found.short for k in found.counts)


def test_table_round_trip():
    for lengths in ({}, {"▁the": 1, "▁日本😀": 9, "▁▁": 1, "\n": 2}):
        assert tc.Table(lengths).read() == lengths


def test_documents(spark, docs, empty_docs, odd_texts):
    want = sorted((i, len((t or "").encode()), len(PEER.encode(t or ""))) for i, t in [*enumerate(odd_texts), (3, "a")])
    for share in (tc.SHARE, 0.2):  # whatever the first tier holds, counts are the same
        got = tc.count(docs, "doc_id", "text", PATH, 100, share)
        assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()) == want
        assert all(r.over_limit == (r.n_tokens > 100) for r in got.collect())
    assert tc.count(empty_docs, "doc_id", "text", PATH).count() == 0


def test_table_is_small(spark):
    df = spark.createDataFrame([(" ".join(["the"] * 50 + [f"w{i}"]),) for i in range(200)], "text string")
    assert tc.table(df, "text", PATH, 0.1).read() == {"▁the": 1}
