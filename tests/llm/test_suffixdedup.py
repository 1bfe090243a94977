import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.llm import queries, suffixdedup
from quire.llm.shared import scratch_scope
from tests.llm.conftest import prose


def brute(texts, length):
    """For each text a list of marks of the bytes to go."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        until = 0
        for i in range(len(t)):
            if i + length <= len(t) and seen[t[i : i + length]] > 1:
                until = i + length
            gone[i] = i < until
        out.append(gone)
    return out


def expected(text, gone):
    spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
    return len(text), sum(gone), spans, bytes(b for b, g in zip(text, gone, strict=True) if not g)


def corpus(seed):
    r = random.Random(seed)
    passages = [prose(100 * seed + i, 150)[: r.randint(380, 900)] for i in range(6)] + ["ha " * 300, "z" * 700]
    texts = []
    for i in range(60):
        t = prose(1000 * seed + i, r.randint(0, 200))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a, at = r.randint(0, 200), r.randint(0, len(t))
            p = p[a : r.randint(a, len(p))] if r.random() < 0.5 else p
            t = t[:at] + p + t[at:]
        texts.append(t)
    for t in r.sample(texts, 15):  # near copies: one character changed, some cut
        at = r.randint(0, max(0, len(t) - 1))
        texts.append(t[:at] + r.choice(["Q", "", "é"]) + t[at + 1 :])
    return texts + r.sample(texts, 8)


@pytest.mark.parametrize("seed, block_bytes", [(1, 1 << 23), (2, 3000), (3, 3000), (4, 500)])
def test_against_brute_force(spark, seed, block_bytes):
    texts = corpus(seed)
    raw = [t.encode() for t in texts]
    marks = brute(raw, 400)
    assert 0 < sum(map(sum, marks)) < sum(map(len, raw))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixdedup.dedup(df, "text", ["doc_id"], block_bytes=block_bytes).collect()}
    assert got == {i: expected(t, g) for i, (t, g) in enumerate(zip(raw, marks, strict=True))}


def test_odd_rows(spark, docs, empty_docs, odd_texts):
    got = suffixdedup.dedup(docs.withColumnRenamed("lang", "kept"), "text", ["doc_id", "kept", "source"])
    assert got.columns == ["doc_id", "source", "n_bytes", "n_removed", "n_spans", "kept"]
    raw = [(t or "").encode() for t in [*odd_texts, "a"]]
    want = sorted(expected(t, g)[:3] for t, g in zip(raw, brute(raw, 400), strict=True))
    assert sorted((r.n_bytes, r.n_removed, r.n_spans) for r in got.collect()) == want
    before = len(spark.catalog.listTables(pattern="quire_scratch_*"))
    with scratch_scope(spark):
        assert suffixdedup.dedup(empty_docs, "text", ["doc_id"]).count() == 0
    assert len(spark.catalog.listTables(pattern="quire_scratch_*")) == before


@pytest.mark.parametrize("seed, block_bytes, shorter", [(5, 1 << 23, 240), (6, 3000, 240), (7, 500, 60), (8, 3000, 400)])
def test_shorter_strings_against_brute_force(spark, seed, block_bytes, shorter):
    texts = [*corpus(seed), None, "", "né " * 90]
    raw = [(t or "").encode() for t in texts]
    covered, marks = [sum(g) for g in brute(raw, shorter)], brute(raw, 400)
    assert sum(covered) > sum(map(sum, marks)) > 0 or shorter == 400
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_repeated", F.lit("clash"))
    with scratch_scope(spark):
        found = suffixdedup.dedup(df, "text", ["doc_id", "n_repeated"], block_bytes=block_bytes, shorter=shorter)
        assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_repeated"]
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept), r.n_repeated) for r in found.collect()}
    assert got == {i: (*expected(t, g), n) for i, (t, g, n) in enumerate(zip(raw, marks, covered, strict=True))}


def test_shorter_strings_leave_no_scratch_and_take_empty_tables(spark, docs, empty_docs, odd_texts):
    before = len(spark.catalog.listTables(pattern="quire_scratch_*"))
    with scratch_scope(spark):
        got = suffixdedup.dedup(docs, "text", ["doc_id"], shorter=240, as_text=True).collect()
        assert suffixdedup.dedup(empty_docs, "text", ["doc_id"], shorter=240).count() == 0
    raw = [(t or "").encode() for t in [*odd_texts, "a"]]
    assert sorted(r.n_repeated for r in got) == sorted(map(sum, brute(raw, 240)))
    assert len(spark.catalog.listTables(pattern="quire_scratch_*")) == before
    with pytest.raises(ValueError, match="shorter"):
        suffixdedup.dedup(docs, "text", ["doc_id"], shorter=401)


def test_query_shows_passages_of_over_50_words_under_400_bytes(spark, tmp_path):
    passage = " ".join(f"w{i:02d}xy" for i in range(55))  # 329 bytes
    texts = [f"{prose(71, 80)} {passage} {prose(72, 90)}", f"{prose(73, 40)} {passage}", prose(74, 200), None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op7_suffix_dedup(spark, str(tmp_path)).collect()}
    raw = [(t or "").encode() for t in texts]
    assert {d: r.n_repeated for d, r in got.items()} == dict(enumerate(map(sum, brute(raw, 240))))
    assert [d for d in sorted(got) if got[d].n_repeated >= len(passage)] == [0, 1] and got[2].n_repeated == 0
    assert {r.n_removed for r in got.values()} == {0}  # of which no 400 bytes repeat
