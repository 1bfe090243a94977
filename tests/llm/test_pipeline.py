import random

import corpus_pipeline
from tests.llm.conftest import prose
from tests.llm.test_decontam import brute as brute_hits
from tests.llm.test_neardup import brute as brute_groups
from tests.llm.test_suffixdedup import brute as brute_repeats


def test_stages_on_their_own_input(spark, tmp_path):
    r = random.Random(6)
    items = [prose(7000 + i, 30) for i in range(5)]
    passage = prose(8000, 120)
    texts = []
    for i in range(240):
        words = prose(i, r.randint(20, 150)).split(" ")
        if i % 4 == 0:
            for _ in range(6):
                words[r.randrange(len(words))] = r.choice(["nasty", "vile"])
        text = " ".join(words)
        if i % 10 == 1:
            text += " " + passage
        if i % 10 == 3:
            text += ". " + r.choice(items)
        texts.append(text)
    texts += [texts[i] + " again" for i in (1, 2, 3, 5, 6)] + [None, "", items[0]]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or docs.columns == corpus_pipeline.COLUMNS
        seen.append(docs.orderBy("doc_id").collect())
    clean, groups, cut, decontaminated, ids = seen
    assert {x.doc_id for x in clean} == {i for i in range(len(texts)) if i >= 240 or i % 4}
    kept = brute_groups([x.text for x in clean])
    assert [x.doc_id for x in groups] == [x.doc_id for i, x in enumerate(clean) if kept[i][2]] and len(groups) < len(clean)
    raw = [(x.text or "").encode() for x in groups]
    want = [bytes(b for b, g in zip(t, gone, strict=True) if not g).decode(errors="ignore") for t, gone in zip(raw, brute_repeats(raw, corpus_pipeline.REPEATED), strict=True)]
    assert [x.text for x in cut] == want and any(a != b.decode() for a, b in zip(want, raw, strict=True))
    hits = {x.doc_id: brute_hits(x.text, list(enumerate(items))) for x in cut}
    assert {x.doc_id for x in decontaminated} == {i for i, (n, hit, _) in hits.items() if not n or hit < 0.8 * n}
    before = {x.doc_id: x.text for x in cut}
    assert all((x.text == before[x.doc_id]) == (not hits[x.doc_id][1]) for x in decontaminated) and any(h for _, h, _ in hits.values())
    assert all(x.n_chars == len(x.text) for x in decontaminated)
    assert [x.doc_id for x in ids] == [x.doc_id for x in decontaminated] and all(len(x.ids) == x.n_tokens for x in ids)


def test_empty(spark, empty_docs, tmp_path):
    empty_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows(spark, docs, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and copies, items and labels of nulls."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, None, None), (1, None, None), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, ""), (2, " ")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [0, 1, 2, 3, 3, 4, 5, 7, 9]
