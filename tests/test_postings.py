import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.operators import index, segments
from quire.operators.keptindex import KeptIndex, rounded, weighed_terms
from quire.operators.postings import best, blocked
from quire.sources.scratch import scratch_scope

WORDS = [f"parola{i}" for i in range(60)]


def sentence(r, n):
    return " ".join(WORDS[min(59, int(r.paretovariate(0.9)) - 1)] for _ in range(n))


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


@pytest.mark.parametrize("k, blocks", [(8, 40), (1, 7), (500, 20), (3, 1)])
def test_pruned_search_equals_the_full_one(spark, k, blocks):
    r = random.Random(2)
    items = spark.createDataFrame([(i, sentence(r, 12)) for i in range(300)], "id int, t string")
    asked = spark.createDataFrame([(i, sentence(r, 4)) for i in range(30)] + [(99, "niente"), (98, None)], "q int, text string")
    words = index.keyword_index(items, "id", {"t": 1.0}).cache()
    with scratch_scope(spark):
        found, report = best(index.asked_terms(asked, "q", "text"), "q", blocked(words, blocks), k)
        assert rows(found, "q", "node_id", "score", "place") == rows(index.match(asked, "q", "text", words, k), "q", "node_id", "score", "place")
        assert all(0 < x.read <= x.blocks <= blocks for x in report.collect())


def test_most_blocks_stay_closed(spark):
    """Of questions for one document each, some hundred blocks in all."""
    r = random.Random(7)
    docs = [(i, f"{sentence(r, 30)} unico{i} raro{i // 3}") for i in range(1500)]
    items = spark.createDataFrame(docs, "id int, t string")
    asked = spark.createDataFrame([(i, f"unico{i * 50} raro{i * 50 // 3} parola0 parola1") for i in range(20)], "q int, text string")
    words = index.keyword_index(items, "id", {"t": 1.0}).cache()
    with scratch_scope(spark):
        found, report = best(index.asked_terms(asked, "q", "text"), "q", blocked(words, 400), 3)
        assert rows(found, "q", "node_id", "score", "place") == rows(index.match(asked, "q", "text", words, 3), "q", "node_id", "score", "place")
        blocks, read = report.agg(F.sum("blocks"), F.sum("read")).first()
        assert read * 2 <= blocks


def files(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_kept_index(spark, tmp_path):
    r, current = random.Random(3), {}
    kept = KeptIndex(spark, str(tmp_path / "index"), buckets=8)

    def items(nodes):
        return spark.createDataFrame([(i, *t) for i, t in nodes.items()], "id long, title string, body string")

    def agree():
        want = index.keyword_index(items(current), "id", {"title": 3.0, "body": 1.0})
        assert rows(kept.read()) == rows(want)
        some = spark.createDataFrame([("parola1",), ("parola2",)], "term string")
        assert rows(kept.read(some)) == rows(want.where("term in ('parola1', 'parola2')"))

    def change(new, gone=()):
        for i in gone:
            current.pop(i, None)
        current.update(new)
        kept.change(items(new), "id", {"title": 3.0, "body": 1.0}, spark.createDataFrame([(i,) for i in gone], "node_id long"))

    assert kept.read().count() == 0 and kept.merge() == []
    change({i: (sentence(r, 2), sentence(r, 5)) for i in range(30)})
    agree()
    assert len(kept.merge()) == 8 and kept.merge() == []
    agree()
    change({3: ("parola1", None), 4: (None, None), 31: ("parola2 parola2", "nuova")}, gone=(7, 8, 1000))
    agree()
    change({7: ("parola1 torna", "")}, gone=(0,))
    agree()
    kept.merge()
    before = files(tmp_path / "index" / "base")
    change({40: ("unica", "")})
    touched = kept.merge()
    after = files(tmp_path / "index" / "base")
    agree()
    assert len(touched) <= 2 and {f for f in before if after.get(f) != before[f]} == {f for f in before if any(f"/bucket={b}/" in f for b in touched)}
    change({}, gone=tuple(current))
    assert kept.read().count() == 0 and kept.merge() and kept.read().count() == 0
    change({5: ("parola9", "")})
    agree()


def test_a_kept_index_is_shuffled_once_where_it_is_read(spark, tmp_path):
    """Its words are not shuffled at all, unless rows repeat a node."""
    fields = {"t": 3.0, "s": 1.0}
    one = spark.createDataFrame([(1, "sei due", "due"), (2, None, "di")], "id long, t string, s string")
    terms = weighed_terms(one, "id", fields)
    assert "Exchange" not in terms._jdf.queryExecution().executedPlan().toString()
    assert dict(rows(terms)) == {1: {"sei": 3.0, "due": 4.0, "sei due": 3.0}, 2: None}
    twice = one.union(spark.createDataFrame([(1, "due", None)], one.schema))
    assert dict(rows(weighed_terms(twice, "id", fields)))[1] == {"sei": 3.0, "due": 7.0, "sei due": 3.0}
    kept = KeptIndex(spark, str(tmp_path / "index"), buckets=2)
    kept.change(one, "id", fields)
    assert kept.read()._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(term") == 1


def test_a_failed_change_is_ignored(spark, tmp_path):
    kept = KeptIndex(spark, str(tmp_path / "index"), buckets=4)
    kept.change(spark.createDataFrame([(1, "uno due")], "id long, t string"), "id", {"t": 1.0})
    want = rows(kept.read())
    bad = spark.createDataFrame([(1, "tre"), (2, "due quattro")], "id long, t string")
    kept.change(bad, "id", {"t": 1.0})
    (tmp_path / "index" / "counts" / "version=2" / "_SUCCESS").unlink()  # as if it had stopped before its end
    assert rows(kept.read()) == want
    assert kept.change(bad, "id", {"t": 1.0}) == 2
    assert rows(kept.read()) == rows(index.keyword_index(bad, "id", {"t": 1.0}))


def test_a_kept_index_deals_few_rows(spark, tmp_path):
    """A change's entries stand in a row for each part of the terms and task, and go from the deltas once merged."""
    r = random.Random(5)
    items = spark.createDataFrame([(i, sentence(r, 200)) for i in range(100)], "id long, t string").coalesce(1)
    kept = KeptIndex(spark, str(tmp_path / "index"), buckets=2)
    kept.change(items, "id", {"t": 1.0})
    rows_kept = spark.read.parquet(str(tmp_path / "index" / "deltas" / "version=1")).count()
    want = index.keyword_index(items, "id", {"t": 1.0})
    assert rows_kept * 20 < want.count()
    kept.merge()
    assert not (tmp_path / "index" / "deltas" / "version=1").exists()
    assert rows(kept.read()) == rows(want)


def test_a_kept_index_of_odd_texts(spark, tmp_path):
    """Nodes may be strings, one of them null; those gone may be named twice."""
    odd = [("a", "", None), ("b", None, "È già, l'età"), ("c", "abc", "def ghi"), ("d", "AB abc-abc\u00a0ABC", "x1y2\u4e2d\u6587z9z9 di del ab"), (None, "niente nodo", "\U0001d400bc"), ("e", "di la", "ab"), ("f", "\u0130stanbul stra\u00dfe", "fine")]
    items = spark.createDataFrame(odd, "id string, t string, s string")
    kept = KeptIndex(spark, str(tmp_path / "index"), node_kind="string", buckets=2)
    fields = {"t": 0.1, "s": 0.7}
    kept.change(items, "id", fields)
    want = index.keyword_index(items, "id", fields)
    assert rows(kept.read(), "term", "node_id", "df", "weight") == rows(want, "term", "node_id", "df", "weight")
    assert rows(kept.read(spark.createDataFrame([("def ghi",), ("ab",), (None,)], "term string")), "term", "node_id") == [("def ghi", "c")]
    gone = spark.createDataFrame([("c",), ("c",), ("none",)], "node_id string")
    kept.change(items.where("id = 'b'").withColumn("t", F.lit("nuova")), "id", fields, gone)
    now = items.where("id is null or id <> 'c'").withColumn("t", F.when(F.col("id") == "b", "nuova").otherwise(F.col("t")))
    want = rows(index.keyword_index(now, "id", fields), "term", "node_id", "df", "weight")
    assert rows(kept.read(), "term", "node_id", "df", "weight") == want
    kept.merge()
    assert rows(kept.read(), "term", "node_id", "df", "weight") == want


def test_segments_are_the_same_in_pieces(monkeypatch):
    """However many documents and parts are looked at together."""
    r = random.Random(11)
    texts = [[sentence(r, r.randrange(9)) for _ in range(2)] for _ in range(40)]
    old = [None if i % 3 else [sentence(r, 5), texts[i][0]] for i in range(40)]
    weights = [[3.0, 1.0]] * 40
    batch = pa.record_batch({"node_id": pa.array(range(40), pa.int64()), "texts": texts, "weights": weights, "old": old, "old_weights": [x and [1.0, 3.0] for x in old]})

    def entries():
        made = [b.append_column("version", pa.array([1] * len(b), pa.int32())) for b in segments.of_texts(8)([batch])]
        dealt = pa.Table.from_batches(made).sort_by("term_part").combine_chunks().to_batches()
        lots = list(segments.opened(pa.int64())(dealt))
        return sorted(tuple(x.values()) for b in lots for x in b.to_pylist()), len(made), len(lots)

    whole, pieces, lots = entries()
    assert pieces == lots == 1
    monkeypatch.setattr(segments, "PIECE", 60)
    monkeypatch.setattr(segments, "LOT", 5)
    again, pieces, lots = entries()
    assert again == whole and pieces > 5 and lots == 8


def test_weights_are_rounded_as_by_spark(spark):
    x = spark.createDataFrame([(v,) for v in (0.00005, 1.00005, 0.33335, -0.00001, -0.0, -2.5, 1e300, float("inf"), float("nan"), 123456.78905, None)], "x double")
    x = x.union(spark.range(-20_000, 20_000).select(F.col("id") / 20_000 * 3.7)).union(spark.range(20_000).select(F.log(F.col("id") + 2) * 7))
    assert x.where(~rounded(F.col("x")).eqNullSafe(F.round("x", 4))).isEmpty()
