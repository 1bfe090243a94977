import json

import pytest
from pyspark.sql import functions as F

from quire.operators import index, retrieval

NODES = [
    ("d", "1", None, 1, "quadro", 1, "QUADRO RP", 1, 4, 2), ("d", "2", "1", 2, "sezione", 2, "SEZIONE I", 2, 4, 3),
    ("d", "3", "2", 3, "rigo", 3, "Rigo RP1 farmaci", 3, 3, 4), ("d", "4", "2", 4, "rigo", 3, "Rigo RP2 veicoli", 4, 4, 4),
]
COLUMNS = "doc string, node_id string, parent_id string, ord int, kind string, level int, title string, page int, page_end int, serve_end int"


@pytest.fixture(scope="module")
def given(spark):
    nodes = spark.createDataFrame(NODES, COLUMNS)
    pages = spark.createDataFrame([("d", 1, "---\nn: 1\n---\nuno"), ("d", 2, "due"), ("d", 3, " farmaci e medi\u00ad\ncinali "), ("d", 4, "veicoli")], "doc string, page int, text string")
    pins = spark.createDataFrame([("1", "regola A"), ("2", "regola B")], "node_id string, text string")
    keywords = spark.createDataFrame([("farmaci", "3", 1.0, 1, 20.0), ("auto", "4", 1.0, 1, 2.0)], "term string, node_id string, tf double, df long, weight double")
    return nodes, pages, pins, keywords


@pytest.fixture(scope="module")
def found(spark, given):
    nodes, pages, pins, keywords = given
    asked = spark.createDataFrame([(1, "farmaci"), (2, "auto"), (3, "nulla")], "q int, text string")
    choices = spark.createDataFrame([(2, "4", 1.0)], "q int, node_id string, score double")
    return retrieval.run(asked, "q", "text", nodes, pages, pins, keywords, choices).cache()


def test_run(found):
    got = {r.q: r for r in found.collect()}
    assert {q: (r.gate, r.method, r.node_id, r.target_pages) for q, r in got.items()} == {
        1: ("netto", "fast_path", "3", "3-3"), 2: ("ambiguo", "navigation_descent", "4", "4-4"), 3: ("vuoto", "navigation_descent", "2", "2-4"),
    }
    assert [r.reason for _, r in sorted(got.items())] == ["top1 20.0, margine inf", "top1 2.0 < soglia_assoluta 8.0", "nessun match lessicale"]
    assert got[1].served_text == f"{retrieval.GOVERNING}\n\n[quadro] QUADRO RP\nregola A\n\n[sezione] SEZIONE I\nregola B\n\n=== VOCE ===\nRigo RP1 farmaci\nfarmaci e medicinali\n\nveicoli"


def test_refused(spark, given):
    nodes, pages, pins, keywords = given
    roots = nodes.unionByName(spark.createDataFrame([("d", "9", None, 9, "quadro", 1, "QUADRO RX", 9, 9, 9)], COLUMNS))
    asked = spark.createDataFrame([(3, "nulla")], "q int, text string")
    got = retrieval.run(asked, "q", "text", roots, pages, pins, keywords, spark.createDataFrame([], "q int, node_id string, score double"))
    r = got.first()
    assert (r.method, r.node_id, r.served_text) == ("refused", None, None)
    assert retrieval.traces(got, "q").first().outcome == "refused"


def test_traces(found):
    got = retrieval.traces(found, "q").where("q = 1").first()
    assert got.outcome == "fast_path"
    assert json.loads(got.trace) == {"gate": "netto", "reason": "top1 20.0, margine inf", "method": "fast_path", "target_node_id": "3", "candidates": [{"node_id": "3", "score": 20.0}], "pin_owners": ["QUADRO RP", "SEZIONE I"]}


def test_arms(spark, given, found):
    whole = retrieval.baseline(given[1])
    assert whole.first().text.startswith("== p.1 ==\nuno\n\n== p.2 ==\ndue\n\n")
    cases = spark.createDataFrame([(1, "d", "farmaci?", "RP1", ["medicinali"], True), (7, "e", "x", "RP1", ["y"], False)], "q int, doc string, question string, expected string, facts array<string>, answerable boolean")
    judge = lambda p: ("RIFIUTO_OK" if retrieval.REFUSAL in p else "CORRETTO", 0.5)
    got = {(r.q, r.arm): r for r in retrieval.run_cases(cases, "q", found.withColumn("usd", F.lit(0.125)), whole, lambda p: (p, 0.25), judge).collect()}
    assert {k: (r.verdict, r.correct, r.cost_usd) for k, r in got.items()} == {
        (1, "navigazione"): ("CORRETTO", True, 0.875), (1, "servi_intero"): ("CORRETTO", True, 0.75), (7, "navigazione"): ("RIFIUTO_OK", True, 0.5), (7, "servi_intero"): ("RIFIUTO_OK", True, 0.5),
    }
    assert got[7, "navigazione"].latency_ms == 0 and got[1, "navigazione"].latency_ms >= 0
    silent = retrieval.run_cases(cases, "q", found, whole).where("q = 1").first()
    assert (silent.answer, silent.verdict, silent.correct, silent.cost_usd) == (None, None, None, 0.0)
    assert {k: (r.hit, r.refused, r.facts.hits) for k, r in got.items()} == {
        (1, "navigazione"): (True, False, 1), (1, "servi_intero"): (None, False, 0), (7, "navigazione"): (False, True, 0), (7, "servi_intero"): (None, True, 0),
    }


def test_scopes(given):
    nodes, pages, pins, keywords = given
    scopes = retrieval.scope_inputs(nodes, pages, 7)
    got = {r.node_id: r for r in scopes.collect()}
    assert (got["3"].own_text, got["4"].own_text, got["1"].own_text) == ("farmaci", "veicoli", "")
    assert got["2"].message == "Tipo voce: sezione\nTitolo: SEZIONE I\n\nSotto-voci contenute (figli diretti):\n- Rigo RP1 farmaci\n- Rigo RP2 veicoli"
    assert sorted(r.node_id for r in retrieval.representative(scopes, 3).collect()) == ["1", "2", "3"]
    shown = {r.node_id: json.loads(r.payload) for r in retrieval.payload(scopes, pins, keywords).collect()}
    assert shown["3"]["kw"] == [{"term": "farmaci", "weight": 20.0}] and [p["text"] for p in shown["3"]["pins"]] == ["regola A", "regola B"] and shown["1"]["pins"] is None


def test_replies(spark):
    df = spark.createDataFrame([("[12] sì", '{"a": "x", "b": "y"}', "54, 99,", None, None), ("nessuna", "{", None, 3, 5), ("7", '{"a": "x"}', "", 5, 3)], "r string, j string, l string, f int, t int")
    allowed = F.array(F.lit(12)).cast("array<long>")
    got = df.select(retrieval.chosen(F.col("r"), allowed).alias("n"), retrieval.parsed(F.col("j"), "a string, b string", ("a", "b")).alias("x"), retrieval.page_list(F.col("l"), F.col("f"), F.col("t")).alias("p")).collect()
    assert [r.n for r in got] == [12, None, None] and [r.x and tuple(r.x) for r in got] == [("x", "y"), None, None] and [r.p for r in got] == [[54, 99], [3, 4, 5], []]
    log = df.limit(1).select(retrieval.question_log(F.lit("q1"), F.lit("t"), F.lit("d"), F.lit("x?"), F.array(F.struct(F.lit("A").alias("title"), retrieval.fenced(F.lit("b")).alias("body"))))).first()[0]
    assert log == "# Q&A log — q1\n\n- **timestamp:** t\n- **documento:** d\n- **query:** x?\n\n---\n\n## 1. A\n\n```\nb\n```\n"


def test_descent_into_an_only_child(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 2)], "node_id int, parent_id int")
    none = spark.createDataFrame([], "q string, node_id int, score double")
    assert index.descend(nodes, none, "q", asked=spark.createDataFrame([("a",)], "q string")).collect() == [("a", 2)]
