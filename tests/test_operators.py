import random
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import evalkit, index, layout, ledger, outcome, sizes, store, tree
from quire.sources import tables
from quire.streaming.ledger import hourly

c = F.col


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


PAGES = [
    ("d", 69, "---\nx: 1\n---\n# QUADRO RP - Oneri\nRegole del quadro\n## Nota\nvalgono sempre"),
    ("d", 70, "# QUADRO RP\n## SEZIONE I\nTesto della sezione\n### Rigo RP1 Spese\nspese sanitarie"),
    ("d", 71, "# SEZIONE I\n### Rigo RP2 Altre\naltre spese\n#### codice 4\nmutui"),
    ("d", 74, "# QUADRO RP\n## SEZIONE II\n### Righi da RP8 a RP13\ncodici vari"),
]


# --- retrieval


def test_index_and_match(spark):
    items = spark.createDataFrame([(1, "Spese sanitarie", "visite mediche dal medico"), (2, "Interessi mutui ipotecari", "acquisto abitazione principale"), (3, "Spese varie", None)], "id int, title string, summary string")
    idx = index.keyword_index(items, "id", {"title": 3.0, "summary": 1.0})
    weight = {(r.term, r.node_id): r.weight for r in idx.collect()}
    assert weight["sanitarie", 1] > weight["spese", 1] and weight["spese sanitarie", 1] > 0
    asked = spark.createDataFrame([("a", "gli interessi del mutuo: mutui ipotecari?"), ("b", "il dentista"), ("c", None)], "q string, text string")
    assert rows(index.match(asked, "q", "text", idx), "q", "node_id", "place") == [("a", 2, 1)]
    aliases = {"dentista": ["spese sanitarie", "visite"], "mutuo": ["casa"]}
    assert ("b", 1) in rows(index.match(asked, "q", "text", idx, aliases=aliases), "q", "node_id")
    terms = dict(rows(asked.where("text is not null").select("q", index.expanded(c("text"), aliases).alias("t"))))
    assert terms["b"] == ["dentista", "spese", "sanitarie", "spese sanitarie", "visite"] and terms["a"][-1] == "casa"
    few = index.keyword_index(items, "id", {"title": 3.0, "summary": 1.0}, asked=index.asked_terms(asked, "q", "text"))
    wanted = {(r.term, r.node_id): r.weight for r in few.collect()}
    assert wanted and all(weight[k] == w for k, w in wanted.items()) and ("spese", 1) not in wanted
    assert tuple(index.sizes(few).first()) == (len(wanted), len({t for t, _ in wanted}), 1)
    twice = spark.createDataFrame([("b", "visite dal medico"), ("b", "visite dal medico")], "q string, text string")
    assert rows(index.match(twice, "q", "text", idx), "node_id", "place") == [(1, 1)]
    assert index.top_keywords(idx, 2).groupBy("node_id").count().agg(F.max("count")).first()[0] == 2


def generators(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Generate ")


def test_an_index_takes_texts_apart_once(spark):
    items = spark.createDataFrame([(1, "sei due tre", "due"), (1, "due", None), (2, "di", "al"), (None, "tre", "tre"), (4, "", "due tre")], "id int, title string, summary string")
    asked = spark.createDataFrame([("due",), ("due",), ("tre",), (None,)], "term string")
    idx = index.keyword_index(items, "id", {"title": 3.0, "summary": 1.0})
    assert generators(idx) == 1
    got = {(r.term, r.node_id): (r.tf, r.df) for r in idx.collect()}
    assert got == {("sei", 1): (3, 1), ("due", 1): (7, 2), ("tre", 1): (3, 3), ("sei due", 1): (3, 1), ("due tre", 1): (3, 2), ("tre", None): (4, 3), ("due", 4): (1, 2), ("tre", 4): (1, 3), ("due tre", 4): (1, 2)}
    few = index.keyword_index(items, "id", {"title": 3.0, "summary": 1.0}, asked=asked)
    assert rows(few) == rows(idx.where("term in ('due', 'tre')"))
    assert "ReusedExchange" in few._jdf.queryExecution().executedPlan().toString()
    words = spark.createDataFrame([("al di",), ("al",), ("ala",), ("xx-yy",), ("dell x",), ("",), (None,), ("con conto",), ("123",)], "t string")
    assert [tuple(r) for r in words.where("t is not null").select(tx.has_terms(c("t")), F.size(tx.terms(c("t"))) > 0).distinct().collect() if r[0] != r[1]] == []


def test_sizes_of_an_index_that_is_not_built(spark):
    fields = {"title": 3.0, "summary": 1.0}
    for rest in ([], [(1, "due", "nove dieci")], [(None, "tre", None)], [(5, "di", None)]):
        items = spark.createDataFrame([(1, "sei due tre", "due due"), (2, "di", "al"), (4, "", "due tre"), *rest], "id int, title string, summary string")
        assert tuple(index.index_sizes(items, "id", fields).first()) == tuple(index.sizes(index.keyword_index(items, "id", fields)).first())
    assert tuple(index.index_sizes(items.limit(0), "id", fields).first()) == (0, 0, 0)


def test_terms_are_dealt_to_nodes_before_they_are_ranked(spark):
    items = spark.createDataFrame([(i, f"sei due tre parola{i}") for i in range(20)], "id int, title string")
    best = index.top_keywords(index.keyword_index(items, "id", {"title": 1.0}), 2)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 2  # by term, then by node
    assert rows(best.where("place = 1"), "node_id", "term") == sorted([(i, f"parola{i}") for i in range(20)], key=str)


def test_gate(spark):
    scores = {"a": [129.0, 39.0], "b": [50.0, 46.0], "c": [4.9, 4.5], "d": [], "e": [20.0]}
    matches = spark.createDataFrame([(q, i, s, i + 1) for q, ss in scores.items() for i, s in enumerate(ss)], "q string, node_id int, score double, place int")
    asked = spark.createDataFrame([(q,) for q in scores], "q string")
    got = dict(rows(index.gate(asked, "q", matches), "q", "gate"))
    assert got == {"a": "netto", "b": "ambiguo", "c": "ambiguo", "d": "vuoto", "e": "netto"}


def test_descent_and_boilerplate(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2)], "node_id int, parent_id int")
    scores = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 1.0), ("a", 4, 1.0), ("b", 1, 1.0)], "q string, node_id int, score double")
    assert rows(index.descend(nodes, scores, "q")) == [("a", 4), ("b", 1)]
    pages = spark.createDataFrame([(i, "d", f"HEAD\nbody {i}") for i in range(3)] + [(9, "e", None)], "n int, doc string, text string")
    known = index.boilerplate(pages, "doc", "text", 0.6)
    assert rows(known) == [("d", "HEAD", 3)]
    assert rows(index.without_lines(pages, "n", "doc", "text", known), "n", "text") == [(0, "body 0"), (1, "body 1"), (2, "body 2"), (9, "")]


def test_descent_by_replies(spark):
    nodes = [(1, None, "quadro", "A"), (2, 1, "sezione", "B"), (3, 1, "sezione", "C"), (4, 2, "rigo", "D"), (5, 2, "rigo", "E"), (6, 3, "rigo", "F")]
    nodes = spark.createDataFrame([(i, p, i, k, t, None) for i, p, k, t in nodes], "node_id int, parent_id int, ord int, kind string, title string, summary string")
    said = {"down": ["2", "[4] sì"], "none": ["nessuna"], "stop": ["2", "ferma."], "bad": ["2", "99"], "only": ["3"], "refused": ["2", "NESSUNA"]}

    def choose(prompt):
        listed, _, question = prompt.partition("\n\nDomanda: ")
        return said[question][0 if "Voce corrente: A" in listed else 1]

    asked = spark.createDataFrame([(q, q) for q in said], "q string, text string")
    got = {r.q: (r.node_id, r.path) for r in index.descend_by(nodes, asked, "q", "text", choose).collect()}
    assert got == {"down": (4, [1, 2, 4]), "none": (None, [1]), "stop": (2, [1, 2]), "bad": (2, [1, 2]), "only": (6, [1, 3, 6]), "refused": (None, [1, 2])}


# --- layout


def test_layout(spark):
    pages = [(300, 0, 0.9, 0.9, 0.9, True), (5, 0, 0.9, 0.9, 0.9, False), (300, 30, 0.9, 0.9, 0.9, False), (300, 0, 0.4, 0.1, 0.05, False), (300, 0, 0.9, 0.9, 0.9, False)]
    df = spark.createDataFrame(pages, "w int, r int, m double, p double, g double, ghost boolean")
    kinds = [x[0] for x in df.select(layout.layout_class(c("w"), c("r"), c("m"), c("p"), c("g"), c("ghost"))).collect()]
    assert kinds == ["anomalous", "anomalous", "table_heavy", "multi_column", "single_column"]
    hist = layout.histogram(spark.createDataFrame([("table_heavy",)], "k string"), "k")
    assert dict(rows(hist)) == {"table_heavy": 1, "single_column": 0, "multi_column": 0, "anomalous": 0}
    routes = spark.createDataFrame([("single_column", 300, 270), ("anomalous", 300, 0), ("single_column", 2, 0)], "k string, w int, r int")
    assert [x[0].route for x in routes.select(layout.route(c("k"), c("w"))).collect()] == ["A", "B", "B"]
    assert [x[0].route for x in routes.select(layout.route(c("k"), c("w"), c("r"), max_rects=50)).collect()] == ["B", "B", "B"]
    sizes = spark.createDataFrame([("p", 10, 5), ("p", 12, 5), ("p", 9, 1)], "p string, size int, n int")
    assert rows(layout.weighted_mode(sizes, ["p"], "size", "n")) == [("p", 10, 5)]


# --- ledger and store


@pytest.fixture(scope="module")
def calls(spark):
    data = [("2026-06-05T10:00:00+00:00", "a", "m1", 1000, 1, 0, 0, 10.0, 5.0, "q1"), ("2026-06-05T11:00:00+00:00", "b", "m2", 200, 1, 0, 0, 2.0, 1.0, "q1"), ("2026-06-06T11:00:00+00:00", "b", "m2", 100, 1, 0, 0, 1.0, 0.5, None)]
    return spark.createDataFrame(data, "ts string, purpose string, model string, tok_in long, tok_out long, tok_cache_r long, tok_cache_w long, usd double, eur double, query string")


def test_ledger(spark, calls):
    t = ledger.total(calls).first()
    assert (t.calls, t.usd, t.eur, t.tok_in) == (3, 13.0, 6.5, 1300)
    assert tuple(ledger.total(calls.limit(0)).first()) == (0, 0, 0, 0, 0, 0, 0)
    assert rows(ledger.report_by(calls, "day"), "key", "calls") == [("2026-06-05", 2), ("2026-06-06", 1)]
    assert rows(ledger.report_by(calls, "query"), "key", "calls") == [("q1", 2), (None, 1)]
    assert rows(ledger.report_by(calls, "model"), "key", "usd") == [("m1", 10.0), ("m2", 3.0)]
    assert ledger.rendered(ledger.report_by(calls, "purpose")).count() == 2
    with pytest.raises(ValueError):
        ledger.report_by(calls, "scopo")


def test_prices(spark):
    used = spark.createDataFrame([("m", 200_000, 10_000, 800_000, None), ("m", None, None, None, 1_000_000)], "model string, tok_in long, tok_out long, tok_cache_r long, tok_cache_w long")
    prices = spark.createDataFrame([("m", 5.0, 25.0)], "model string, input_per_mtok double, output_per_mtok double")
    assert [round(r.usd, 6) for r in ledger.priced(used, prices).collect()] == [1.65, 6.25]
    assert round(ledger.priced(used, prices, ttl="1h").collect()[1].usd, 6) == 10.0
    with pytest.raises(ValueError):
        ledger.priced(used, prices, ttl="2h")
    with pytest.raises(PySparkException):
        ledger.priced(used.withColumn("model", F.lit("x")), prices).collect()


def test_store(spark, tmp_path):
    log = spark.createDataFrame([("a", 1, "old"), ("a", 2, None), ("b", 1, "x")], "k string, seq int, v string")
    assert rows(store.latest(log, ["k"], ["seq"])) == [("a", 2, None), ("b", 1, "x")]
    assert store.assert_unique(log, ["k", "seq"]).count() == 3
    with pytest.raises(PySparkException):
        store.assert_unique(log, ["k"]).collect()
    parent = spark.createDataFrame([("a",)], "k string")
    assert rows(store.orphans(log, parent, ["k"]), "k") == [("b",)]
    patch = spark.createDataFrame([("b", "new"), ("zz", "no")], "k string, v string")
    assert rows(store.patched(log, patch, "k", ["v"])) == [("a", 1, "old"), ("a", 2, None), ("b", 1, "new")]
    path = str(tmp_path / "t")
    store.replaced_partition(log, path, "k")
    store.replaced_partition(log.where("k = 'b'").withColumn("v", F.lit("y")), path, "k")
    assert rows(spark.read.parquet(path), "k", "seq", "v") == [("a", 1, "old"), ("a", 2, None), ("b", 1, "y")]
    reviews = spark.createDataFrame([("Lint: SIMBOLO DOPPIO",), (None,)], "flags string")
    assert rows(store.false_positives(reviews, "flags")) == [("lint:simbolo_doppio", 1)]


def test_governance(spark):
    done = spark.createDataFrame([("A", 0, "ok"), ("A", 1, "ok"), ("B", 2, "needs_human"), ("A", 0, "ok")], "route string, escalations int, status string")
    audits = spark.createDataFrame([(True,), (False,)], "gate_miss boolean")
    assert tuple(store.governance(done, audits).first()) == (4, 3, 1, 2, 1, 0.5, 1)
    assert tuple(store.governance(done.limit(0), audits.limit(0)).first()) == (0, 0, 0, 0, 0, 0.0, 0)


# --- trees


def stack_tree(nodes, last):
    """The rules by a stack, node after node: (parent, page_end) by order."""
    out, stack = {}, []
    for o, level, page in nodes:
        while stack and stack[-1][1] >= level:
            stack.pop()
        later = next((p for q, lv, p in nodes if q > o and lv <= level), None)
        end = last if later is None else min(last, later - 1) if later > page else page
        out[o] = (stack[-1][0] if stack else None, max(page, end))
        stack.append((o, level))
    return out


def test_random_trees(spark):
    r, data, want = random.Random(1), [], {}
    for d in range(150):
        page, nodes = 1, []
        for o in range(r.randint(1, 14)):
            page += r.choice([0, 0, 1, 3])
            nodes.append((o, r.randint(1, 4), page))
        last = page + r.randint(0, 2)
        data += [(d, o, lv, p, last) for o, lv, p in nodes]
        want |= {(d, o): x for o, x in stack_tree(nodes, last).items()}
    df = spark.createDataFrame(data, "d int, ord int, level int, page int, last int")
    got = {(r.d, r.ord): (r.parent_ord, r.page_end) for r in tree.linked(df, "d", "ord", "level", "page", "last").collect()}
    assert got == want


def test_trees_in_ranges(spark):
    """Ranges of a document, summed up and combined, link as the whole does, wherever its numbers and pages lie."""
    r, data = random.Random(4), []
    for d in [None, "a", "b", "c"]:
        page, order = 1, 0
        for _ in range({"c": 1}.get(d, 150)):
            order += r.choice([1, 1, 1, 1000])
            page = r.randint(1, 40) if d == "b" else page + r.choice([0, 0, 1, 9])
            data.append((d, order, r.choice([1, 2, 3, 3, 4, 4, 4]), page, page + r.randint(0, 2), "x"))
    df = spark.createDataFrame(data, "d string, ord int, level int, page int, last int, note string")
    for end in (None, "last"):
        whole = tree.linked(df, "d", "ord", "level", "page", end)
        got = tree.linked_in_ranges(df, "d", "ord", "level", "page", end, parts=6)
        assert got.columns == [*df.columns, "parent_ord", "page_end", "serve_end"]
        assert rows(got) == rows(whole)
    assert tree.linked_in_ranges(df.limit(0), "d", "ord", "level", "page", parts=6).count() == 0


def test_linking_is_linear(spark):
    """A window of n frames over n rows would take minutes here."""
    level = F.when(F.pmod(F.xxhash64("id"), F.lit(50)) < 1, 1).otherwise(F.pmod(F.hash("id"), F.lit(3)) + 2)
    df = spark.range(200_000).select(F.lit(0).alias("d"), c("id").alias("ord"), level.alias("level"), (c("id") / 5).cast("int").alias("page"))
    began = time.time()
    assert tree.linked(df, "d", "ord", "level", "page").agg(F.count("page_end")).first()[0] == 200_000
    assert time.time() - began < 30


def test_what_is_small(spark):
    df = spark.range(10).select("id", F.lit("x" * 100).alias("t"), F.array(F.lit("y" * 50)).alias("l"))
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(sizes.small(df)) and hinted(sizes.small(df, 10, 10 * 250))
    assert not hinted(sizes.small(df, 9)) and not hinted(sizes.small(df, 10, 1000))
    assert hinted(sizes.small(df.limit(0)))


def test_headings_to_pins(spark):
    titles = ["QUADRO RP - Oneri", "SEZIONE I - Spese", "Rigo RP1 Spese", "Righi da RP8 a RP13", "codice 4", "REDDITI PERSONE FISICHE - ISTRUZIONI", "Sezione III A: righi seguenti:", "Altro"]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    assert [x[0] for x in df.select(tree.heading_level(c("t"))).collect()] == [1, 2, 3, 3, 4, None, None, None]
    pages = spark.createDataFrame(PAGES, "doc string, page int, markdown string")
    nodes = tree.build(pages, "doc", "page", "markdown")
    kinds = [(r.kind, r.page, r.parent_ord, r.page_end) for r in nodes.orderBy("ord").collect()]
    assert kinds == [("quadro", 69, None, 71), ("sezione", 70, 1, 71), ("rigo", 70, 2, 70), ("rigo", 71, 2, 71), ("codice", 71, 4, 71), ("sezione", 74, 1, 74), ("rigo", 74, 6, 74)]
    pins = tree.preambles(nodes, pages, "doc", "page", "markdown")
    assert dict(rows(pins, "ord", "text")) == {1: "Regole del quadro\nNota\nvalgono sempre", 2: "Testo della sezione", 4: "altre spese"}
    up = {r.ord: r.pins for r in tree.collected_pins(nodes, pins, "doc").collect()}
    assert up[5] == ["Regole del quadro\nNota\nvalgono sempre", "Testo della sezione", "altre spese"] and up[2] == up[7] == ["Regole del quadro\nNota\nvalgono sempre"] and 1 not in up


def test_blocks(spark):
    df = spark.createDataFrame([("d", p) for p in (1, 2, 2, 3, 7, 8)], "d string, p int")
    assert rows(tree.blocks(df, ["d"], "p")) == [("d", 1, 1, 3), ("d", 2, 1, 3), ("d", 3, 1, 3), ("d", 7, 7, 8), ("d", 8, 7, 8)]


# --- outcomes and evaluation


def test_escalation(spark):
    tries = [(1, 0, True, 1.0), (1, 1, True, 5.0), (2, 0, False, 1.0), (2, 1, True, 5.0), (3, 0, False, 1.0), (3, 1, False, 5.0), (3, 2, False, 9.0)]
    df = spark.createDataFrame([(*t, f"r{t[1]}") for t in tries], "page int, step int, passed boolean, usd double, why string")
    got = rows(outcome.escalation(df, ["page"], "step", "passed", "usd", "why"))
    assert got == [(1, 0, False, 1.0, "r0"), (2, 1, False, 6.0, "r1"), (3, 2, True, 15.0, "r2")]


def test_order_dependent(spark):
    df = spark.createDataFrame([("g", i, i % 2 == 0, 3.0) for i in range(10)], "g string, n int, ok boolean, usd double")
    assert [r.n for r in outcome.sampled(df, ["g"], ["n"], c("ok"), 0.5).where("audited").orderBy("n").collect()] == [2, 6]
    assert [r.n for r in outcome.within_budget(df, ["g"], ["n"], "usd", 8.0).orderBy("n").collect()] == [0, 1, 2]
    assert [r.open for r in outcome.breaker(df, ["g"], ["n"], c("n") == 3).orderBy("n").collect()] == [False] * 4 + [True] * 6
    assert [r.n for r in outcome.spread(df, ["n"], 3, ["g"]).orderBy("n").collect()] == [0, 3, 6]
    done, reviewed = df.where("n < 3").select("n"), df.where("n = 9").select("n")
    assert outcome.to_do(df, done, reviewed, ["n"]).count() == 6 and outcome.to_do(df, done, reviewed, ["n"], force=True).count() == 7


def test_model_calls(spark):
    df = spark.createDataFrame([(1, "a"), (2, "boom")], "n int, prompt string")

    def call(prompt):
        if prompt == "boom":
            raise RuntimeError("no")
        return prompt.upper()

    assert rows(outcome.called(df, "prompt", call), "n", "answer", "error") == [(1, "A", None), (2, None, "RuntimeError: no")]
    assert rows(outcome.called(df, "prompt", None), "n", "answer", "error") == [(1, None, None), (2, None, None)]


def test_judging(spark):
    cases = [("RP7", "Rigo RP 7 spese", True), ("spese, codice 29", "codice 29", True), ("codice 3", "codice 29", False), (None, "x", None), ("RP1", None, False), ("RP1", "Rigo RP10", False)]
    df = spark.createDataFrame([(e, t) for e, t, _ in cases], "e string, t string")
    assert [x[0] for x in df.select(evalkit.retrieval_hit(c("e"), c("t"))).collect()] == [x for _, _, x in cases]
    one = spark.createDataFrame([("Detrazione del 19% oltre 129,11 euro; NON_RIFIUTATO", ["19%", "129,11", "scontrino"])], "a string, f array<string>")
    got = one.select(evalkit.facts_covered(c("a"), c("f")).alias("x"), evalkit.facts_covered(c("a"), F.array().cast("array<string>")).alias("y"), evalkit.verdict(c("a"), F.lit(False)).alias("v"), evalkit.refuses(F.lit("Le istruzioni non  contengono la risposta")).alias("r")).first()
    assert (tuple(got.x), tuple(got.y), got.v, got.r) == ((2, 3), (0, 0), "NON_RIFIUTATO", True)


def test_verdicts(spark):
    replies = [("CORRETTO", True, "CORRETTO"), ("CORRETTO", False, "INDETERMINATO"), ("rifiuto_ok", False, "RIFIUTO_OK"), ("rifiuto_ok", True, "INDETERMINATO"), ("non_rifiutato, non RIFIUTO_OK", False, "NON_RIFIUTATO"), ("errato: non corretto", True, "ERRATO"), (None, True, "INDETERMINATO")]
    df = spark.createDataFrame([(r, a) for r, a, _ in replies], "r string, a boolean")
    assert [x[0] for x in df.select(evalkit.verdict(c("r"), c("a"))).collect()] == [v for _, _, v in replies]


def test_small_reports(spark, tmp_path):
    nodes = spark.createDataFrame([("quadro", 1, "Q", 3, 9), ("rigo", 3, "R", 4, 4), ("rigo", 3, "S", 5, 5)], "kind string, level int, title string, page int, page_end int")
    assert rows(tree.kind_histogram(nodes)) == [("quadro", 1), ("rigo", 2)]
    assert [r.line for r in tree.lines(nodes).collect()] == ["- [quadro] Q  (p.3-9)", "    - [rigo] R  (p.4-4)", "    - [rigo] S  (p.5-5)"]
    spike = spark.createDataFrame([("single_column", 0.9, 1.0), ("single_column", 0.8, 0.5), ("table_heavy", 0.9, 0.25)], "k string, a double, b double")
    assert rows(layout.class_means(spike, "k", ["a", "b"])) == [("single_column", 2, 0.85, 0.75), ("table_heavy", 1, 0.9, 0.25)]
    done = spark.createDataFrame([("A", 0, "ok", 0.5), ("B", 1, "needs_human", 0.25)], "route string, escalations int, status string, usd double")
    got = outcome.run_summary(done, spark.createDataFrame([(True,)], "gate_miss boolean")).first()
    assert (got.pages, got.route_b, got.breaker_tripped, got.usd) == (2, 1, True, 0.75)
    batch = spark.createDataFrame([("transcribed", True, 1.0, 0.5), ("skipped", False, None, None), ("failed", False, 0.0, 0.0)], "status string, needs_review boolean, usd double, eur double")
    assert tuple(outcome.batch_summary(batch).first()) == (3, 1, 1, 1, 1, 1.0, 0.5)
    assert outcome.run_id() != outcome.run_id() and len(outcome.run_id()) == 36
    assert [x[0] for x in spark.createDataFrame([(0.1,), (0.2,), (0.5,)], "r double").select(outcome.rate_verdict(c("r"))).collect()] == ["cheap first", "undecided", "strong first"]
    summary = spark.createDataFrame([("nav", 2, 52.5, None, 1.5, 12)], "arm string, n int, correct_pct double, hit_pct double, cost double, latency_ms int")
    assert evalkit.table_lines(summary, ["arm"]).first().line == f"  {'nav':28} {2:>3}  {52.5:>7.0f}%  {'—':>8}  {1.5:>7.3f}  {12:>6}"
    reviews = spark.createDataFrame([("correction", "a", "b"), ("false positive", "a", None)], "action string, text_refused string, text_resolved string")
    one, two = store.resolved(reviews).collect()
    assert (one.status, two.status) == ("corretta_umano", "accettata_umano") and one.sha_resolved != one.sha_refused == two.sha_resolved == two.sha_refused
    spans = spark.createDataFrame([(1, 1, 0, "l", 9.0, 0, "ZapfDingbats", 9.0), (1, 1, 1, " voce", 9.0, 0, "x", 9.0), (1, 2, 0, "Titolo", 12.0, 0, "x", 9.0)], "page int, line int, at int, text string, size double, flags int, font string, body double")
    assert rows(layout.span_text(spans, ["page"], "body"), "line", "text") == [(1, "- voce"), (2, "## Titolo")]
    wide = spark.createDataFrame([(0, 0, i, 0.0, float(x), 10.0) for i, x in enumerate((1, 2, 2, 9))], "page int, block int, line int, x0 double, x1 double, width double")
    geometry = layout.page_geometry(wide, ["page"]).first()
    assert (geometry.n_lines, geometry.median_width, geometry.wide) == (4, 0.2, 0.25)


def test_ledger_append(spark, tmp_path, calls):
    path = str(tmp_path / "ledger")
    first = ledger.recorded(calls, path)
    more = ledger.recorded(calls.withColumn("ts", F.lit(None).cast("string")).limit(1), path)
    assert first.select("call_id").distinct().count() == first.count() == 3 and first.where("ts is null").count() == 0
    assert more.count() == 1 and more.first().ts.endswith("+00:00")
    assert ledger.total(spark.read.parquet(path)).first().calls == 4


def test_numbering_in_clustered_ranges(spark):
    """Ranges hold about as many rows each wherever the values lie; ties are settled by other columns."""
    df = spark.range(4000).select(F.when(c("id") < 10, c("id") * 10**12).otherwise(10**15 + c("id")).alias("n"), F.lit("g").alias("g"))
    sizes = [r["count"] for r in tree.ranged(df, ["g"], "n", 8).groupBy("_r").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 600
    tied = spark.createDataFrame([("g", i // 4, i) for i in range(40)], "g string, n int, id int")
    got = tree.numbered_in_ranges(tied, ["g"], "n", 5, ties=("id",))
    assert [r.ord for r in got.orderBy("id").collect()] == list(range(1, 41))


def test_numbering_in_ranges(spark):
    df = spark.createDataFrame([("a" if i % 3 else None, None if i == 7 else i * i) for i in range(40)], "g string, n long")
    by = lambda f: {(r.g, r.n): r.ord for r in f.collect()}
    assert by(tree.numbered_in_ranges(df, ["g"], "n", 5)) == by(tree.numbered(df, ["g"], ["n"]))
    assert tree.numbered_in_ranges(df.limit(0), ["g"], "n", 5).count() == 0


def test_configuration(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("aliases:\n- {term: dentista, expand: [spese sanitarie, 36]}\n")
    (tmp_path / "s.toml").write_text("[gate]\nleast = 8.0\n")
    assert tables.alias_table(str(tmp_path / "a.yaml")) == {"dentista": ["spese sanitarie", "36"]}
    assert tables.settings(str(tmp_path / "s.toml"))["gate"]["least"] == 8.0
    df = spark.createDataFrame([(2, "b", None), (1, "a", "x"), (3, "a", "y")], "n int, k string, v string")
    tables.write_report(df.orderBy("n"), str(tmp_path / "out"))
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "out"))) == [("1", "a", "x"), ("2", "b", None), ("3", "a", "y")]
    assert rows(tables.by_key(df, n=2)) == [(2, "b", None)] and tables.by_key(df, n=9).count() == 0
    assert [r.n for r in tables.of(df, "n", k="a").collect()] == [1, 3] and rows(tables.of(df, v=None), "n") == [(2,)]


def test_reports(spark):
    res = spark.createDataFrame([("nav", "x", True, True, 0.1, 10), ("nav", "y", False, False, 0.2, 15), ("full", "x", True, None, 0.1, 20)], "arm string, origin string, correct boolean, hit boolean, cost double, latency int")
    assert rows(evalkit.summary(res, ["arm"])) == [("full", 1, 1, 100.0, None, 0.1, 20), ("nav", 2, 1, 50.0, 50.0, 0.3, 12)]
    assert {(r.level, r.arm, r.value) for r in evalkit.rollup(res, "arm", ["origin"]).collect()} == {("arm", "nav", None), ("arm", "full", None), ("origin", "nav", "x"), ("origin", "nav", "y"), ("origin", "full", "x")}
    assert [r.arm for r in evalkit.interleaved(res, "arm", "origin", 2).collect()] == ["full", "nav"]
    assert rows(spark.range(1).select(evalkit.identity_issues(F.lit(" 2024"), F.lit("x"), F.lit("Redditi PF"), "2024", "2023", "redditi"))) == [(["period"],)]


def test_files(spark, tmp_path):
    (tmp_path / "p002.md").write_text("two\nlines")
    (tmp_path / "p010.md").write_text("ten")
    assert rows(tables.page_files(spark, str(tmp_path))) == [(10, "ten"), (2, "two\nlines")]
    (tmp_path / "q_external.yaml").write_text("cases:\n- {id: a, domanda: x, must_include: [19%]}\n")
    got = tables.question_files(spark, [str(tmp_path / "q_external.yaml")]).first()
    assert (got.difficolta, got.hops, got.answerable, got.origin) == ("media", 1, True, "external")
    made = spark.createDataFrame([("m", None, "body")], "a string, b string, t string").select(tables.front_matter(["a", "b"], "t").alias("x")).first().x
    assert made == "---\na: m\nb: null\n---\nbody"


def test_stream(spark, tmp_path):
    data = spark.createDataFrame([(f"2026-01-01 0{h}:30:00", "a", 1.0) for h in (1, 1, 2)] + [("2026-01-01 09:00:00", "b", 5.0)], "ts string, purpose string, usd double").withColumn("ts", c("ts").cast("timestamp"))
    data.write.parquet(str(tmp_path / "in"))
    stream = hourly(spark.readStream.schema(data.schema).parquet(str(tmp_path / "in")), "1 hour")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("hourly_costs").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("hourly_costs")) == rows(hourly(data))
