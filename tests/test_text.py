import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.functions import quality
from quire.functions import text as tx


@pytest.fixture(scope="module")
def value(spark):
    def run(column, **texts):
        row = spark.createDataFrame([tuple(texts.values())], ", ".join(f"{k} string" for k in texts) or "x int") if texts else spark.range(1)
        return row.select(column.alias("v")).first().v

    return run


c = F.col


def test_numbers(value):
    assert {*value(tx.numbers(c("t")), t="tassa 48,07 euro al rigo 3, tetto 2.065,83 e 26%")} == {"48.07", "3", "2065.83", "26"}
    assert value(tx.numbers(c("t")), t="1.234 e 1.234.") == ["1.234"]


def test_words_and_lines(value):
    assert value(tx.plain(c("t")), t="Società à È") == "societa a e" == value(tx.decomposed(c("t")), t="Società à È")
    assert value(tx.decomposed(c("t")), t="ﬁ Ŵ") == "fi w" == value(tx.folded(c("t")), t="ﬁ Ŵ") and value(tx.folded(c("t")), t="È ok") == "e ok"
    assert value(tx.terms(tx.folded(c("t"))), t="ősi śpiew, ﬁlo") == ["osi", "spiew", "filo", "osi spiew", "spiew filo"]
    assert value(tx.terms(tx.plain(c("t"))), t="Le spese per la casa, 36 e 360") == ["spese", "casa", "360", "spese casa", "casa 360"]
    assert value(tx.terms(c("t")), t="") == []
    for t in ("a\r\nb\x0bc\x1cd e\n", "", "\n", "x\n\ny", "no end"):
        assert value(tx.lines(c("t")), t=t) == t.splitlines()
    assert value(tx.stripped(c("t")), t="  \t x y\n ") == "x y"
    assert value(tx.dehyphenated(c("t")), t="soprat\u00ad\ntutto bene") == "soprattutto bene"
    assert value(tx.content_words(c("t")), t="PERCIÒ perciò ab Zweck") == ["perciò", "zweck"]


def test_measures(value):
    assert value(quality.token_overlap(c("a"), c("b")), a="pane vino", b="vino pane olio sale") == 0.5
    assert value(quality.coverage(c("a"), c("b")), a="xyz", b="uvwxyz") == 0.5
    assert value(quality.coverage(c("a"), c("b")), a="ab", b=" ") == 1.0
    assert value(quality.repeats_itself(c("t")), t="totale parziale\n" * 24)
    assert not value(quality.repeats_itself(c("t")), t="\n".join(f"| anno {i} | vedi nota |" for i in range(16)))
    assert value(quality.repeats_itself(c("t")), t="uno due tre quattro cinque " * 25)
    assert value(quality.is_refusal(c("t")), t=" \n") and value(quality.is_refusal(c("t")), t="I'm sorry, no.")
    assert not value(quality.is_refusal(c("t")), t="Il contributo non può superare il limite")
    assert value(quality.early_subheadings(tx.lines(c("t"))), t="### x\n### y\n## z\n### w") == 2
    assert value(quality.heading_count(c("t")), t="# a\n## b\n### c\n#### d\n##e") == 2
    assert value(quality.without_artifacts(c("t"), ("(c)", "pag.")), t="uno (c)due pag. tre") == "uno due  tre"


def test_losses_and_codes(value):
    found = value(quality.critical_losses(c("a"), c("b")), a="vale entro maggio, tranne i minori", b="vale entro maggio, tranne i minori, e almeno una volta")
    assert [x.word for x in found] == ["almeno"]
    assert value(quality.critical_losses(c("a"), c("b")), a="salvotutto", b="salvotutto") == []
    swapped = value(quality.code_mismatches(c("a"), c("b")), a="7 = asili nido\n8 = affitti studenti", b="7 = affitti studenti\n8 = asili nido")
    assert [x.code for x in swapped] == ["7", "8"]
    assert value(quality.code_mismatches(c("a"), c("b")), a="3 = musei", b="3** = musei; 3 = teatri") == []
    assert not value(quality.audit_differs(c("a"), c("b")), a="non 100", b="100 non")
    assert value(quality.audit_differs(c("a"), c("b")), a="non", b="non 100") and value(quality.audit_differs(c("a"), c("b")), a="x", b="non x")


def test_lint(value):
    page, head = F.lit(12), F.array(F.lit("BOLLETTINO 7"))
    fails = lambda t: value(quality.lint(c("t"), head, page, ("refuso",)), t=t)
    assert fails("elenco\nn canoni di affitto").fails == ["unmapped bullet"] and fails("quota 4% %").fails == ["double symbol"]
    assert fails("nel BOLLETTINO 7 si").fails == ["header or footer"] and fails("uno\n 12 \ndue").fails == ["page number"]
    fine = fails("## titolo\n## titolo\nrefuso")
    assert fine.fails == [] and fine.warnings == ["repeated headings", "orphan: refuso"]


def test_verdict(spark):
    rows = [
        (1, "rigo 8, tetto 258,23", "rigo 8, tetto 258,23, 154"),
        (2, "quota 9 GHOST", "quota 9"),
        (3, "quota 9", "quota 9 GHOST"),
        (31, "affitti pagati", "affitti pagati 31"),
        (5, "soprattutto gli affitti", "soprat\u00ad\ntutto gli affitti"),
        (6, "", "testo"),
    ]
    df = spark.createDataFrame(rows, "page int, cand string, ref string")
    found = quality.checked(df, "cand", "ref", ("GHOST",), "page")
    assert found.columns[:4] == ["page", "cand", "ref", "overlap"] and not [x for x in found.columns if x.startswith("_")]
    got = {r.page: r for r in found.collect()}
    assert got[1].missing_numbers == ["154"] and got[1].needs_review and got[1].reasons == ["missing numbers"]
    assert got[2].reasons == ["artifacts"] and not got[3].needs_review and not got[31].needs_review and not got[5].needs_review
    assert "empty or refusal" in got[6].reasons


def test_texts_are_taken_apart_cheaply(spark, value):
    """What spares work gives the same: blocks rule n-grams out, texts without `=` have no code pairs, and the whole text
    in lower case has the same words."""
    r = random.Random(9)
    texts = [None, "", " ", "a " * 18, "a " * 17, "x y z " * 8 + "x y"]
    for _ in range(150):
        unit = [f"w{r.randint(0, 40)}" for _ in range(r.randint(1, 13))]
        texts.append(" ".join(w for _ in range(r.randint(1, 13)) for w in unit + [f"v{r.random()}"] * r.choice([0, 0, 0, 1, 3])))
    grams = lambda t: Counter(tuple(w[i : i + 10]) for w in [(t or "").split()] for i in range(len(w) - 9))
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", quality.repeats_itself(c("t")).alias("x")).collect()
    assert {x.t: x.x for x in got} == {t: max(grams(t).values(), default=0) > 8 for t in texts} and any(x.x for x in got)
    plain = spark.createDataFrame([(" ".join(f"w{i}" for i in range(60)),)], "t string")
    words, made = F.split("t", " "), F.when(c("t") != "", F.raise_error(F.lit("n-grams were made")).cast("array<string>"))
    assert plain.select(F.when(quality._may_repeat(words, 10, 8), F.size(made))).first()[0] is None
    assert value(tx.content_words(c("t")), t="KIL\u0130 kilo \u017feit \u212ailo") == ["kili\u0307", "kilo", "\u017feit"]
    assert value(tx.content_words(c("t")), t="kilo \u017feit \u212aILO") == ["kilo", "\u017feit"]
    assert value(tx.lines(c("t")), t="a\r\nb\r\rc\n\u2028d\n") == ["a", "b", "", "c", "", "d"]
    assert value(tx.stripped(c("t")), t="\u3000\u00a0 a b\u1680\u2029\n") == "a b" and value(quality.code_pairs(c("t")), t="12 b") == []


def test_losses_of_words_that_contain_others(value):
    """Single words and words of several parts, with capitals, marks and repetitions."""
    words = ("non", "Entro", "fino a", "a", "fino")
    found = value(quality.critical_losses(c("a"), c("b"), words), a="fino ad", b="NON non, fino a x; entro? Fino A y")
    assert [(x.word, x.candidate, x.reference) for x in found] == [("non", 0, 2), ("Entro", 0, 1), ("fino a", 0, 2), ("a", 0, 2), ("fino", 1, 2)]
    assert value(quality.critical_losses(c("a"), c("b"), ("fino a",)), a=None, b="fino a") == []
