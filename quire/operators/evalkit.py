"""Question sets and how well they were answered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How a refusal reads; verdicts on an answer, and on the refusal that a question without one asks
# for, the more specific and negative ones first; those that are right; patterns of identifiers of nodes.
REFUSALS = ("non contengono la risposta", "non contiene la risposta", "non è presente", "non e' presente", "non sono presenti")
VERDICTS = ("ERRATO", "PARZIALE", "CORRETTO")
REFUSAL_VERDICTS = ("NON_RIFIUTATO", "RIFIUTO_OK")
RIGHT = ("CORRETTO", "RIFIUTO_OK")
ROW, CODE, SECTION = r"rp\s*(\d+)", r"cod(?:ice|ici)\s*(\d+)", r"(sezione\s+[ivx]+(?:\s*-?\s*[a-z]\b)?)"


def normal(c: Column) -> Column:
    """Lower case without double quotes, runs of white space as one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), '["“”]', ""), r"(?U)\s+", " "))


def refuses(answer: Column, markers: tuple[str, ...] = REFUSALS) -> Column:
    low = normal(answer)
    found = F.lit(False)
    for m in markers:
        found |= F.contains(low, F.lit(m))
    return found


def facts_covered(answer: Column, facts: Column) -> Column:
    """(hits, total) of the facts that an answer holds."""
    low = normal(answer)
    hits = F.size(F.filter(F.coalesce(facts, F.array().cast("array<string>")), lambda f: F.contains(low, normal(f))))
    return F.struct(hits.alias("hits"), F.coalesce(F.size(facts), F.lit(0)).alias("total"))


def verdict(reply: Column, answerable: Column) -> Column:
    """The first label in a judge's reply, of those that fit the kind of question."""
    up = F.upper(F.coalesce(reply, F.lit("")))

    def first(labels: tuple[str, ...]) -> Column:
        out = F.lit("INDETERMINATO")
        for v in reversed(labels):
            out = F.when(F.contains(up, F.lit(v)), F.lit(v)).otherwise(out)
        return out

    return F.when(answerable, first(VERDICTS)).otherwise(first(REFUSAL_VERDICTS))


def judge_prompt(question: Column, answer: Column, answerable: Column, facts: Column) -> Column:
    """What a judge is asked: whether the facts are met, or whether the answer rightly refuses."""
    expected = F.when(F.size(facts) > 0, F.array_join(facts, "; ")).otherwise("(nessuno)")
    labels = F.when(answerable, ", ".join(reversed(VERDICTS))).otherwise(", ".join(reversed(REFUSAL_VERDICTS)))
    wanted = F.when(answerable, F.concat(F.lit("FATTI ATTESI: "), expected)).otherwise("La risposta non è nel corpus: va rifiutata.")
    return F.concat_ws("\n\n", F.concat(F.lit("DOMANDA: "), question), wanted, F.concat(F.lit("RISPOSTA: "), answer), F.concat(F.lit("Rispondi solo con una di: "), labels))


def anchors(expected: Column) -> Column:
    """Identifiers of nodes in an expectation: rows, codes, and its first section."""
    e = normal(expected)
    rows = F.transform(F.regexp_extract_all(e, F.lit(ROW), 1), lambda n: F.concat(F.lit("rp"), n))
    codes = F.transform(F.regexp_extract_all(e, F.lit(CODE), 1), lambda n: F.concat(F.lit("codice "), n))
    section = F.regexp_extract(e, SECTION, 1)
    named = F.when(section != "", F.array(F.trim(F.regexp_replace(section, r"[\s-]+", " ")))).otherwise(F.array().cast("array<string>"))
    return F.concat(rows, codes, named)


def retrieval_hit(expected: Column, title: Column) -> Column:
    """Whether the node found is the one expected; null where none is."""
    t = F.regexp_replace(normal(title), ROW, "rp$1")
    found = F.exists(anchors(expected), lambda a: F.regexp_like(t, F.concat(F.lit(r"(?U)\b\Q"), a, F.lit(r"\E\b"))))
    by_text = F.contains(t, normal(expected))
    hit = F.when(F.size(anchors(expected)) == 0, by_text).otherwise(found)
    return F.when(F.coalesce(expected, F.lit("")) == "", F.lit(None).cast("boolean")).when(F.coalesce(title, F.lit("")) == "", F.lit(False)).otherwise(hit)


def _measures(correct: str, hit: str, cost: str, latency: str) -> list[Column]:
    right = F.count_if(F.col(correct))
    return [
        F.count(F.lit(1)).alias("n"), right.alias("correct"), F.round(100.0 * right / F.count(F.lit(1)), 1).alias("correct_pct"),
        F.round(100.0 * F.avg(F.col(hit).cast("int")), 1).alias("hit_pct"), F.round(F.sum(cost), 4).alias("cost"),
        F.floor(F.avg(latency)).cast("long").alias("latency_ms"),
    ]


def summary(results: DataFrame, keys: list[str], correct: str = "correct", hit: str = "hit", cost: str = "cost", latency: str = "latency") -> DataFrame:
    """Measures by any keys, in the order of the keys as strings; the share of hits is over those that apply."""
    return results.groupBy(*keys).agg(*_measures(correct, hit, cost, latency)).orderBy(*[F.col(k).cast("string") for k in keys])


def table_lines(summary: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., line): each row of a summary at a fixed width."""
    name = F.concat_ws(" · ", *[F.coalesce(F.col(k).cast("string"), F.lit("None")) for k in keys])
    hit = F.when(F.col("hit_pct").isNull(), "—").otherwise(F.format_string("%.0f%%", F.bround("hit_pct", 0)))
    line = F.format_string("  %-28s %3d  %7.0f%%  %8s  %7.3f  %6d", name, "n", F.bround("correct_pct", 0), hit, F.col("cost").cast("double"), "latency_ms")
    return summary.select(*keys, line.alias("line"))


def rollup(results: DataFrame, first: str, others: list[str], correct: str = "correct", hit: str = "hit", cost: str = "cost", latency: str = "latency") -> DataFrame:
    """The summary by `first`, and by it and each of `others`, in one pass; level names the key."""
    sets = [[F.col(first)], *[[F.col(first), F.col(o)] for o in others]]
    grouped = results.groupingSets(sets, F.col(first), *map(F.col, others))
    level = F.lit(first)
    for o in others:
        level = F.when(F.grouping(o) == 0, F.lit(o)).otherwise(level)
    return grouped.agg(level.alias("level"), *_measures(correct, hit, cost, latency)).select("level", first, F.coalesce(*[F.col(o).cast("string") for o in others]).alias("value"), "n", "correct", "correct_pct", "hit_pct", "cost", "latency_ms")


def stratification(cases: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, value, n) for each dimension by itself, in one pass."""
    each = [F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]
    return cases.select(F.explode(F.array(*each)).alias("x")).groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n"))


def cross_tab(cases: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    return cases.groupBy(row).pivot(column, values).count().fillna(0, values)


def interleaved(cases: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first n cases, taken from the groups in turn. No more than n of a group can be among them, which keeps
    each task's share of a large group at n rows before the shuffle."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return cases.withColumn("turn", place).where(F.col("turn") <= n).orderBy("turn", group).limit(n)


def identity_issues(edition: Column, period: Column, model: Column, want_edition: str, want_period: str, hint: str) -> Column:
    """What is wrong with the identity read from a front page."""
    trimmed = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return F.array_compact(F.array(
        F.when(trimmed(edition) != want_edition, F.lit("edition")),
        F.when(trimmed(period) != want_period, F.lit("period")),
        F.when(~F.contains(F.lower(trimmed(model)), F.lit(hint.lower())), F.lit("model")),
    ))
