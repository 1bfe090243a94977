"""From questions to what is served for them, and what is kept of it.

Nodes are (doc, node_id, parent_id, ord, kind, level, title, page, page_end, serve_end), with ids that differ
between documents; pages are (doc, page, text); pins are (node_id, text) of the nodes that govern what is below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import evalkit, index, outcome, tree
from quire.sources.scratch import written

# The marks of a served context and of a case that retrieval refuses.
GOVERNING, ENTRY = "=== REGOLE GOVERNANTI (ereditate dallo scope superiore) ===", "=== VOCE ==="
REFUSAL = "Le istruzioni fornite non contengono la risposta a questa domanda."
ARMS = ("navigazione", "servi_intero")
_FRONT = r"(?s)\A---\n.*?\n---\n"


def _body(text: str) -> Column:
    return tx.stripped(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), _FRONT, ""))


def page_text(nodes: DataFrame, pages: DataFrame, end: str = "page_end") -> DataFrame:
    """(node_id, text): the pages of each node's range in order, without front matter."""
    wanted = nodes.select("doc", "node_id", F.explode(F.sequence("page", end)).alias("page"))
    listed = F.array_sort(F.collect_list(F.struct("page", _body("text").alias("t"))))
    text = tx.dehyphenated(F.array_join(F.transform(listed, lambda x: x["t"]), "\n\n"))
    return wanted.join(pages.where("text <> ''"), ["doc", "page"]).groupBy("node_id").agg(text.alias("text"))


def governing(nodes: DataFrame, pins: DataFrame, levels: int = tree.LEVELS, of: DataFrame | None = None) -> DataFrame:
    """(node_id, pins): kind, title and text of the passages of a node's ancestors, root first; of all nodes, or of some."""
    owners = nodes.select(F.col("node_id").alias("ancestor"), "kind", "title").join(pins.select(F.col("node_id").alias("ancestor"), "text"), "ancestor")
    found = tree.ancestors(nodes, "node_id", "parent_id", levels, of).join(owners, "ancestor")
    listed = F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "kind", "title", "text")))
    return found.groupBy("node_id").agg(F.transform(listed, lambda x: F.struct(x["kind"].alias("kind"), x["title"].alias("title"), x["text"].alias("text"))).alias("pins"))


def _reason(least: float, margin: float) -> Column:
    top1, top2 = F.col("top1"), F.coalesce("top2", F.lit(0.0))
    times = F.when(top2 > 0, F.format_string("%.2fx", top1 / top2)).otherwise("inf")
    return (
        F.when(top1.isNull(), "nessun match lessicale")
        .when(top1 < least, F.format_string(f"top1 %.1f < soglia_assoluta {least}", top1))
        .when((top2 > 0) & (top1 < margin * top2), F.concat(F.lit("margine "), times, F.lit(f" < {margin}x (top2 vicino)")))
        .otherwise(F.concat(F.format_string("top1 %.1f, margine ", top1), times))
    )


def run(queries: DataFrame, query: str, text: str, nodes: DataFrame, pages: DataFrame, pins: DataFrame, keywords: DataFrame | None, choices: DataFrame | None, least: float = 8.0, margin: float = 1.5, k: int = 8, matches: DataFrame | None = None, choose: Callable[[str], str] | None = None, log: str | None = None) -> DataFrame:
    """(query, gate, reason, method, node_id, target_title, target_pages, candidates, pins, served_text) of each
    question: the best node where the gate is clear, else where the descent by `choices` (query, node_id, score)
    ends; it is refused where that ends nowhere. Served are the pages up to the next node's, below what governs them.
    Matches (query, node_id, score, place) may be given instead of keywords. With `choose`, which replies to a prompt,
    replies lead the descent instead of scores (index.descend_by; node_id is an integer then, and nodes may have a
    summary), paid once with `log`. Matches and nodes are read many times, and so are kept as scratch, which the result reads."""
    found = written((index.match(queries, query, text, keywords, k) if matches is None else matches).where(F.col("place") <= k), "found")
    nodes, pins = written(nodes, "nodes"), written(pins, "pins")
    gated = written(index.gate(queries, query, found, least, margin), "gates")
    listed = F.array_sort(F.collect_list(F.struct("place", "node_id", "score")))
    ranked = found.groupBy(query).agg(F.transform(listed, lambda x: F.struct(x["node_id"].alias("node_id"), x["score"].alias("score"))).alias("candidates"))
    unsure = gated.where("gate <> 'netto'")
    if choose:
        known = nodes if "summary" in nodes.columns else nodes.withColumn("summary", F.lit(None).cast("string"))
        asked = queries.join(unsure.select(query), query, "left_semi")
        down = index.descend_by(known, asked, query, text, choose, tree.LEVELS, log).drop("path").withColumn("node_id", F.col("node_id").cast(nodes.schema["node_id"].dataType))
    else:
        down = index.descend(nodes, choices, query, tree.LEVELS, unsure)
    down = down.withColumnRenamed("node_id", "_down")
    clear = F.col("gate") == "netto"
    aimed = gated.join(ranked, query, "left").join(down, query, "left").withColumn("node_id", F.when(clear, F.col("candidates")[0]["node_id"]).otherwise(F.col("_down")))
    method = F.when(clear, "fast_path").when(F.col("node_id").isNotNull(), "navigation_descent").otherwise("refused")
    aimed = written(aimed.select(query, "gate", _reason(least, margin).alias("reason"), method.alias("method"), "node_id", "candidates"), "aimed")
    found = served(nodes, pages, pins, aimed.select("node_id").distinct())
    return aimed.join(found, "node_id", "left").select(*aimed.columns, "target_title", "target_pages", "pins", "served_text")


def served(nodes: DataFrame, pages: DataFrame, pins: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(node_id, target_title, target_pages, pins, served_text) of nodes (those wanted, or all): the passages that
    govern a node under their heads, root first, then its title and its pages up to the next node's."""
    targets = nodes if wanted is None else nodes.join(wanted, "node_id", "left_semi")
    titles = targets.select("node_id", F.col("title").alias("target_title"), F.concat_ws("-", "page", "page_end").alias("target_pages"))
    found = titles.join(page_text(targets, pages, "serve_end"), "node_id", "left").join(governing(nodes, pins, of=targets), "node_id", "left")
    rules = F.transform("pins", lambda p: F.concat(F.lit("["), p["kind"], F.lit("] "), p["title"], F.lit("\n"), p["text"]))
    entry = F.concat(F.lit(ENTRY + "\n"), F.coalesce("target_title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    return found.withColumn("served_text", F.concat_ws("\n\n", F.when(F.size("pins") > 0, F.concat(F.array(F.lit(GOVERNING)), rules)), entry)).drop("text")


def baseline(pages: DataFrame) -> DataFrame:
    """(doc, text): all pages of a section, each under its number."""
    listed = F.array_sort(F.collect_list(F.struct("page", F.concat(F.lit("== p."), F.col("page"), F.lit(" ==\n"), _body("text")).alias("t"))))
    return pages.groupBy("doc").agg(F.array_join(F.transform(listed, lambda x: x["t"]), "\n\n").alias("text"))


def traces(results: DataFrame, query: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """(query, outcome, trace): what run() found as JSON, with further columns of results."""
    owners = F.coalesce(F.transform("pins", lambda p: p["title"]), F.array().cast("array<string>")).alias("pin_owners")
    trace = F.to_json(F.struct("gate", "reason", "method", F.col("node_id").alias("target_node_id"), "candidates", owners, *extra), {"ignoreNullFields": "false"})
    return results.select(query, F.when(F.col("node_id").isNull(), "refused").otherwise(F.col("method")).alias("outcome"), trace.alias("trace"))


def run_cases(cases: DataFrame, case: str, results: DataFrame, contexts: DataFrame, call: Callable | None = None, judge: Callable | None = None, log: str | None = None) -> DataFrame:
    """Each case (case, doc, question, expected, facts, answerable) on both arms: the context of run() or of
    baseline(), its answer, a judge's verdict on it, and how it compares. Without a context the answer is a refusal
    and no call is made for it; only navigation can hit. call and judge take a prompt and return a reply, or (reply,
    usd); cost_usd sums what both calls (and a column usd of results) cost, latency_ms is the answer's. With `log` a
    prompt is paid once, whatever fails or is run again."""
    spent = (F.col("usd") if "usd" in results.columns else F.lit(0.0)).cast("double").alias("_usd")
    nav = cases.join(results.select(case, F.col("served_text").alias("served"), "target_title", spent), case, "left").withColumn("arm", F.lit(ARMS[0]))
    whole = cases.join(contexts.select("doc", F.col("text").alias("served")), "doc", "left").withColumns({"target_title": F.lit(None).cast("string"), "arm": F.lit(ARMS[1]), "_usd": F.lit(0.0)})
    prompt = F.when(F.col("served") != "", F.concat(F.lit("CONTESTO:\n"), "served", F.lit("\n\nDOMANDA: "), "question"))
    both = nav.unionByName(whole).withColumn("prompt", prompt)
    said = outcome.called(both, "prompt", call and (lambda p: None if p is None else call(p)), "_said_", log and f"{log}/answers")
    said = said.withColumn("answer", F.when(F.col("prompt").isNull(), REFUSAL).otherwise(F.col("_said_answer")))
    said = said.withColumn("_asked", evalkit.judge_prompt(F.col("question"), F.col("answer"), F.col("answerable"), F.col("facts")))
    said = outcome.called(said, "_asked", judge and (lambda p: None if p is None else judge(p)), "_judged_", log and f"{log}/verdicts")
    said = said.withColumn("verdict", F.when(F.col("_judged_answer").isNotNull(), evalkit.verdict(F.col("_judged_answer"), F.col("answerable"))))
    hit = F.when(F.col("arm") == ARMS[0], evalkit.retrieval_hit(F.col("expected"), F.col("target_title")))
    cost = F.round(sum((F.coalesce(c, F.lit(0.0)) for c in ("_said_usd", "_judged_usd")), F.coalesce("_usd", F.lit(0.0))), 6)
    return said.select(
        case, "arm", "prompt", "answer", F.coalesce("_said_error", "_judged_error").alias("error"), "verdict", F.col("verdict").isin(*evalkit.RIGHT).alias("correct"),
        evalkit.refuses(F.col("answer")).alias("refused"), evalkit.facts_covered(F.col("answer"), F.col("facts")).alias("facts"), hit.alias("hit"), "target_title",
        cost.alias("cost_usd"), F.when(F.col("prompt").isNull(), F.lit(0).cast("long")).otherwise(F.col("_said_ms")).alias("latency_ms"),
    )


def scope_inputs(nodes: DataFrame, pages: DataFrame, limit: int = 6000) -> DataFrame:
    """nodes with is_leaf, child_titles, own_text and the message that asks for a summary: a branch is told by the
    titles of its children, a leaf by its pages, at most `limit` characters (the reference's rule)."""
    listed = F.array_sort(F.collect_list(F.struct("ord", "title")))
    kids = nodes.where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.transform(listed, lambda x: x["title"]).alias("child_titles"))
    leaves = nodes.join(kids, "node_id", "left_anti")
    own = page_text(leaves, pages).select("node_id", F.substring("text", 1, limit).alias("own_text"))
    out = nodes.join(kids, "node_id", "left").join(own, "node_id", "left").withColumn("is_leaf", F.col("child_titles").isNull())
    out = out.withColumns({"child_titles": F.coalesce("child_titles", F.array().cast("array<string>")), "own_text": F.coalesce("own_text", F.lit(""))})
    text = F.when(F.col("own_text") == "", "(nessun testo estratto)").otherwise(F.col("own_text"))
    rest = F.when(F.col("is_leaf"), F.array(F.lit(""), F.lit("Testo della voce:"), text)).otherwise(
        F.concat(F.array(F.lit(""), F.lit("Sotto-voci contenute (figli diretti):")), F.transform("child_titles", lambda t: F.concat(F.lit("- "), t)))
    )
    return out.withColumn("message", F.concat_ws("\n", F.concat(F.lit("Tipo voce: "), "kind"), F.concat(F.lit("Titolo: "), "title"), rest))


def representative(scopes: DataFrame, n: int, first: tuple[str, ...] = ("quadro", "sezione")) -> DataFrame:
    """At most n scopes of each document for a trial run: the first of each of the kinds, then leaves in order."""
    place = F.row_number().over(Window.partitionBy("doc", "kind").orderBy("ord", "node_id"))
    rank = F.when(F.col("is_leaf"), len(first))
    for i, kind in reversed(list(enumerate(first))):
        rank = F.when((F.col("kind") == kind) & (F.col("_place") == 1), i).otherwise(rank)
    taken = F.row_number().over(Window.partitionBy("doc").orderBy("_rank", "ord", "node_id"))
    ranked = scopes.withColumn("_place", place).withColumn("_rank", rank).where("_rank is not null")
    return ranked.withColumn("_taken", taken).where(F.col("_taken") <= n).drop("_place", "_rank", "_taken")


def payload(scopes: DataFrame, pins: DataFrame, keywords: DataFrame, extra: tuple[str, ...] = (), k: int = 14) -> DataFrame:
    """(doc, node_id, payload): all that is shown of a node as JSON, with its top keywords and further columns."""
    listed = F.array_sort(F.collect_list(F.struct("place", "term", "weight")))
    kw = index.top_keywords(keywords, k).groupBy("node_id").agg(F.transform(listed, lambda x: F.struct(x["term"].alias("term"), x["weight"].alias("weight"))).alias("kw"))
    full = scopes.join(governing(scopes, pins), "node_id", "left").join(kw, "node_id", "left")
    fields = [F.col("node_id").alias("id"), F.col("parent_id").alias("parent"), "kind", "level", "title", F.concat_ws("-", "page", "page_end").alias("pages"), "is_leaf", F.col("message").alias("input"), "pins", "kw"]
    return full.select("doc", "node_id", F.to_json(F.struct(*fields, *extra), {"ignoreNullFields": "false"}).alias("payload"))


def question_log(query: Column, ts: Column, doc: Column, text: Column, sections: Column) -> Column:
    """Markdown of a question: its head, then sections (title, body) by number."""
    head = F.concat(F.lit("# Q&A log — "), query, F.lit("\n\n- **timestamp:** "), ts, F.lit("\n- **documento:** "), doc, F.lit("\n- **query:** "), text, F.lit("\n"))
    each = F.transform(sections, lambda s, i: F.concat(F.lit("\n---\n\n## "), i + 1, F.lit(". "), s["title"], F.lit("\n\n"), s["body"], F.lit("\n")))
    return F.concat(head, F.array_join(each, ""))


def fenced(text: Column, lang: str = "") -> Column:
    return F.concat(F.lit(f"```{lang}\n"), text, F.lit("\n```"))


def chosen(reply: Column, allowed: Column) -> Column:
    """The first integer of a reply, if it is one of those allowed."""
    found = F.regexp_extract(reply, r"\d+", 0).try_cast("long")
    return F.when(F.array_contains(allowed, found), found)


def parsed(reply: Column, schema: str, required: tuple[str, ...]) -> Column:
    """A structured reply as a struct; null where it is no such object or lacks a required field."""
    found = F.from_json(reply, schema, {"mode": "PERMISSIVE"})
    whole = F.lit(True)
    for name in required:
        whole &= found[name].isNotNull()
    return F.when(whole, found)


def page_list(listed: Column, start: Column, end: Column) -> Column:
    """Pages from a list with commas, else from an inclusive range; null where neither is given."""
    numbers = F.transform(F.filter(F.split(listed, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("int"))
    between = F.when(start <= end, F.sequence(start, end)).otherwise(F.array().cast("array<int>"))
    return F.when(F.coalesce(listed, F.lit("")) != "", numbers).when(start.isNotNull() & end.isNotNull(), between)
