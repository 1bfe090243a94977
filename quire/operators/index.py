"""A tf-idf index of nodes and the questions that are put to it, many at a time."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import windows
from quire.operators.outcome import called
from quire.operators.sizes import is_small, small
from quire.sources.scratch import written

#: What a question on its way down is asked.
DESCENT = "Rispondi col numero della sotto-voce in cui scendere, FERMA se basta la voce corrente, NESSUNA se niente è pertinente."


def _entries(items: DataFrame, node: str, fields: dict[str, float], normal, asked: DataFrame | None = None) -> DataFrame:
    """(node_id, term, w): each occurrence of a term with its field's weight; of the asked terms alone, if given."""
    found = [tx.terms(normal(F.coalesce(F.col(c), F.lit("")))) for c in fields]
    # a term's field is told by its place in one list, which costs less than a struct for each; where fields end is
    # counted before the list is opened, as no row of a term may carry the list
    named = items.select(F.col(node).alias("node_id"), F.array(*found).alias("x"))
    ends = [sum((F.size(F.col("x")[i]) for i in range(1, k)), F.size(F.col("x")[0])).alias(f"_{k}") for k in range(1, len(fields))]
    each = named.select("node_id", F.flatten("x").alias("x"), *ends).select("node_id", *[f"_{k}" for k in range(1, len(fields))], F.posexplode("x").alias("at", "term"))
    if asked is not None:
        each = each.join(asked, "term", "left_semi")
    *first, w = [F.lit(float(weight)) for weight in fields.values()]
    for k, weight in reversed(list(enumerate(first, 1))):
        w = F.when(F.col("at") < F.col(f"_{k}"), weight).otherwise(w)
    return each.select("node_id", "term", w.alias("w"))


def _worded(items: DataFrame, node: str, fields: dict[str, float], normal) -> DataFrame:
    """One row: how many nodes have any term, found without taking texts apart."""
    any_term = reduce(or_, (tx.has_terms(normal(F.coalesce(F.col(c), F.lit("")))) for c in fields))
    return items.where(any_term).select(F.col(node).alias("node_id")).distinct().agg(F.count(F.lit(1)).alias("nodes"))


def keyword_index(items: DataFrame, node: str, fields: dict[str, float], normal=tx.plain, asked: DataFrame | None = None) -> DataFrame:
    """(term, node_id, tf, df, weight) of items whose columns `fields` count with their weights. Nodes without a
    term don't count for the idf, ln((1 + nodes) / (1 + df)) + 1. With `asked` (term) only these terms are kept, as
    soon as they are read; their weights are the same.

    Texts are taken apart once and their terms dealt once: by term, as one sort gives tf and df, or, of asked terms, by
    node, so that what is asked of a node is found where it is."""
    if asked is None:
        order = Window.partitionBy("term", "node_id")
        tf = _entries(items, node, fields, normal).repartition("term")
        tf = tf.withColumns({"tf": F.sum("w").over(order), "_first": F.row_number().over(order.orderBy("node_id"))}).where("_first = 1")
        tf = tf.select("term", "node_id", "tf", F.count(F.lit(1)).over(Window.partitionBy("term")).alias("df"))
    else:
        wanted = asked.select("term").where("term is not null").distinct()
        few = is_small(wanted)
        found = _entries(items, node, fields, normal, F.broadcast(wanted) if few else wanted)
        tf = found.repartition("node_id").groupBy("term", "node_id").agg(F.sum("w").alias("tf"))
        df = tf.groupBy("term").agg(F.count("tf").alias("df"))  # counts what it could do without, to be the same plan below
        tf = tf.join(F.broadcast(df) if few else df, "term")  # no more rows than are asked
    idf = F.log((1 + F.col("nodes")) / (1 + F.col("df"))) + 1
    nodes = F.broadcast(_worded(items, node, fields, normal))
    return tf.crossJoin(nodes).select("term", "node_id", "tf", "df", F.round(F.col("tf") * idf, 4).alias("weight"))


def top_keywords(index: DataFrame, k: int = 14) -> DataFrame:
    """(…, place): the k terms of the largest weights of each node. They are dealt before they are ranked: of a node's
    terms few stand in one task of an index dealt by term, so that ranking them there would sort all and drop none."""
    place = F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("weight"), "term"))
    return index.repartition("node_id").withColumn("place", place).where(F.col("place") <= k)


def expanded(text: Column, aliases: dict[str, list[str]], normal=tx.plain) -> Column:
    """The terms of a question, then, for each alias that it contains, those of its expansions, each taken by
    itself, so that no pair of words spans two of them. Aliases are a configuration and part of the expression."""
    low, none = normal(text), F.array().cast("array<string>")
    more = [F.when(F.contains(low, normal(F.lit(a))), F.concat(*[tx.terms(normal(F.lit(e))) for e in es] or [none])).otherwise(none) for a, es in aliases.items()]
    return F.concat(tx.terms(low), *more)


def contained(texts: DataFrame, key: str, text: str, markers: DataFrame, marker: str, gram: int = 8) -> DataFrame:
    """(key, marker): which of any number of markers stand in which texts, as they are written. Every marker is looked
    for by one window of `gram` bytes alone (all of a shorter one; eight at most), that which the fewest texts have; texts
    that have it are then searched. Empty and null markers are in no text. The plan is the same for any list; keys tell
    texts apart."""
    runs = written(windows.of_markers(markers, marker, min(gram, windows.LONGEST)).distinct(), "runs")
    each = windows.in_texts(texts, key, text, runs)
    met = written(each.join(small(runs.select("_w", "_g").distinct()), ["_w", "_g"], "left_semi"), "grams")
    often = met.groupBy("_w", "_g").agg(F.count(F.lit(1)).alias("_n"))
    # a window that no text has rules its marker out
    n = F.coalesce("_n", F.lit(0))
    rarest = runs.join(often, ["_w", "_g"], "left").groupBy("_m").agg(F.min_by(F.struct("_w", "_g"), F.struct(n, "_g")).alias("_r"), F.min(n).alias("_n")).where("_n > 0")
    rarest = written(rarest.select("_m", "_r._w", "_r._g"), "rarest")
    likely = met.join(small(rarest), ["_w", "_g"]).select("_k", "_m").distinct()
    found = texts.select(F.col(key).alias("_key"), F.col(text).alias("_t")).join(likely, F.col("_key") == F.col("_k")).where(F.contains("_t", F.col("_m")))
    return found.select(F.col("_key").alias(key), F.col("_m").alias(marker))


def asked_terms_by(queries: DataFrame, query: str, text: str, aliases: DataFrame, normal=tx.plain) -> DataFrame:
    """asked_terms() with aliases as a table (alias, expansions array<string>) of any length, found by contained().
    Queries are told apart by `query`."""
    low = queries.select(query, normal(F.coalesce(F.col(text), F.lit(""))).alias("_low"))
    known = aliases.select(normal(F.col("alias")).alias("_alias"), "expansions")
    hits = contained(low, query, "_low", known, "_alias").join(known, "_alias")
    more = hits.select(query, F.explode("expansions").alias("_e")).select(query, F.explode(tx.terms(normal(F.col("_e")))).alias("term"))
    return low.select(query, F.explode(tx.terms(F.col("_low"))).alias("term")).unionByName(more).distinct()


def asked_terms(queries: DataFrame, query: str, text: str, aliases: dict[str, list[str]] | None = None, normal=tx.plain) -> DataFrame:
    """(query, term): the distinct terms of each question."""
    found = F.array_distinct(expanded(F.coalesce(F.col(text), F.lit("")), aliases or {}, normal))
    return queries.select(query, F.explode(found).alias("term"))


def match(queries: DataFrame, query: str, text: str, index: DataFrame, k: int = 8, normal=tx.plain, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """(query, node_id, score, place): nodes by the sum of the weights of the query's distinct terms; ties go to
    the smaller node."""
    asked = asked_terms(queries, query, text, aliases, normal).distinct()
    hits = index.select("term", "node_id", "weight").join(small(asked), "term")
    scored = hits.groupBy(query, "node_id").agg(F.round(F.sum("weight"), 4).alias("score"))
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), "node_id"))
    return scored.withColumn("place", place).where(F.col("place") <= k)


def gate(queries: DataFrame, query: str, matches: DataFrame, least: float = 8.0, margin: float = 1.5) -> DataFrame:
    """(query, gate, top1, top2): `netto`, `ambiguo` or, without any candidate, `vuoto`."""
    of = lambda p: F.max(F.when(F.col("place") == p, F.col("score")))
    best = matches.groupBy(query).agg(of(1).alias("top1"), of(2).alias("top2"))
    top1, top2 = F.col("top1"), F.coalesce("top2", F.lit(0.0))
    kind = F.when(top1.isNull(), "vuoto").when(top1 < least, "ambiguo").when((top2 > 0) & (top1 < margin * top2), "ambiguo").otherwise("netto")
    return queries.select(query).distinct().join(best, query, "left").select(query, kind.alias("gate"), "top1", "top2")


def descend(nodes: DataFrame, scores: DataFrame, query: str, depth: int = 6, asked: DataFrame | None = None) -> DataFrame:
    """(query, node_id): from the root, level by level to the child of the best score (nodes.node_id,
    parent_id; scores of query and node_id), at most `depth` levels; stops where no child has a score. With the
    queries that are asked all of them go down, and into a child without brothers whatever its score."""
    edges = nodes.select(F.col("parent_id").alias("_parent"), F.col("node_id").alias("_child"))
    known = scores.where("score is not null").select(F.col(query).alias("_q"), F.col("node_id").alias("_child"), "score").join(edges, "_child")
    best = known.groupBy("_q", "_parent").agg(F.min_by("_child", F.struct(-F.col("score"), "_child")).alias("_next"))
    lone = edges.groupBy(F.col("_parent").alias("_above")).agg(F.min("_child").alias("_lone"), F.count(F.lit(1)).alias("_n")).where("_n = 1")
    best, lone = written(best, "best"), written(lone, "lone")  # read once a level
    at = (scores if asked is None else asked).select(query).distinct().withColumn("node_id", F.lit(None).cast(nodes.schema["node_id"].dataType))
    for _ in range(depth):
        at = at.join(best, (F.col(query) == F.col("_q")) & F.col("node_id").eqNullSafe(F.col("_parent")), "left")
        if asked is not None:
            at = at.join(lone, F.col("node_id").eqNullSafe(F.col("_above")), "left").withColumn("_next", F.coalesce("_next", "_lone"))
        at = at.select(query, F.coalesce("_next", "node_id").alias("node_id"))
    return at


def descend_by(nodes: DataFrame, queries: DataFrame, query: str, text: str, choose: Callable[[str], str], depth: int = 6, log: str | None = None) -> DataFrame:
    """(query, node_id, path) of the questions, each led from the root down by replies: a level has one call for
    every question that is still on its way and stands before several children (nodes: node_id as an integer,
    parent_id, ord, kind, title, summary). An only child is taken without a call; NESSUNA refuses, FERMA or
    a number that is none of the children's stays. Each level is a join; no question waits for another. With `log` a
    prompt is paid once (outcome.replies)."""
    kids = F.array_sort(F.collect_list(F.struct("ord", "node_id", "kind", "title", F.coalesce("summary", F.lit("")).alias("summary"))))
    below = nodes.groupBy(F.col("parent_id").alias("_parent")).agg(kids.alias("_kids"))
    listed = F.array_join(F.transform("_kids", lambda k: F.concat(F.lit("["), k["node_id"], F.lit("] ("), k["kind"], F.lit(") "), k["title"], F.lit("\n    "), k["summary"])), "\n")
    below = small(below.select("_parent", F.transform("_kids", lambda k: k["node_id"].cast("long")).alias("_ids"), listed.alias("_listing")))
    titles = small(nodes.select(F.col("node_id").cast("long").alias("_at"), F.col("title").alias("_here")))
    none = F.lit(None).cast("long")
    at = queries.select(query, F.col(text).alias("_text"), none.alias("_node"), F.array().cast("array<long>").alias("path"), F.lit(True).alias("_on"))
    for _ in range(depth):
        on = F.when(F.col("_on"), F.col("_node"))
        step = at.join(below, F.col("_on") & on.eqNullSafe(F.col("_parent").cast("long")), "left").join(titles, F.col("_node") == F.col("_at"), "left")
        several = F.size("_ids") > 1
        prompt = F.concat(F.lit("Voce corrente: "), F.coalesce("_here", F.lit("(radice)")), F.lit("\n\nSotto-voci:\n"), "_listing", F.lit(f"\n\n{DESCENT}\n\nDomanda: "), F.coalesce("_text", F.lit("")))
        said = called(step.withColumn("_prompt", F.when(several, prompt)), "_prompt", lambda p: None if p is None else choose(p), log=log)
        up, number = F.upper(F.coalesce("answer", F.lit(""))), F.regexp_extract("answer", r"\d+", 0).try_cast("long")
        refused, stays = several & F.contains(up, F.lit("NESSUNA")), several & F.contains(up, F.lit("FERMA"))
        took = F.when(F.size("_ids") == 1, F.col("_ids")[0]).when(several & ~refused & ~stays & F.array_contains("_ids", number), number)
        moved = said.withColumn("_took", F.when(F.col("_on") & F.col("_ids").isNotNull(), took))
        at = moved.select(
            query, "_text", F.when(F.coalesce(refused, F.lit(False)), none).otherwise(F.coalesce("_took", "_node")).alias("_node"),
            F.when(F.col("_took").isNotNull(), F.concat("path", F.array("_took"))).otherwise(F.col("path")).alias("path"), F.col("_took").isNotNull().alias("_on"),
        )
    return at.select(query, F.col("_node").alias("node_id"), "path")


def sizes(index: DataFrame) -> DataFrame:
    """One row: entries, distinct terms and nodes of an index."""
    return index.agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("term").alias("terms"), F.countDistinct("node_id").alias("nodes"))


def index_sizes(items: DataFrame, node: str, fields: dict[str, float], normal=tx.plain) -> DataFrame:
    """sizes() of the keyword_index() of items, which isn't built: each node's distinct terms are counted where its
    text is, and only where rows repeat a node are they told apart once more."""
    found = F.array_distinct(F.concat(*[tx.terms(normal(F.coalesce(F.col(c), F.lit("")))) for c in fields]))
    each = items.select(F.col(node).alias("node_id"), F.explode(found).alias("term"))
    repeated = not items.groupBy(node).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty()
    counted = (each.distinct() if repeated else each).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = counted.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("entries"), F.count(F.lit(1)).alias("terms"))
    # null is no node, as in sizes()
    return terms.crossJoin(F.broadcast(_worded(items.where(F.col(node).isNotNull()), node, fields, normal)))


def boilerplate(pages: DataFrame, group: str, text: str, fraction: float = 0.6, least: int = 2) -> DataFrame:
    """(group, line, pages): lines that stand on many pages of a group, counted once a page."""
    sizes = pages.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    stripped = F.array_distinct(F.filter(F.transform(tx.lines(F.coalesce(F.col(text), F.lit(""))), tx.stripped), lambda x: x != ""))
    counted = pages.select(group, F.explode(stripped).alias("line")).groupBy(group, "line").agg(F.count(F.lit(1)).alias("pages"))
    return counted.join(sizes, group).where(F.col("pages") >= F.greatest(F.lit(least), F.floor(F.col("n") * fraction))).select(group, "line", "pages")


def without_lines(pages: DataFrame, page: str, group: str, text: str, known: DataFrame) -> DataFrame:
    """pages (page, group) with `text` less the lines in known (group, line), in order. Lines are filtered where they
    stand. A group's known lines come as one list: as each stands on a share of the group's pages, there are no more of
    them than a page has lines, divided by that share. Rows that repeat a page are rows of their own."""
    listed = written(known.where("line is not null").groupBy(F.col(group).alias("_g")).agg(F.collect_set("line").alias("_known")), "known")  # found once
    with_known = pages.select(page, group, text).join(small(listed), F.col(group) == F.col("_g"), "left")
    rows = tx.lines(F.coalesce(F.col(text), F.lit("")))
    kept = F.filter(rows, lambda r: ~F.array_contains(F.col("_known"), tx.stripped(r)))
    return with_known.select(page, group, F.array_join(F.when(F.col("_known").isNull(), rows).otherwise(kept), "\n").alias(text))

