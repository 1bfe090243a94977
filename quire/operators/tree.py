"""Headings to a tree: levels, parents, page ranges and what governs what, all by windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators.sizes import small
from quire.sources.scratch import written

# The repeated title of the document; kinds of headings and their levels, in order of precedence.
TITLE = r"(?iu)REDDITI\s+PERSONE\s+FISICHE.*ISTRUZIONI"
KINDS = (
    (r"(?iu)^\s*(?:\d+\.\s*)?QUADRO\s+[A-Z]{1,2}\b", "quadro", 1),
    (r"(?iu)^\s*SEZIONE\s+[IVX]+", "sezione", 2),
    (r"(?iu)\b(?:Rigo|Righi)\b.*\bR[A-Z]\d+", "rigo", 3),
    (r"(?iu)^\s*codic[ei]\b", "codice", 4),
)
LEVELS = 4
# How a heading and front matter are written, and what names a running header.
_HEADING = r"^#{1,6}\s+(.*\S)\s*$"
_FRONT = r"(?s)\A---\n.*?\n---\n"
_LETTER, _NUMERAL = r"(?iu)QUADRO\s+([A-Z]{1,2})", r"(?iu)SEZIONE\s+([IVX]+(?:\s+[A-Z])?)"


def heading_level(title: Column) -> Column:
    """The level of a structural heading, else null; 1 and 2 that end in a colon only lead into prose."""
    t = tx.stripped(title)
    level = reduce(lambda c, k: c.when(F.regexp_like(t, F.lit(k[0])), F.lit(k[2])), KINDS, F.when(F.regexp_like(t, F.lit(TITLE)), F.lit(None).cast("int")))
    return F.when((level <= 2) & F.endswith(t, F.lit(":")), F.lit(None)).otherwise(level)


def kind_of(level: Column) -> Column:
    return reduce(lambda c, k: c.when(level == k[2], F.lit(k[1])), KINDS[1:], F.when(level == KINDS[0][2], F.lit(KINDS[0][1])))


def page_lines(pages: DataFrame, doc: str, page: str, markdown: str) -> DataFrame:
    """(doc, page, at, row, heading, level): lines without front matter; heading is the title of heading lines."""
    each = pages.select(doc, page, F.posexplode(tx.lines(F.regexp_replace(F.coalesce(F.col(markdown), F.lit("")), _FRONT, ""))).alias("at", "row"))
    title = F.regexp_extract("row", _HEADING, 1)
    each = each.withColumn("heading", F.when(title != "", tx.stripped(title)))
    return each.withColumn("level", heading_level(F.col("heading")))


def headings(pages: DataFrame, doc: str, page: str, markdown: str) -> DataFrame:
    """(doc, page, at, title, level, kind) of structural headings."""
    found = page_lines(pages, doc, page, markdown).where("level is not null")
    return found.select(doc, page, "at", F.col("heading").alias("title"), "level", kind_of(F.col("level")).alias("kind"))


def dedup_key(kind: Column, title: Column) -> Column:
    """What makes a running header the same one; null for kinds that never repeat."""
    letter, numeral = F.regexp_extract(title, _LETTER, 1), F.regexp_extract(title, _NUMERAL, 1)
    of = lambda found: F.when(found != "", F.regexp_replace(F.upper(found), r"\s", "")).otherwise(F.lower(title))
    return F.when(kind == "quadro", F.concat(F.lit("quadro "), of(letter))).when(kind == "sezione", F.concat(F.lit("sezione "), of(numeral)))


def first_occurrences(rows: DataFrame, group: list[str], key: str, order: list[str]) -> DataFrame:
    """Of each key the first row by `order`, which tells a group's rows apart; rows without a key all stay, each as a key
    of its own. The condition is the window's alone, so that a task sends no more than its first row of a key."""
    own = F.when(F.col(key).isNull(), F.struct(*order))
    place = F.row_number().over(Window.partitionBy(*group, key, own).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str = "ord") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def ranged(rows: DataFrame, group: list[str], order: str, parts: int, name: str = "_r") -> DataFrame:
    """rows with the range of `order` that each lies in: `parts` ranges a group between its quantiles, which hold about
    as many rows each wherever the values lie; nulls are in range -1. The bounds are one aggregate, a row a group."""
    cuts = F.percentile_approx(order, F.array(*[F.lit(i / parts) for i in range(1, parts)]), max(10_000, 100 * parts))
    bounds = rows.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]).agg((cuts if parts > 1 else F.array().cast("array<double>")).alias("_cuts"))
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)])
    place = F.size(F.filter("_cuts", lambda c: c <= F.col(order)))
    placed = rows.join(small(bounds), same).withColumn(name, F.when(F.col(order).isNull(), -1).otherwise(place))
    return placed.drop("_cuts", *[f"_g{i}" for i in range(len(group))])


def with_ranges(rows: DataFrame, group: list[str], found: DataFrame) -> DataFrame:
    """rows of ranged() with what was found for each range (group, _r)."""
    other = found.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_r").alias("_range"), *[c for c in found.columns if c not in (*group, "_r")])
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)], F.col("_r") == F.col("_range"))
    return rows.join(small(other), same).drop("_range", *[f"_g{i}" for i in range(len(group))])


def numbered_in_ranges(rows: DataFrame, group: list[str], order: str, parts: int, name: str = "ord", ties: tuple[str, ...] = ()) -> DataFrame:
    """numbered() by one numeric column (then by `ties`), for groups too large for a task: each group is numbered range
    by range of `order`, and the counts of the ranges before, a row each, are added."""
    placed = ranged(rows, group, order, parts)
    counts = placed.groupBy(*group, "_r").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy(*group, "_r").orderBy(order, *ties))
    based = with_ranges(placed.withColumn("_place", place), group, counts.select(*group, "_r", earlier.alias("_base")))
    return based.withColumn(name, (F.col("_place") + F.col("_base")).cast("int")).drop("_r", "_place", "_base")


def kind_histogram(nodes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., kind, n)."""
    return nodes.groupBy(*(by or []), "kind").agg(F.count(F.lit(1)).alias("n"))


def lines(nodes: DataFrame) -> DataFrame:
    """nodes with `line`: kind, title and pages, indented by level."""
    indent = F.repeat(F.lit("  "), F.col("level") - 1)
    return nodes.withColumn("line", F.concat(indent, F.lit("- ["), "kind", F.lit("] "), "title", F.lit("  (p."), "page", F.lit("-"), "page_end", F.lit(")")))


def blocks(pages: DataFrame, group: list[str], page: str) -> DataFrame:
    """(group, page, block_start, block_end): runs of consecutive pages."""
    distinct = pages.select(*group, page).distinct()
    island = F.col(page) - F.row_number().over(Window.partitionBy(*group).orderBy(page))
    w = Window.partitionBy(*group, "_island")
    return distinct.withColumn("_island", island).select(*group, page, F.min(page).over(w).alias("block_start"), F.max(page).over(w).alias("block_end"))


def _joined_up(nodes: DataFrame, order: str, level: str, page: str, last: Column, later: str, parents: list[Column], nexts: list[Column]) -> DataFrame:
    """nodes with what links them, given by level the order of the last earlier node and the first page of a later one."""
    lv, pg = F.col(level), F.col(page)
    above = [F.when(lv > k, parents[k - 1]) for k in range(1, len(parents) + 1)]
    ahead = [F.when(lv >= k, nexts[k - 1]) for k in range(1, len(nexts) + 1)]
    none = F.lit(None)  # greatest and least take two columns at least
    out = nodes.withColumn("parent_ord", F.greatest(none, *above).cast(nodes.schema[order].dataType)).withColumn("_next", F.least(none, *ahead).cast(nodes.schema[page].dataType))
    end = F.when(F.col("_next").isNull(), last).when(F.col("_next") > pg, F.least(last, F.col("_next") - 1)).otherwise(pg)
    return out.withColumn("page_end", F.greatest(pg, end)).withColumn("serve_end", F.coalesce(later, "page_end")).drop("_next")


def linked(nodes: DataFrame, group: str, order: str, level: str, page: str, block_end: str | None = None, levels: int = LEVELS) -> DataFrame:
    """nodes with parent_ord (the nearest earlier node of a smaller level on the stack), page_end (before the next
    node of the same level or a smaller one) and serve_end (up to the next node that starts on a later page). Every
    window grows row by row, so that time is linear; a group must fit in a task, else take linked_in_ranges()."""
    w = Window.partitionBy(group)
    past = w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rest = w.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    above = w.orderBy(F.desc(page)).rangeBetween(Window.unboundedPreceding, -1)  # later pages
    lv, pg = F.col(level), F.col(page)
    parents = [F.max(F.when(lv == k, F.col(order))).over(past) for k in range(1, levels)]
    nexts = [F.min(F.when(lv == k, pg)).over(rest) for k in range(1, levels + 1)]
    last = F.col(block_end) if block_end else F.max(page).over(w)
    return _joined_up(nodes.withColumn("_later", F.min(page).over(above)), order, level, page, last, "_later", parents, nexts).drop("_later")


def linked_in_ranges(nodes: DataFrame, group: str, order: str, level: str, page: str, block_end: str | None = None, levels: int = LEVELS, parts: int = 64) -> DataFrame:
    """linked() for documents too large for a task. A run of headings is summed up by the last node and the first page
    of each level, and such sums combine: those of the ranges before and behind, a row a range, join each range's own
    windows. Later pages come from the distinct pages in the same way."""
    lv, pg = F.col(level), F.col(page)
    placed = ranged(nodes, [group], order, parts)
    ends = [F.max(F.when(lv == k, F.col(order))).alias(f"_last{k}") for k in range(1, levels)]
    starts = [F.min(F.when(lv == k, pg)).alias(f"_first{k}") for k in range(1, levels + 1)]
    sums = placed.groupBy(group, "_r").agg(*ends, *starts, F.max(page).alias("_most"))
    w = Window.partitionBy(group)  # a row a range
    before, behind = (w.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("_r"), F.desc("_r")))
    carried = [F.max(f"_last{k}").over(before).alias(f"_last{k}") for k in range(1, levels)] + [F.min(f"_first{k}").over(behind).alias(f"_first{k}") for k in range(1, levels + 1)]
    based = with_ranges(placed, [group], sums.select(group, "_r", *carried, F.max("_most").over(w).alias("_most")))
    own = Window.partitionBy(group, "_r")
    past, rest = (own.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col(order), F.desc(order)))
    parents = [F.coalesce(F.max(F.when(lv == k, F.col(order))).over(past), f"_last{k}") for k in range(1, levels)]
    nexts = [F.least(F.min(F.when(lv == k, pg)).over(rest), f"_first{k}") for k in range(1, levels + 1)]
    later = next_pages(nodes, group, page, parts).select(F.col(group).alias("_doc"), F.col(page).alias("_page"), "_later")
    found = based.join(later, F.col(group).eqNullSafe(F.col("_doc")) & F.col(page).eqNullSafe(F.col("_page")))
    last = F.col(block_end) if block_end else F.col("_most")
    out = _joined_up(found, order, level, page, last, "_later", parents, nexts)
    return out.select(*nodes.columns, "parent_ord", "page_end", "serve_end")


def next_pages(nodes: DataFrame, group: str, page: str, parts: int) -> DataFrame:
    """(group, page, _later): of each page that a node starts on, the next one of its group."""
    pages = ranged(nodes.select(group, page).distinct(), [group], page, parts)
    firsts = pages.groupBy(group, "_r").agg(F.min(page).alias("_first"))
    behind = Window.partitionBy(group).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)
    based = with_ranges(pages, [group], firsts.select(group, "_r", F.min("_first").over(behind).alias("_then")))
    return based.select(group, page, F.coalesce(F.lead(page).over(Window.partitionBy(group, "_r").orderBy(page)), "_then").alias("_later"))


def build(pages: DataFrame, doc: str, page: str, markdown: str) -> DataFrame:
    """The nodes of each document, from its markdown pages."""
    found = headings(pages, doc, page, markdown).withColumn("_key", dedup_key(F.col("kind"), F.col("title")))
    kept = numbered(first_occurrences(found, [doc], "_key", [page, "at"]).drop("_key"), [doc], [page, "at"])
    ends = blocks(pages, [doc], page).drop("block_start")
    return linked(kept.join(ends, [doc, page]), doc, "ord", "level", page, "block_end")


def ancestors(nodes: DataFrame, node: str, parent: str, levels: int = LEVELS, of: DataFrame | None = None) -> DataFrame:
    """(node, ancestor, distance) of all nodes, or of some: a join for each level of a tree of fixed depth."""
    edges = nodes.select(F.col(node).alias("_n"), F.col(parent).alias("_p"))
    step = (nodes if of is None else of).select(node, F.col(parent).alias("ancestor")).where(F.col(parent).isNotNull()).withColumn("distance", F.lit(1))
    out = step
    for d in range(2, levels):
        step = step.join(edges, F.col("ancestor") == F.col("_n")).where(F.col("_p").isNotNull()).select(node, F.col("_p").alias("ancestor"), F.lit(d).alias("distance"))
        out = out.unionByName(step)
    return out


def intervals(nodes: DataFrame, node: str, parent: str, order: str) -> DataFrame:
    """(node, root, depth, path, first, last) of trees of any depth: `first` numbers the nodes of a root's tree in
    preorder, brothers by `order` and node, and its subtree are those up to `last`; path holds a node's ancestors from the
    root on, and itself. Paths double in each round, so that a depth of d takes log2(d) rounds. A node whose parent is
    missing is a root; ValueError where parents run in a circle. The result reads scratch."""
    kind = nodes.schema[node].dataType.simpleString()
    step = F.struct(F.col(order).alias("o"), F.col(node).alias("n"))
    known = nodes.select(F.col(node).alias("_p"))
    at = nodes.select(F.col(node).alias("n"), F.col(parent).alias("_q"), F.array(step).alias("way")).join(known, F.col("_q") == F.col("_p"), "left")
    at = written(at.select("n", F.col("_p").alias("up"), "way"), "ways")
    while not at.where("up is not null").isEmpty():
        if not at.where(F.exists("way", lambda w: w["n"] == F.col("up"))).isEmpty():
            raise ValueError("parents run in a circle")
        above = at.select(F.col("n").alias("_n"), F.col("up").alias("_up"), F.col("way").alias("_way"))
        joined = at.join(above, F.col("up") == F.col("_n"), "left")
        at = written(joined.select("n", F.col("_up").alias("up"), F.when(F.col("_n").isNull(), F.col("way")).otherwise(F.concat("_way", "way")).alias("way")), "ways")
    placed = at.select(F.col("n").alias(node), F.col("way")[0]["n"].alias("root"), F.size("way").alias("depth"), F.transform("way", lambda w: w["n"]).cast(f"array<{kind}>").alias("path"), "way")
    numbered_ = placed.withColumn("first", F.row_number().over(Window.partitionBy("root").orderBy("way"))).drop("way")
    sizes = placed.select(F.explode("path").alias("_n")).groupBy("_n").agg(F.count(F.lit(1)).alias("_size"))
    return numbered_.join(sizes, F.col(node) == F.col("_n")).withColumn("last", (F.col("first") + F.col("_size") - 1).cast("int")).drop("_n", "_size")


def below(found: DataFrame, wanted: DataFrame, node: str) -> DataFrame:
    """(top, node, distance): the subtrees of some nodes (wanted), of intervals(): a range of each tree."""
    tops = found.join(wanted.select(node).distinct(), node, "left_semi")
    tops = tops.select(F.col(node).alias("top"), F.col("root").alias("_root"), F.col("first").alias("_first"), F.col("last").alias("_last"), F.col("depth").alias("_depth"))
    inside = (F.col("root") == F.col("_root")) & F.col("first").between(F.col("_first"), F.col("_last"))
    return found.join(small(tops), inside).select("top", node, (F.col("depth") - F.col("_depth")).alias("distance"))


def children(nodes: DataFrame, node: str, parent: str, order: str, title: str) -> DataFrame:
    """(parent, n, titles) in order."""
    listed = F.array_sort(F.collect_list(F.struct(order, node, title)))
    return nodes.where(F.col(parent).isNotNull()).groupBy(parent).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(listed, lambda x: x[title]), ",").alias("titles"))


def range_text(nodes: DataFrame, pages: DataFrame, node: str, group: str, start: str, end: str, page: str, text: str) -> DataFrame:
    """(group, node, text): the pages of each node's range in order, joined by equality of page numbers."""
    wanted = nodes.select(group, node, F.explode(F.sequence(start, end)).alias(page))
    ordered = F.array_sort(F.collect_list(F.struct(page, text)))
    return wanted.join(pages.select(group, page, text), [group, page]).groupBy(group, node).agg(F.array_join(F.transform(ordered, lambda x: x[text]), "\n").alias(text))


def preambles(nodes: DataFrame, pages: DataFrame, doc: str, page: str, markdown: str, limit: int = 4000) -> DataFrame:
    """(doc, ord, text) of nodes with children: what stands behind a node's heading up to the next structural
    one, at most `limit` characters (a governing passage is short by design)."""
    branches = nodes.join(nodes.select(doc, F.col("parent_ord").alias("ord")).distinct(), [doc, "ord"], "left_semi")
    rows = page_lines(pages, doc, page, markdown).select(doc, F.col(page).alias("_p"), F.col("at").alias("_at"), "row", "heading", F.col("level").alias("_level"))
    spanned = branches.select(doc, "ord", "title", F.col(page).alias("_from"), "at", F.explode(F.sequence(page, "page_end")).alias("_p"))
    inside = spanned.join(rows, [doc, "_p"]).where(F.struct("_p", "_at") > F.struct("_from", "at"))
    w = Window.partitionBy(doc, "ord").orderBy("_p", "_at").rowsBetween(Window.unboundedPreceding, 0)
    open_ = inside.withColumn("_stops", F.count("_level").over(w)).where("_stops = 0")
    listed = F.array_sort(F.collect_list(F.struct("_p", "_at", F.coalesce("heading", "row").alias("t"))))
    text = F.substring(tx.stripped(tx.dehyphenated(F.array_join(F.transform(listed, lambda x: x["t"]), "\n"))), 1, limit)
    return open_.groupBy(doc, "ord").agg(text.alias("text")).where("text != ''")


def collected_pins(nodes: DataFrame, pins: DataFrame, doc: str) -> DataFrame:
    """(doc, ord, pins): the passages of a node's ancestors, root first."""
    up = nodes.select(doc, F.struct(doc, "ord").alias("_id"), F.when(F.col("parent_ord").isNotNull(), F.struct(F.col(doc), F.col("parent_ord").alias("ord"))).alias("_up"))
    chain = ancestors(up, "_id", "_up").select(F.col("_id.ord").alias("ord"), F.col(f"ancestor.{doc}").alias(doc), F.col("ancestor.ord").alias("_a"), "distance")
    found = chain.join(pins.select(doc, F.col("ord").alias("_a"), "text"), [doc, "_a"])
    listed = F.reverse(F.array_sort(F.collect_list(F.struct("distance", "text"))))
    return found.groupBy(doc, "ord").agg(F.transform(listed, lambda x: x["text"]).alias("pins"))
