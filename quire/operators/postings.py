"""Postings in blocks, which are read only as far as the best nodes need them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.scratch import written

#: Less than a score is rounded by: bounds may miss sums by so much.
SLACK = 1e-3


def blocked(index: DataFrame, blocks: int) -> DataFrame:
    """(term, block, most, postings) of an index (term, node_id, weight): nodes are dealt to `blocks` blocks, the same
    for every term, so that the largest weights of a question's terms in a block bound what a node there can score."""
    block = F.pmod(F.xxhash64("node_id"), F.lit(blocks)).cast("int")
    listed = F.collect_list(F.struct("node_id", "weight"))  # at most the nodes of a block
    return index.groupBy("term", block.alias("block")).agg(F.max("weight").alias("most"), listed.alias("postings"))


def _scored(asked: DataFrame, query: str, postings: DataFrame, chosen: DataFrame) -> DataFrame:
    """(query, node_id, block, score) of the nodes in the chosen (query, block)."""
    hits = asked.join(postings.select("term", "block", "postings"), "term").join(chosen.select(query, "block"), [query, "block"], "left_semi")
    each = hits.select(query, "block", F.explode("postings").alias("p"))
    return each.groupBy(query, "block", F.col("p.node_id").alias("node_id")).agg(F.round(F.sum("p.weight"), 4).alias("score"))


def best(asked: DataFrame, query: str, postings: DataFrame, k: int = 8, lead: int = 2) -> tuple[DataFrame, DataFrame]:
    """(query, node_id, score, place): the k best nodes of each question (query, term), the same as of index.match() on
    all postings; and (query, blocks, read): of how many blocks with any of its terms, how many were opened.

    Bounds come from the blocks' largest weights alone. The `lead` k blocks of the highest bounds are scored first; the
    k-th best score there is a floor under which no block's bound needs a look. Blocks that reach it are scored too,
    each task keeps k nodes of a block's question, and these few are merged. Both frames read scratch."""
    asked = asked.distinct()
    bounds = asked.join(postings.select("term", "block", "most"), "term").groupBy(query, "block").agg(F.sum("most").alias("bound"))
    bounds = written(bounds, "bounds")
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("bound"), "block"))
    first = written(bounds.withColumn("_p", place).where(F.col("_p") <= lead * k).drop("_p"), "bounds-first")
    order = Window.partitionBy(query).orderBy(F.desc("score"), "node_id")
    seen = written(_scored(asked, query, postings, first).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place"), "scores-first")
    floor = seen.groupBy(query).agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_floor")).where(F.col("_n") >= k)
    open_ = bounds.join(first, [query, "block"], "left_anti").join(floor, query, "left")
    rest = written(open_.where(F.col("_floor").isNull() | (F.col("bound") + SLACK >= F.col("_floor"))).select(query, "block"), "bounds-rest")
    more = _scored(asked, query, postings, rest)
    shard = Window.partitionBy(query, "block").orderBy(F.desc("score"), "node_id")
    more = more.withColumn("_s", F.row_number().over(shard)).where(F.col("_s") <= k).drop("_s")
    found = seen.unionByName(more).drop("block").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    opened = first.select(query, "block").unionByName(rest).groupBy(query).agg(F.count(F.lit(1)).alias("read"))
    report = bounds.groupBy(query).agg(F.count(F.lit(1)).alias("blocks")).join(opened, query)
    return found, report
