"""Connected components of a graph given by its edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import checkpointed, parts_for


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours to the smallest of them: the larger neighbours, or else the smaller ones."""
    u, v = F.greatest("a", "b"), F.least("a", "b")
    both = edges.select(u.alias("u"), v.alias("v"))
    if large:
        both = both.union(edges.select(v.alias("u"), u.alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return out.where("a != b").distinct()


#: Edges in a partition of what is kept between rounds.
PER_PART = 200_000


def components(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(node, root) of each node in `edges` (a, b); root is the smallest node that can be reached. Edges of
    a node with itself are ignored. The first round is kept in at most `parts` partitions, the others in as many
    as their edges need."""
    before = None
    edges = edges.where("a != b").distinct()
    while True:
        edges = checkpointed(_star(_star(edges, large=True), large=False), parts)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, parts = now, parts_for(now[0], PER_PART, 1)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b")).distinct()
