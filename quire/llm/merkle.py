"""A Merkle manifest of a table: a digest of every row, trees of them by source, a tree of these, and a proof for
each row (operator 12).

H is the lowercase hex SHA-256 of its inputs one after another, digests as hex text. A leaf is H of the row's fields,
each `-` if null, else its length in UTF-8 bytes, a colon, and the value. In a tree, while several nodes remain, every
FAN consecutive ones become their H; the last run may be shorter, even one node. The leaves of a source ascend by key;
its tree leaves a subroot, and the tree of the subroots in order of sources (null first, then bytewise) the root. A
proof is H of the siblings of a leaf's ancestors, level by level up to the root, from left to right.

The work is done in blocks of FAN ** INNER consecutive nodes of a tree, which are subtrees. The rows, digests only, are
written sorted by source and key and numbered range by range, so that no source is sorted in one task. Executors run the
levels of their blocks as DuckDB queries on Arrow tables (ordered string_agg, sha256), several blocks at a time; the roots
of the blocks are a tree of the same kind, FAN ** INNER times smaller, and so on up. On the way down each block is joined
with the proof of its root, and gives those of its nodes.

A null key comes first and is never tampered with; a null source is a source of its own. Rows that repeat a key ascend by
their leaves; rows that are alike in all fields are leaves like others, of which any may have either proof. An empty
table gives no rows. Texts of any length are digested whole. Further columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import parts_for, small_batches, tidy, written

FAN, INNER = 16, 3
BLOCK = FAN**INNER
#: Rows that a task has DuckDB work on at once; rows of a range or of a shuffle partition.
AT_ONCE, PER_PART = 2 * BLOCK, 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(fields: list[Column]) -> Column:
    def written(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(written, fields)), 256)


def lowered(text: Column) -> Column:
    """The tampering: A-Z in lower case."""
    return F.translate(text, _UPPER, _LOWER)


# -- numbering ------------------------------------------------------------------------------------------------------


def numbered(nodes: DataFrame, order: list[str], rows: int) -> DataFrame:
    """nodes (g and others) with pos, the place in the group g by `order`, and n, the group's size. Ranges of
    (g, order) are numbered apart, and the sizes of a group's earlier ranges added."""
    ranged = nodes.repartitionByRange(parts_for(rows, PER_PART, 12), "g", *order).sortWithinPartitions("g", *order)
    at = F.monotonically_increasing_id()
    placed = written(ranged.withColumn("part", F.shiftright(at, 33).cast("int")).withColumn("at", at.bitwiseAND(F.lit((1 << 33) - 1))), "merkle-sorted")
    runs = placed.groupBy("g", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    w = Window.partitionBy("g")  # a row for each range that the group reaches into
    before = F.coalesce(F.sum("rows").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("g").alias("_g"), F.col("part").alias("_part"), (before - F.col("first")).alias("_add"), F.sum("rows").over(w).alias("n"))
    same = F.col("g").eqNullSafe(F.col("_g")) & (F.col("part") == F.col("_part"))
    return placed.join(runs, same).withColumn("pos", F.col("at") + F.col("_add")).drop("_g", "_part", "_add", "part", "at")


def blocked(nodes: DataFrame, rows: int) -> DataFrame:
    """Nodes dealt by blocks, each as a run of one partition."""
    return nodes.repartition(parts_for(rows, PER_PART, 12), "g", "block").sortWithinPartitions("g", "block", "pos")


# -- blocks in DuckDB -----------------------------------------------------------------------------------------------


def _engine() -> duckdb.DuckDBPyConnection:
    return duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole blocks, about AT_ONCE rows together, each numbered within the table by `b`."""

    def cut(table: pa.Table, last: bool) -> tuple[pa.Table | None, pa.Table]:
        pos = table["pos"].to_numpy()
        g, block = table["g"].combine_chunks(), table["block"].to_numpy()
        new = block[1:] != block[:-1]
        codes = g.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new |= codes[1:] != codes[:-1]
        begins = new.nonzero()[0] + 1
        end = table.num_rows if last else int(begins[-1]) if len(begins) else 0
        if not end:
            return None, table
        b = new.cumsum()
        whole = table.slice(0, end).append_column("b", pa.array([0, *b[: end - 1]], pa.int64()))
        return whole.append_column("p", pa.array(pos[:end] % BLOCK, pa.int64())), table.slice(end)

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= AT_ONCE:
            whole, rest = cut(pa.Table.from_batches(held), last=False)
            held, size = rest.to_batches(), rest.num_rows
            if whole:
                yield whole
    if size:
        yield cut(pa.Table.from_batches(held), last=True)[0]


def _levels(con: duckdb.DuckDBPyConnection, nodes: pa.Table) -> None:
    """Tables level0 (b, p, n, h), level1 and so on: nodes of a level, as far as a block has that level. A block of
    a tree with one block only ends where one node remains; others have all INNER levels."""
    con.register("nodes", nodes)
    con.execute("CREATE OR REPLACE TABLE level0 AS SELECT b, p, n, h FROM nodes")
    for k in range(INNER):
        con.execute(f"""
            CREATE OR REPLACE TABLE level{k + 1} AS
            SELECT b, p // {FAN} AS p, n, sha256(string_agg(h, '' ORDER BY p)) AS h FROM level{k}
            WHERE n > {FAN**k} GROUP BY b, p // {FAN}, n""")


def _top() -> str:
    """(b, h) of the roots of the blocks."""
    parts = [f"SELECT b, h FROM level{k} WHERE n > {FAN ** (k - 1) if k else 0}" + (f" AND n <= {FAN**k}" if k < INNER else "") for k in range(INNER + 1)]
    return " UNION ALL ".join(parts)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = _engine()
    for nodes in _blocks(batches):
        _levels(con, nodes)
        found = con.sql(f"SELECT any_value(g) AS g, any_value(block) AS pos, any_value(t.h) AS h FROM nodes JOIN ({_top()}) t USING (b) GROUP BY b")
        yield from found.to_arrow_table().to_batches()


def _proofs(last: bool) -> Callable:
    """Nodes, and for each block a row without place that holds what is outside of it (above, folds), to nodes with
    their whole way up: siblings and folds (what stands left and right at each level); or at last the digest of the
    siblings, and the root that an altered leaf gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _engine()
        for rows in _blocks(batches):
            outside = pc.less(rows["pos"], 0)
            con.register("outside", rows.filter(outside).select(["b", "above", "folds"]))
            _levels(con, rows.filter(pc.invert(outside)))
            # from the top of each block down: the siblings of a node's ancestors and its own
            con.execute(f"CREATE OR REPLACE TABLE way AS SELECT b, p, above, folds FROM level{INNER} JOIN outside USING (b)")
            for k in range(INNER - 1, -1, -1):
                con.execute(f"""
                    CREATE OR REPLACE TABLE way AS
                    WITH runs AS (SELECT b, p // {FAN} AS up, list(h ORDER BY p) AS hs FROM level{k} WHERE n > {FAN**k} GROUP BY b, p // {FAN}),
                    sides AS (
                      SELECT l.b, l.p, above, folds, array_to_string(hs[1:l.p % {FAN}], '') AS x, array_to_string(hs[l.p % {FAN} + 2:], '') AS y
                      FROM level{k} l JOIN runs r ON r.b = l.b AND r.up = l.p // {FAN} JOIN way w ON w.b = l.b AND w.p = l.p // {FAN})
                    SELECT b, p, x || y || above AS above, list_prepend({{'x': x, 'y': y}}, folds) AS folds FROM sides
                    UNION ALL SELECT b, p, above, folds FROM level{k} JOIN outside USING (b) WHERE n <= {FAN**k} AND n > {FAN ** (k - 1) if k else 0}""")
            if not last:
                out = "SELECT g, pos, h, way.above, way.folds FROM nodes JOIN way USING (b, p)"
            else:  # a fold a level: the altered leaf between its siblings, then what that gives between its own
                out = """SELECT g, h, id, sha256(way.above) AS proof,
                         list_reduce(list_prepend(coalesce(altered, h), list_transform(way.folds, lambda f: f.x || '|' || f.y)),
                                     lambda a, f: sha256(split_part(f, '|', 1) || a || split_part(f, '|', 2))) AS folded
                         FROM nodes JOIN way USING (b, p)"""
            yield from con.sql(out).to_arrow_table().to_batches()

    return run


# -- trees ----------------------------------------------------------------------------------------------------------

_FOLDS = "array<struct<x: string, y: string>>"


class Tree:
    """Trees of nodes (g, pos, h, n), a tree a group, built floor by floor of blocks."""

    def __init__(self, nodes: DataFrame, kind: str, rows: int):
        self.kind, self.floors = kind, [nodes]
        most = nodes.agg(F.max("n")).first()[0] or 0
        while len(self.floors) == 1 or most > 1:
            low = self.floors[-1].select("g", "pos", "h", "n", F.floor(F.col("pos") / BLOCK).cast("long").alias("block"))
            roots = written(blocked(low, rows).mapInArrow(tidy(_roots), f"g {kind}, pos long, h string"), "merkle-roots")
            n = roots.groupBy(F.col("g").alias("_g")).agg((F.max("pos") + 1).alias("n"))
            self.floors.append(roots.join(n, F.col("g").eqNullSafe(F.col("_g"))).drop("_g"))
            rows, most = -(-rows // BLOCK), -(-most // BLOCK)

    def roots(self) -> DataFrame:
        """(g, h): the one node that is left of each tree."""
        return self.floors[-1].select("g", "h")

    def below(self, above: DataFrame, rows: int, last: str = "") -> DataFrame:
        """The nodes of the lowest floor with their ways up, given (g, above, folds) of each root; or their proofs,
        whose columns are then `last`."""
        outer = above.withColumn("pos", F.lit(0).cast("long"))
        for k in range(len(self.floors) - 2, -1, -1):
            outside = outer.select("g", F.lit(-1).cast("long").alias("pos"), F.col("pos").alias("block"), "above", "folds")
            nodes = self.floors[k].withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long"))
            dealt = blocked(nodes.unionByName(outside, allowMissingColumns=True), rows if k == 0 else rows // BLOCK)
            if k == 0 and last:
                return dealt.mapInArrow(tidy(_proofs(True)), last)
            outer = written(dealt.mapInArrow(tidy(_proofs(False)), f"g {self.kind}, pos long, h string, above string, folds {_FOLDS}"), "merkle-ways").drop("h")
        return outer


def manifest(df: DataFrame, key: str, source: str, fields: list[str], tampered: Column, altered: str) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of df. The leaf is of `fields` in
    order; where `tampered` holds, folded_root is what the row's siblings make of its leaf after lowered() was applied
    to the column `altered`, else of the leaf itself; verified tells whether that is the root. The result reads scratch."""
    small_batches(df.sparkSession)
    kind, key_kind = df.schema[source].dataType.simpleString(), df.schema[key].dataType.simpleString()
    other = leaf([lowered(F.col(f)) if f == altered else F.col(f) for f in fields])
    leaves = written(df.select(F.col(source).alias("g"), F.col(key).alias("id"), leaf([F.col(f) for f in fields]).alias("h"), F.when(tampered, other).alias("altered")), "merkle-leaves")
    rows = leaves.count()
    # rows that are alike in all fields may have either place, so that numbers of their own spread them over ranges
    nodes = numbered(leaves.withColumn("copy", F.monotonically_increasing_id()), ["id", "h", "copy"], rows).drop("copy")
    trees = Tree(nodes, kind, rows)
    subroots = trees.roots()
    sources = subroots.count()
    placed = numbered(subroots.select(F.lit(0).alias("g"), F.col("g").alias("source"), "h"), ["source"], sources)
    upper = Tree(placed.select("g", "pos", "h", "n"), "int", sources)
    root = upper.roots()  # one row
    ways = upper.below(root.select("g", F.lit("").alias("above"), F.array().cast(_FOLDS).alias("folds")), sources)
    ways = placed.select(F.col("source").alias("g"), "pos").join(ways.drop("g"), "pos").select("g", "above", "folds")
    found = trees.below(ways, rows, f"g {kind}, h string, id {key_kind}, proof string, folded string")
    tops = subroots.select(F.col("g").alias("_g"), F.col("h").alias("subroot")).crossJoin(F.broadcast(root.select(F.col("h").alias("root"))))
    joined = found.join(tops, F.col("g").eqNullSafe(F.col("_g")))
    return joined.select(
        F.col("id").alias(key), F.col("h").alias("leaf"), "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )
