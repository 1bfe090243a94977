"""A trie of conversations by their turns, with counts for every node (operator 11).

A node is a distinct sequence of first turns (role and text); its members are the conversations that begin with it. Turns
are known by SHA-256 digests, so that no text goes through a shuffle. Conversations alike in all turns are one sequence with
a count, whatever their number. Sequences are dealt by their first turn's digest into groups of about LIMIT turns, in
each of which applyInPandas builds tries of dictionaries and sums them up in an iterative postorder. A first turn with
more than LIMIT turns behind it is dealt anew by the next turn, and so on; the nodes above, a row each, are aggregates
and get their sums level by level on the way back. Each such level is one round, so that rounds grow with the depth to
which a prefix has more than LIMIT turns behind it, not with the input. The members that end at a node are joined into
pieces of at most PIECE ids in many tasks; a digest is a chain, so that the pieces of one node go through one task, one by one.

Turns are ordered by turn, null first, ties by the digests of role and text. Null roles and texts are empty. Rows without
a conversation are in none and are left out. Rows that repeat are turns like others. The digests of one conversation's
turns (32 bytes each) have to fit in a task. An empty table has no conversations and no nodes. Texts are read whole;
further columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import parts_for, small_batches, tidy, written

#: Turns of distinct sequences that a group may hold; ids in a piece of a node's ends.
LIMIT, PIECE = 4000, 8192
#: Words of a turn.
_WORDS = r"[^\x20\x09-\x0D]+"
_NO_ENDS = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"


def turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, seq): the turns of each conversation in order, as digests (d) and numbers of words (w)."""
    r, t = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t), 256))
    one = F.struct(F.col(turn).alias("turn"), digest.alias("d"), F.regexp_count(t, F.lit(_WORDS)).cast("long").alias("w"))
    each = df.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), one.alias("x"))
    return each.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("seq")).withColumn("seq", F.transform("seq", lambda x: F.struct(x["d"], x["w"])))


def rebuilt(convs: DataFrame, every: int = 20, modulus: int = 4) -> DataFrame:
    """convs of turns(), each with the first h turns taken from conversation conv_id - conv_id % every, as many as that
    has, and its own from the h-th on; h is the CRC-32 of the decimal conv_id modulo `modulus`."""
    heads = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_base"), F.slice("seq", 1, modulus - 1).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % modulus).cast("int")
    with_heads = convs.withColumn("_of", F.col("conv_id") - F.col("conv_id") % every).join(heads, F.col("_of") == F.col("_base"), "left")
    head = F.slice(F.coalesce("_head", F.filter("seq", lambda _: F.lit(False))), F.lit(1), h)
    own = F.slice("seq", h + 1, F.greatest(F.size("seq") - h, F.lit(0)))
    return with_heads.select("conv_id", F.concat(head, own).alias("seq"))


def _listed(seq: Column) -> Column:
    return F.array_join(F.transform(seq, lambda x: F.hex(x["d"])), "")


def ends(convs: DataFrame) -> DataFrame:
    """(sig, ends): of conversations alike (sig, conv_id) the digest of their ids, ascending, with commas between."""
    piece = F.floor(F.col("conv_id") / PIECE)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    pieces = convs.groupBy("sig", piece.alias("piece")).agg(ids.alias("ids"))

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, state, out = None, None, []
        for batch in batches:
            for s, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s == sig:
                    state.update(b"," + listed.encode())
                else:
                    if state:
                        out.append((sig, state.hexdigest()))
                    sig, state = s, hashlib.sha256(listed.encode())
            yield pa.RecordBatch.from_pydict({"sig": [x[0] for x in out], "ends": [x[1] for x in out]}, schema)
            out = []
        if state:
            yield pa.RecordBatch.from_pydict({"sig": [sig], "ends": [state.hexdigest()]}, schema)

    schema = pa.schema([("sig", pa.string()), ("ends", pa.string())])
    dealt = pieces.repartition("sig").sortWithinPartitions("sig", "piece")
    return dealt.select("sig", "ids").mapInArrow(tidy(chained), "sig string, ends string")


class _Node:
    __slots__ = ("children", "conv", "n", "words", "ends", "leaves", "saved")

    def __init__(self, words: int):
        self.children: dict[bytes, _Node] = {}
        self.conv, self.n, self.words, self.ends, self.leaves, self.saved = None, 0, words, _NO_ENDS, 0, 0

    def met(self, conv: int, n: int) -> None:
        self.conv, self.n = conv if self.conv is None else min(self.conv, conv), self.n + n


def _tries(group: pd.DataFrame) -> pd.DataFrame:
    """Nodes of the tries of a group's sequences, each trie known by the prefix `key` that its sequences share; all
    turns before the last of it are left out, and its top names the prefix above it."""
    tops: dict[bytes, _Node] = {}
    above = {}
    for key, up, conv, n, end, digests, words in zip(*(group[c] for c in ("key", "up", "conv_id", "n", "ends", "digests", "words")), strict=True):
        above[key] = up
        node = tops.get(key)
        if node is None:
            node = tops[key] = _Node(int(words[0]))
        node.met(conv, n)
        for d, w in zip(digests[1:], words[1:], strict=True):
            child = node.children.get(d)
            if child is None:
                child = node.children[d] = _Node(int(w))
            child.met(conv, n)
            node = child
        node.ends = end
    rows, depth = [], int(group["depth"].iloc[0]) if len(group) else 0
    for key, top in tops.items():
        way = [(top, None, depth, iter(top.children.values()))]
        while way:
            node, up, d, left = way[-1]
            child = next(left, None)
            if child is not None:
                way.append((child, node, d + 1, iter(child.children.values())))
                continue
            way.pop()
            node.leaves = node.leaves or 1  # no child has added any
            node.saved += (node.n - 1) * node.words
            if up is not None:
                up.leaves += node.leaves
                up.saved += node.saved
            rows.append((node.conv, d, None if up is None else up.conv, node.n, len(node.children), node.leaves, node.saved, node.ends, above[key] if up is None else None))
    names = [f.split()[0] for f in _NODE.split(", ")] + ["up"]
    return pd.DataFrame(rows, columns=names).astype({"parent_conv_id": "Int64"})


def trie(convs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row for each node of the trie of convs (conv_id, seq): conv_id (the smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves (childless nodes below, or itself), saved_tokens (words of the last turn for each
    member but one, over all nodes below and itself), ends_sha256 (of the members that end there). The result reads
    scratch."""
    small_batches(convs.sparkSession)
    known = written(convs.withColumn("sig", F.sha2(_listed(F.col("seq")), 256)), "trie-convs")
    alike = known.groupBy("sig").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.first("seq").alias("seq"))
    all_ = written(alike.join(ends(known.select("sig", "conv_id")), "sig"), "trie-sequences")
    start = {"key": F.lit(""), "up": F.lit(None).cast("string"), "depth": F.lit(0).cast("long")}
    waiting = all_.select("conv_id", "n", "ends", "seq", *[c.alias(k) for k, c in start.items()])
    large = waiting.where("true").select("key").distinct()  # the root is dealt anew in any case
    tops, tries, depth = [], [], 0
    while True:
        split = written(waiting.join(large, "key", "left_semi"), "trie-split")
        here = split.where(F.size("seq") == depth)
        words = F.when(F.lit(depth > 0), F.element_at("seq", max(depth, 1))["w"]).otherwise(F.lit(0)) if depth else F.lit(0)
        top = split.groupBy("key", "up").agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.first(words).alias("words"))
        top = top.join(here.select("key", "ends"), "key", "left")
        tops.append(written(top, "trie-tops"))
        depth += 1
        turn = F.element_at("seq", depth)
        key = F.sha2(F.concat("key", F.hex(turn["d"])), 256)
        waiting = split.where(F.size("seq") >= depth).select("conv_id", "n", "ends", "seq", key.alias("key"), F.col("key").alias("up"), F.lit(depth).cast("long").alias("depth"))
        waiting = written(waiting, "trie-waiting")
        behind = waiting.groupBy("key").agg(F.sum(F.size("seq") - (depth - 1)).alias("turns"))
        large = written(behind.where(F.col("turns") > limit).select("key"), "trie-large")
        fits = waiting.join(large, "key", "left_anti")
        size = fits.agg(F.sum(F.size("seq") - (depth - 1))).first()[0] or 0
        groups = parts_for(2 * size, limit, 1)  # half full, so that chance fills few of them
        rest = F.slice("seq", depth, F.size("seq"))
        parts = [rest.getField("d").alias("digests"), rest.getField("w").alias("words")]
        dealt = fits.select("key", "up", "depth", "conv_id", "n", "ends", *parts, F.pmod(F.xxhash64("key"), F.lit(groups)).alias("group"))
        tries.append(written(dealt.groupBy("group").applyInPandas(_tries, f"{_NODE}, up string"), "trie-nodes"))
        if large.isEmpty():
            break
    return _summed(tops, tries)


def _summed(tops: list[DataFrame], tries: list[DataFrame]) -> DataFrame:
    """All nodes: those of tries as they are but for the parents of their tops, and the nodes above with the sums of
    what is below, the deepest first."""
    out, below = [], None
    for depth in range(len(tops) - 1, -1, -1):
        roots = tries[depth].where("up is not null")  # of tries, right below this level
        out.append(tries[depth].where("up is null").drop("up"))
        kids = roots if below is None else roots.unionByName(below)
        sums = kids.groupBy("up").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        parents = tops[depth].select(F.col("key").alias("up"), F.col("conv_id").alias("_parent"))
        out.append(kids.join(parents, "up").withColumn("parent_conv_id", F.col("_parent")).drop("up", "_parent"))
        level = tops[depth].join(sums.withColumnRenamed("up", "key"), "key", "left")
        own = (F.col("n_convs") - 1) * F.col("words")
        below = written(level.select(
            "conv_id", F.lit(depth).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), (F.coalesce("saved_tokens", F.lit(0)) + own).alias("saved_tokens"), F.coalesce("ends", F.lit(_NO_ENDS)).alias("ends"), "up",
        ), "trie-level")
    whole = below.drop("up")
    for part in out:
        whole = whole.unionByName(part)
    return whole.withColumnRenamed("ends", "ends_sha256")
