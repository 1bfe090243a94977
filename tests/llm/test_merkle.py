import hashlib

import pytest
from pyspark.sql import functions as F

from quire.llm import merkle
from quire.llm.shared import scratch_scope

FIELDS = ["doc_id", "source", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    shown = ["-" if v is None else str(v) for v in values]
    return h(*(s if v is None else f"{len(s.encode())}:{s}" for v, s in zip(values, shown, strict=True)))


def tree(nodes):
    """The root of a list of nodes and, for each, its siblings left and right at every level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, way in enumerate(ways):
            run = at[i] // 16 * 16
            way.append(("".join(nodes[run : at[i]]), "".join(nodes[at[i] + 1 : run + 16])))
            at[i] //= 16
        nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return (nodes or [None])[0], ways


def brute(rows, tampered):
    """Sorted (key, leaf, subroot, root, proof, folded, verified) from plain lists."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    trees = {s: tree([leaf(r) for r in g]) for s, g in groups.items()}
    root, upper = tree([trees[s][0] for s in sources])
    out = []
    for s, above in zip(sources, upper, strict=True):
        for r, way in zip(groups[s], trees[s][1], strict=True):
            way = way + above
            lower = None if r[2] is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[2])
            folded = leaf((*r[:2], lower)) if tampered(r[0]) else leaf(r)
            for x, y in way:
                folded = h(x, folded, y)
            out.append((r[0], leaf(r), trees[s][0], root, h(*(x + y for x, y in way)), folded, folded == root))
    return sorted(out, key=str)


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    with scratch_scope(spark):
        got = merkle.manifest(df, "doc_id", "source", FIELDS, F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False)), "text")
        return sorted((tuple(r) for r in got.collect()), key=str)


def third(key):
    return key is not None and key % 3 == 0


@pytest.mark.parametrize("sizes", [[1], [16, 17, 1], [256, 257], [4096, 5, 4097], [9000]])
def test_against_brute_force(spark, sizes):
    """Trees of one and several levels, and of one and several blocks."""
    rows = [(i, f"s{k}", f"Text {i}" if i % 7 else "no capitals") for k, n in enumerate(sizes) for i in range(n)]
    got = found(spark, rows)
    assert got == brute(rows, third)
    assert all(r[6] == (r[0] % 3 != 0 or r[0] % 7 == 0) for r in got)


def test_many_sources(spark):
    """The tree of subroots has levels of its own, and orders sources bytewise, null first."""
    rows = [(i, [None, "", "é", "z", "日", "Z"][i] if i < 6 else f"source {i}", "T") for i in range(300)]
    assert found(spark, rows) == brute(rows, third)


def test_odd_rows(spark):
    rows = [(None, None, None), (None, None, "A"), (3, None, None), (3, "", ""), (3, "", "B"), (3, "", "B"), (6, "x", "Aé日😀\n" * 20_000), (-3, "x", "C")]
    assert found(spark, rows) == brute(rows, third)
    assert found(spark, []) == []
