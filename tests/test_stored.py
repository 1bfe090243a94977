import os
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import index, tree
from quire.operators.stored import StoredTable

SCHEMA = "doc string, n int, t string"


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def files(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_stored_table(spark, tmp_path):
    stored = StoredTable(spark, str(tmp_path / "t"), SCHEMA, ["doc", "n"], buckets=8)
    made = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    assert stored.read().count() == 0
    want = {(f"d{i % 3}" if i % 7 else None, i): f"t{i}" for i in range(60)}
    stored.insert(made(*[(*k, v) for k, v in want.items()]))
    all_ = lambda: sorted([(*k, v) for k, v in want.items()], key=str)
    assert rows(stored.read()) == all_()
    with pytest.raises(ValueError, match="already"):
        stored.insert(made(("new", 1, "x"), (None, 7, "y")))
    with pytest.raises(ValueError, match="twice"):
        stored.insert(made(("new", 1, "x"), ("new", 1, "y")))
    assert rows(stored.read()) == all_()
    before = files(tmp_path / "t")
    merged = stored.upsert(made((None, 7, "changed"), ("new", 1, None)))
    want |= {(None, 7): "changed", ("new", 1): None}
    assert rows(stored.read()) == all_()
    after = files(tmp_path / "t")
    kept = [f for f in before if after.get(f) == before[f]]
    assert len({os.path.dirname(f) for f in before}) == 8 and len({os.path.dirname(f) for f in kept}) >= 6
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan  # what is stored stays where it is
    stored.update(spark.createDataFrame([("d1", 1, "set"), ("nobody", 5, "x")], SCHEMA), ["t"])
    want[("d1", 1)] = "set"
    assert rows(stored.read()) == all_()


def test_a_failed_change_changes_nothing(spark, tmp_path):
    stored = StoredTable(spark, str(tmp_path / "t"), SCHEMA, ["n"], buckets=4)
    stored.insert(spark.range(20).select(F.lit("d").alias("doc"), F.col("id").cast("int").alias("n"), F.lit("old").alias("t")))
    before = rows(stored.read())
    bad = spark.range(20).select(F.lit("d").alias("doc"), F.col("id").cast("int").alias("n"), F.when(F.col("id") == 19, F.raise_error(F.lit("stop"))).otherwise(F.lit("new")).alias("t"))
    for change in (stored.upsert, stored.insert, lambda df: stored.update(df, ["t"])):
        with pytest.raises(Exception, match="stop"):
            change(bad)
        assert rows(stored.read()) == before


def test_intervals_of_deep_trees(spark):
    r, parents = random.Random(1), {}
    for i in range(1, 300):
        parents[i] = None if i in (1, 2, 3) else i - 1 if i < 60 else r.randrange(max(1, i - 30), i)
    parents[500] = 999  # its parent is missing
    df = spark.createDataFrame([(i, p, -i % 7) for i, p in parents.items()], "id int, up int, ord int")
    got = {x.id: x for x in tree.intervals(df, "id", "up", "ord").collect()}

    def path(i):
        p = parents.get(i)
        return [*(path(p) if p in parents else []), i]

    def preorder(i, out):
        out.append(i)
        for k in sorted((k for k, p in parents.items() if p == i), key=lambda k: (-k % 7, k)):
            preorder(k, out)
        return out

    assert got.keys() == parents.keys() and max(x.depth for x in got.values()) > 40
    for root in (i for i in parents if parents[i] not in parents):
        order = preorder(root, [])
        for at, i in enumerate(order, 1):
            below = [k for k in parents if i in path(k)]
            assert (got[i].path, got[i].root, got[i].first, got[i].last) == (path(i), root, at, at + len(below) - 1)
    found = tree.below(tree.intervals(df, "id", "up", "ord"), spark.createDataFrame([(40,), (500,)], "id int"), "id")
    assert rows(found) == sorted([(t, k, len(path(k)) - len(path(t))) for t in (40, 500) for k in parents if t in path(k)], key=str)
    assert tree.intervals(df.limit(0), "id", "up", "ord").count() == 0
    with pytest.raises(ValueError, match="circle"):
        tree.intervals(spark.createDataFrame([(1, 2, 0), (2, 1, 0), (3, None, 0)], "id int, up int, ord int"), "id", "up", "ord")


def test_many_markers(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randint(1, 12)))
    markers = sorted({word() for _ in range(20_000)} | {"zz", "x" * 50})
    texts = [(i, "".join(r.choice("abcdeé  ") for _ in range(150))) for i in range(60)] + [(100, None), (101, ""), (102, "x" * 60)]
    df, ms = spark.createDataFrame(texts, "k int, t string"), spark.createDataFrame([(m,) for m in markers] + [("",), (None,)], "m string")
    got = index.contained(df, "k", "t", ms, "m")
    assert rows(got) == sorted(((k, m) for k, t in texts if t for m in markers if m in t), key=str)
    few = index.contained(df, "k", "t", ms.limit(3), "m")
    size = lambda d: len(d._jdf.queryExecution().analyzed().toString().split("\n"))
    assert abs(size(got) - size(few)) <= 2  # the plan doesn't grow with the list


def test_only_windows_of_markers_leave_texts(spark):
    """Windows do not cross texts, end with them, and are found over the seams of what is looked at together."""
    import pyarrow as pa
    from quire.operators import windows

    texts = ["licen", "ses of mit", "", None, "né\0qz", "q", "z" * 9, "mit license"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string").coalesce(1)
    marks = ["licenses", "license", "é", "\0q", "qz", "zzzzzzzzz", "zzzzzzzzzz", "mit license", "of mit", "q", ""]
    ms = spark.createDataFrame([(m,) for m in marks], "m string")
    assert rows(index.contained(df, "k", "t", ms, "m")) == sorted(((i, m) for i, t in enumerate(texts) if t for m in marks if m and m in t), key=str)
    assert index.contained(df, "k", "t", ms.limit(0), "m").count() == 0 == index.contained(df.limit(0), "k", "t", ms, "m").count()
    long = spark.createDataFrame([(0, " ".join(str(i) for i in range(50_000)))], "k int, t string")
    runs = windows.of_markers(spark.createDataFrame([("40000 40001",)], "m string"), "m", 8)
    assert runs.count() == 4 and 4 <= windows.in_texts(long, "k", "t", runs).count() < 400
    whole = windows.PIECE
    try:
        windows.PIECE = 3
        got = {(int(r), int(g).to_bytes(8, "little")[:2]) for a, b in windows._found(pa.array(texts[:6])[1:], 2) for r, g in zip(a, b)}
    finally:
        windows.PIECE = whole
    assert got == {(i, b[j : j + 2]) for i, t in enumerate(texts[1:6]) for b in [(t or "").encode()] for j in range(len(b) - 1)}


def test_aliases_as_a_table(spark):
    aliases = {"dentista": ["spese mediche", "cure"], "màre": ["casa al mare"], "zzz": [], "ab": ["corto"]}
    asked = spark.createDataFrame([(1, "Il DENTISTA costa"), (2, "case al Mare, lab"), (3, None), (4, "nulla")], "q int, t string")
    known = spark.createDataFrame(list(aliases.items()), "alias string, expansions array<string>")
    assert rows(index.asked_terms_by(asked, "q", "t", known)) == rows(index.asked_terms(asked, "q", "t", aliases).distinct())
