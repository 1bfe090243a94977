import os

import pytest
from pyspark.sql import functions as F

from quire.sources import tables
from quire.sources.textfiles import read_files, write_files, write_pages


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_round_trip(spark, tmp_path):
    uri = (tmp_path / "pages").as_uri()
    pages = spark.createDataFrame([(i, f"# p {i}\r\né日😀\n") for i in range(1, 40)] + [(1000, None)], "n int, t string").repartition(5)
    write_pages(pages, "n", "t", uri)
    assert sorted(os.listdir(tmp_path / "pages"))[:2] == ["p001.md", "p002.md"]
    want = [(f"p{i:03d}.md", f"# p {i}\r\né日😀\n") for i in range(1, 40)] + [("p1000.md", "")]
    assert rows(read_files(spark, uri)) == sorted(want)
    assert rows(tables.page_files(spark, uri)) == [(i, f"# p {i}\r\né日😀\n") for i in range(1, 40)] + [(1000, "")]


def test_append_and_overwrite(spark, tmp_path):
    uri = str(tmp_path / "x")
    assert rows(read_files(spark, uri)) == []
    made = lambda *r: spark.createDataFrame(r, "name string, text string")
    write_files(made(("a.md", "1"), ("b.md", "2")), "name", "text", uri)
    (tmp_path / "x" / "note.txt").write_text("not ours")
    write_files(made(("b.md", "3"), ("c.md", "4")), "name", "text", uri)
    assert rows(read_files(spark, uri)) == [("a.md", "1"), ("b.md", "3"), ("c.md", "4")]
    write_files(made(("d.md", "5")), "name", "text", uri, overwrite=True)
    assert rows(read_files(spark, uri)) == [("d.md", "5")] and sorted(os.listdir(tmp_path / "x")) == ["d.md", "note.txt"]
    write_files(made(("log", "6")), "name", "text", uri, suffix="", overwrite=False)
    assert ("log", "6") in rows(read_files(spark, uri, ""))


@pytest.mark.parametrize("bad", ["twice", "failing task", "no name", "a path"])
def test_a_failed_job_leaves_nothing(spark, tmp_path, bad):
    uri = str(tmp_path / "x")
    write_files(spark.createDataFrame([("p.md", "old")], "name string, text string"), "name", "text", uri)
    df = spark.range(20).repartition(4).select(F.format_string("p%d.md", F.col("id")).alias("name"), F.lit("new").alias("text"), "id")
    if bad == "twice":
        df = df.unionByName(df.where("id = 7"))
    elif bad == "failing task":
        df = df.withColumn("text", F.when(F.col("id") == 19, F.raise_error(F.lit("stop"))).otherwise(F.col("text")))
    else:
        df = df.withColumn("name", F.when(F.col("id") == 3, F.lit(None if bad == "no name" else "../p.md")).otherwise(F.col("name")))
    with pytest.raises(Exception):  # noqa: B017  of whatever kind the job's failure is
        write_files(df.union(spark.createDataFrame([("p.md", "newer", 99)], df.schema)), "name", "text", uri)
    # a task that was still running when the job failed may leave something in the hidden folder, which nobody reads
    assert [f for f in os.listdir(tmp_path / "x") if not f.startswith(".aside-")] == ["p.md"] and rows(read_files(spark, uri)) == [("p.md", "old")]
