"""Scratch stands in the shared folder alone and belongs to who made it."""

import os

import pytest

import corpus_pipeline
from quire.llm import queries, suffixdedup
from quire.llm.shared import scratch, scratch_scope, settled, shared_dir
from tests.llm.conftest import prose

SF = "/root/testdata/sf0.001"


def below(path):
    """Files and folders of scratch, without Spark's checkpoints, which the context cleans."""
    return {os.path.join(d, n) for d, dirs, names in os.walk(path) for n in [*dirs, *names] if "/quire-" in os.path.join(d, n)}


def files(path):
    return {os.path.join(d, n) for d, _, names in os.walk(path) for n in names}


def test_scopes(spark):
    root = shared_dir(spark).removeprefix("file://")
    with scratch_scope(spark):
        outer = scratch(spark, "outer")
        spark.range(3).write.parquet(outer)
        kept = settled(spark, "kept", lambda: spark.range(5))
        with scratch_scope(spark):
            spark.range(3).write.parquet(scratch(spark, "inner"))
            assert any("inner-" in p for p in below(root))
        assert not any("inner-" in p for p in below(root))
        assert spark.read.parquet(outer).count() == 3 and kept.count() == 5
    assert not any("outer-" in p or "kept-" in p for p in below(root))


def test_results_live_side_by_side(spark):
    docs = spark.createDataFrame([(i, prose(i % 3, 200)) for i in range(9)], "doc_id long, text string")
    with scratch_scope(spark):
        one = suffixdedup.dedup(docs, "text", ["doc_id"])
        with scratch_scope(spark):
            other = suffixdedup.dedup(docs.where("doc_id < 5"), "text", ["doc_id"])
            assert other.count() == 5
        assert one.count() == 9 and not one.where("n_removed = 0").count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", ["op3_near_duplicates", "op7_suffix_dedup", "op8_toxicity", "op12_merkle", "pipeline"])
def test_nothing_stays_nor_leaves_the_shared_folder(spark, name):
    root = shared_dir(spark).removeprefix("file://")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")
    here, stored, before = files(os.getcwd()), files(warehouse), below(root)
    with scratch_scope(spark):
        query = corpus_pipeline.run if name == "pipeline" else queries.queries()[name]
        assert query(spark, SF).count() > 0
    assert below(root) == before and files(warehouse) == stored
    assert not {f for f in files(os.getcwd()) - here if "__pycache__" not in f and ".pytest_cache" not in f and ".hypothesis" not in f}
