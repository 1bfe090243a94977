"""Scratch in the folder that driver and executors share, and who deletes it."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); one of our own only where none is set, as in tests."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = spark.conf.get("spark.quire.ownCheckpointDir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quire-checkpoint-")
        spark.conf.set("spark.quire.ownCheckpointDir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path if "://" in path or path.startswith("file:") else "file://" + path


#: The folder below the shared one that holds an application's scratch.
_ROOTS: dict[str, str] = {}
#: Scratch that the innermost scratch_scope() of this thread has to delete: paths, and the tables that stand there.
_OWNED: ContextVar[list[tuple[str, str]] | None] = ContextVar("owned", default=None)


def _root(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        root = make_dir(spark, f"{shared_dir(spark).rstrip('/')}/quire-{app}-{uuid.uuid4().hex[:12]}")
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)  # with the application
        _ROOTS[app] = root
    return _ROOTS[app]


def scratch(spark: SparkSession, what: str, table: str = "") -> str:
    """A new path below the shared folder, as a URI. It belongs to the innermost scratch_scope(), or else to the
    application, with whose driver it goes."""
    path = f"{_root(spark)}/{what}-{uuid.uuid4().hex[:12]}"
    if (owned := _OWNED.get()) is not None:
        owned.append((path, table))
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes in the end whatever scratch was made inside by this thread, and nothing else. A frame that reads such
    scratch must have been written by then."""
    owned: list[tuple[str, str]] = []
    token = _OWNED.set(owned)
    try:
        yield
    finally:
        _OWNED.reset(token)
        for path, name in owned:
            if name:
                spark.sql(f"DROP TABLE IF EXISTS `{name}`")
            delete(spark, path)


def written(df: DataFrame, what: str) -> DataFrame:
    """df, kept as scratch."""
    return settled(df.sparkSession, what, lambda: df)


def settled(spark: SparkSession, what: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What build() returns, kept as scratch of the caller's; the scratch that build() makes itself is deleted."""
    path = scratch(spark, what)
    with scratch_scope(spark):
        df = build()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def make_dir(spark: SparkSession, uri: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return uri


def delete(spark: SparkSession, uri: str) -> None:
    """Removes a scratch path of ours, in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
