"""Text files, one a row, as a data source: page markdown, question logs and the like.

`spark.read.format("textfiles").load(uri)` gives (name, text); writing takes the same two columns. Files are written
aside by the tasks, and moved to their places when the whole job has succeeded: a job that fails or is stopped leaves
what was there before (and, where a task went on after that, files in a hidden folder that no reader looks into). Appending replaces files of the same names; overwriting removes all others of that suffix. URIs are
those of any store that executors reach.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Files that a task reads.
PER_TASK = 1000


def _store(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def _names(uri: str, suffix: str) -> list[str]:
    from pyarrow.fs import FileSelector

    store, root = _store(uri)
    found = store.get_file_info(FileSelector(root, allow_not_found=True))
    return sorted(f.base_name for f in found if f.is_file and f.base_name.endswith(suffix) and not f.base_name.startswith((".", "_")))


@dataclass
class _Files(InputPartition):
    names: list[str]


class _Reader(DataSourceReader):
    def __init__(self, uri: str, suffix: str):
        self.uri, self.suffix = uri, suffix

    def partitions(self) -> list[InputPartition]:
        names = _names(self.uri, self.suffix)
        return [_Files(names[i : i + PER_TASK]) for i in range(0, len(names), PER_TASK)] or [_Files([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        store, root = _store(self.uri)
        for name in partition.names:
            with store.open_input_stream(f"{root}/{name}") as f:
                yield name, f.read().decode()


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    names: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, uri: str, suffix: str, overwrite: bool):
        self.uri, self.suffix, self.overwrite = uri, suffix, overwrite
        self.aside = f".aside-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        store, root = _store(self.uri)
        folder, names = f"{root}/{self.aside}/{uuid.uuid4().hex}", []  # an attempt's own
        store.create_dir(folder, recursive=True)
        for row in iterator:
            name = row["name"]
            if not name or "/" in name or name.startswith((".", "_")) or not name.endswith(self.suffix):
                raise ValueError(f"no file name that ends in {self.suffix!r}: {name!r}")
            with store.open_output_stream(f"{folder}/{name}") as f:
                f.write((row["text"] or "").encode())
            names.append(name)
        return _Written(folder, names)

    def commit(self, messages: list) -> None:
        store, root = _store(self.uri)
        names = [n for m in messages if m for n in m.names]
        try:
            if len(set(names)) < len(names):
                twice = sorted({n for n in names if names.count(n) > 1}) if len(names) < 10_000 else []
                raise ValueError(f"a file stands in two rows: {twice[:5]}")
            for m in messages:
                for n in m.names if m else []:
                    store.move(f"{m.folder}/{n}", f"{root}/{n}")
            if self.overwrite:
                for n in set(_names(self.uri, self.suffix)) - set(names):
                    store.delete_file(f"{root}/{n}")
        finally:
            self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        store, root = _store(self.uri)
        store.delete_dir_contents(f"{root}/{self.aside}", missing_dir_ok=True)
        store.delete_dir(f"{root}/{self.aside}")


class TextFiles(DataSource):
    """Options: path, and suffix (default .md)."""

    @classmethod
    def name(cls) -> str:
        return "textfiles"

    def schema(self) -> str:
        return "name string, text string"

    def _where(self) -> tuple[str, str]:
        return self.options["path"].rstrip("/"), self.options.get("suffix", ".md")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(*self._where())

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(*self._where(), overwrite)


def read_files(spark: SparkSession, uri: str, suffix: str = ".md") -> DataFrame:
    """(name, text) of each file."""
    spark.dataSource.register(TextFiles)
    return spark.read.format("textfiles").option("suffix", suffix).load(uri)


def write_files(rows: DataFrame, name: str, text: str, uri: str, suffix: str = ".md", overwrite: bool = False) -> None:
    """Writes a file a row. A name that stands twice, or is none, fails the job, which then leaves no file."""
    rows.sparkSession.dataSource.register(TextFiles)
    out = rows.select(F.col(name).alias("name"), F.col(text).alias("text"))
    out.write.format("textfiles").option("suffix", suffix).mode("overwrite" if overwrite else "append").save(uri)


def write_pages(pages: DataFrame, page: str, text: str, uri: str, overwrite: bool = False) -> None:
    """Writes p001.md and so on, which tables.page_files() reads."""
    write_files(pages.select(F.format_string("p%03d.md", F.col(page).cast("int")).alias("_name"), text), "_name", text, uri, overwrite=overwrite)
