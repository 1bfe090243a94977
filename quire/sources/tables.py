"""Where rows come from and go to: Parquet tables, page files, configuration, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.textfiles import read_files


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def by_key(df: DataFrame, **key) -> DataFrame:
    """The row of a key; none where it is missing."""
    return of(df, **key).limit(1)


def of(df: DataFrame, *order: str, **values) -> DataFrame:
    """Rows whose columns have these values (null too), in the order of columns if any are given."""
    for c, v in values.items():
        df = df.where(F.col(c).eqNullSafe(F.lit(v)))
    return df.orderBy(*order) if order else df


def page_files(spark: SparkSession, folder: str, suffix: str = "md") -> DataFrame:
    """(n, text) of files named p<number>, empty ones too; whatever is missing simply has no row."""
    number = F.regexp_extract("name", r"^p(\d+)\.", 1)
    return read_files(spark, folder, f".{suffix}").where(number != "").select(number.cast("int").alias("n"), "text")


def binary_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, sha256) of any files, such as rendered pages."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", F.sha2("content", 256).alias("sha256"))


def question_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Cases of YAML files in sorted order; the origin is given, or told from the file's name."""
    import os

    import yaml

    rows = []
    for path in sorted(paths):
        with open(path, encoding="utf-8") as f:
            data = yaml.safe_load(f) or {}
        cases = data.get("cases", data) if isinstance(data, dict) else data
        named = "external" if "external" in os.path.basename(path) else "kb_derived"
        origin = data.get("origin", named) if isinstance(data, dict) else named
        for c in cases:
            rows.append((str(c["id"]), c.get("categoria"), c.get("difficolta", "media"), int(c.get("hops", 1)), bool(c.get("answerable", True)), c.get("domanda"), c.get("expected_target"), [str(x) for x in c.get("must_include") or []], c.get("origin", origin)))
    return spark.createDataFrame(rows, "id string, categoria string, difficolta string, hops int, answerable boolean, domanda string, expected_target string, must_include array<string>, origin string")


def alias_table(path: str) -> dict[str, list[str]]:
    """Terms and what they are expanded to, from a configuration file."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return {str(a["term"]): [str(x) for x in a["expand"]] for a in (yaml.safe_load(f) or {}).get("aliases", [])}


def settings(path: str) -> dict:
    import tomllib

    with open(path, "rb") as f:
        return tomllib.load(f)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def front_matter(columns: list[str], body: str):
    """Markdown with its provenance in front."""
    head = F.concat_ws("\n", F.lit("---"), *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in columns], F.lit("---"))
    return F.concat(head, F.lit("\n"), F.col(body))
