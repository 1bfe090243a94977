"""Documents to training tokens: a pipeline of stages, each of which works on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.

Odd rows: a null text counts as empty, is toxic only if all training rows are, is nobody's near duplicate, and stays.
A null doc_id is a document like any other. Rows that repeat a doc_id and its text all stay or all go in the first two
stages; in the third they repeat each other, as copies with other ids would if any were left. Of texts that tie as near
duplicates the smallest doc_id stays. Empty tables give no rows; further columns of documents are not carried on.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, decontam, neardup, suffixdedup, toxicity
from quire.llm.shared import delete, scratch, scratch_scope, settled, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Scores from which a document counts as toxic; share of benchmark words from which it goes as a whole.
TOXIC, COVERED = 0.3, 0.8
#: Bytes of a passage that is cut out where it repeats: fewer than 99 of 100 passages of 51 words have.
REPEATED = 240

#: No stage can be written in SQL as a whole; each is tested against a plain version of it.
ORACLE_SQL = None


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic; the model learns from the labelled documents that are not held out."""
    labels = table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    model = toxicity.fit(docs, "doc_id", "text", labels, "doc_id", "toxic")
    return toxicity.score(docs, "doc_id", "text", model, COLUMNS).where(F.col("score") < TOXIC).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays."""
    return neardup.near_duplicates(docs, "doc_id", "text", COLUMNS).where("kept").select(COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out strings of REPEATED bytes that occur twice; a document of which nothing is left goes."""

    def cut() -> DataFrame:
        found = suffixdedup.dedup(docs, "text", COLUMNS, REPEATED, as_text=True)
        left = found.where("n_removed = 0 or kept != ''").withColumn("text", F.coalesce("kept", F.lit("")))
        return left.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)

    return settled(spark, "repeats", cut)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out what test items contain; a document that consists of such words for the most part goes."""
    keep = [c for c in COLUMNS if c not in ("text", "n_chars")]
    found = decontam.clean(docs, "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text", keep, COVERED)
    return found.withColumn("text", F.col("cleaned")).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, with digests of them and of what they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(docs, "doc_id", "text", path, public_tokenizers.PATTERN, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("near duplicates", near_duplicates),
    ("suffix-array dedup", repeats),
    ("benchmark decontamination", benchmark),
    ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder; of what is written there only the last
    result stays, for whoever reads it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"pipeline-{k}")
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
