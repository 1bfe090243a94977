"""Further columns, named like results or like what operators use inside, change nothing."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quire.llm import ann, bpe, chat, decontam, licenses, merkle, neardup, prefixtrie, suffixdedup, tokencounts, tokenfiles, toxicity, warc
from quire.llm.shared import make_dir, scratch
from tests.llm.conftest import prose

NAMES = (
    "key", "id", "ids", "n_tokens", "start", "file", "place", "score", "rank", "query_id", "windows", "formatted", "turns", "n_words", "spans", "items", "cleaned",
    "labels", "base_labels", "passages", "n_bytes", "n_removed", "block", "_text", "_0", "h", "mark", "component_id", "n_shingles", "kept", "payload", "sha1", "first", "_conv", "v",
    "g", "pos", "h", "altered", "copy", "leaf", "conv_id", "seq", "turn", "sig", "depth", "up", "n", "t", "unit", "n_bytes",
)


def odd(df):
    return df.withColumns({c: F.lit(f"a column called {c}") for c in NAMES})


def files(spark, df):
    out = make_dir(spark, scratch(spark, "t"))
    tokenfiles.write(df, "doc_id", "body", public_tokenizers.path("word_bpe_49k.json"), out, length=32)
    return tokenfiles.with_starts(tokenfiles.read(spark, out, df.schema["doc_id"].dataType), "doc_id")


def archive(spark, df):
    out = make_dir(spark, scratch(spark, "t"))
    warc.write(df, "doc_id", "body", "body", out)
    return warc.read(spark, out, df.schema["doc_id"].dataType).drop("block")


def items(spark, df):
    return df.select(F.col("doc_id").alias("item_id"), F.substring("body", 1, 200).alias("text"))


OPERATORS = {
    "chat": lambda s, df: chat.windows(df, "lang", "doc_id", "role", "body"),
    "bpe": lambda s, df: bpe.round_trip(df, "doc_id", "body", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
    "neardup": lambda s, df: neardup.near_duplicates(df, "doc_id", "body", ["doc_id", "lang"]),
    "warc": archive,
    "ann": lambda s, df: ann.search(df, "doc_id", "vector", lambda i: i % 5 == 0),
    "tokenfiles": files,
    "suffixdedup": lambda s, df: suffixdedup.dedup(df, "body", ["doc_id", "lang"], 60),
    "toxicity": lambda s, df: toxicity.score(df, "doc_id", "body", toxicity.fit(df, "doc_id", "body", df.selectExpr("doc_id AS d", "doc_id % 3 AS t"), "d", "t"), ["lang"]),
    "decontam": lambda s, df: decontam.scan(df, "doc_id", "body", items(s, df), "item_id", "text", keep=["lang"]),
    "prefixtrie": lambda s, df: prefixtrie.trie(prefixtrie.turns(df, "doc_id", "place_in", "role", "body"), 5),
    "merkle": lambda s, df: merkle.manifest(df, "doc_id", "lang", ["doc_id", "lang", "body"], F.col("doc_id") % 2 == 0, "body"),
    "tokencounts": lambda s, df: tokencounts.count(df, "doc_id", "body", public_tokenizers.path("piece_bpe_32k.model")),
    "licenses": lambda s, df: licenses.scan(df, "doc_id", "body"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(spark, name):
    rows = [(i, prose(i % 9, 40) + (" under the MIT License" if i % 4 else ""), "en", ("user", "assistant")[i % 2], [float(i), 1.0, float(i % 3)], i % 4) for i in range(20)]
    plain = spark.createDataFrame(rows, "doc_id long, body string, lang string, role string, vector array<double>, place_in int")
    want, got = (sorted(map(str, OPERATORS[name](spark, df).collect())) for df in (plain, odd(plain)))
    assert got == want and len(want)
