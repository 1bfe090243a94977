"""The ledger of model calls: what they cost and what for."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES = ("tok_in", "tok_out", "tok_cache_r", "tok_cache_w", "usd", "eur")
#: What a report may be grouped by.
DIMENSIONS = {"purpose": F.col, "model": F.col, "query": F.col, "day": lambda _: F.substring("ts", 1, 10)}


def _sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("calls"), *(F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES)]


def total(calls: DataFrame) -> DataFrame:
    """One row, of an empty ledger too."""
    return calls.agg(*_sums())


def report_by(calls: DataFrame, dimension: str, columns: dict[str, str] | None = None) -> DataFrame:
    """Sums by a dimension; calls without one form a group. Other names raise ValueError."""
    if dimension not in DIMENSIONS:
        raise ValueError(f"no dimension {dimension!r}; there are {', '.join(sorted(DIMENSIONS))}")
    key = DIMENSIONS[dimension]((columns or {}).get(dimension, dimension))
    return calls.groupBy(key.alias("key")).agg(*_sums()).orderBy("key")


def call_cost(tok_in: Column, tok_out: Column, cache_r: Column, cache_w: Column, price_in: Column, price_out: Column, ttl: str = "5m", read: float = 0.10, write_5m: float = 1.25, write_1h: float = 2.00) -> Column:
    """USD of a call at prices per million tokens; null counts are none."""
    if ttl not in ("5m", "1h"):
        raise ValueError(f"no cache lifetime {ttl!r}")
    none = F.lit(0)
    write = write_5m if ttl == "5m" else write_1h
    used = F.coalesce(tok_in, none) + F.coalesce(cache_r, none) * read + F.coalesce(cache_w, none) * write
    return (used * price_in + F.coalesce(tok_out, none) * price_out) / 1e6


def priced(calls: DataFrame, prices: DataFrame, usd_to_eur: float = 0.87, ttl: str = "5m") -> DataFrame:
    """calls with usd and eur; a model without a price raises."""
    known = prices.select(F.col("model").alias("_model"), "input_per_mtok", "output_per_mtok")
    joined = calls.join(known, F.col("model") == F.col("_model"), "left")
    checked = F.when(F.col("_model").isNull(), F.raise_error(F.concat(F.lit("no price for model "), F.coalesce("model", F.lit("null"))))).otherwise(F.col("input_per_mtok"))
    cost = call_cost(*map(F.col, MEASURES[:4]), checked, F.col("output_per_mtok"), ttl)
    return joined.withColumn("usd", cost).withColumn("eur", F.col("usd") * usd_to_eur).drop("_model", "input_per_mtok", "output_per_mtok")


def recorded(calls: DataFrame, path: str, now: datetime | None = None) -> DataFrame:
    """Appends calls to the ledger at path and returns what was written: each with a call_id of its own, and with
    the present time (UTC) where ts is null."""
    batch, time = uuid.uuid4().hex, (now or datetime.now(UTC)).isoformat(timespec="seconds")
    ids = F.concat(F.lit(f"{batch}-"), F.monotonically_increasing_id())
    stamped = calls.withColumns({"ts": F.coalesce(F.col("ts"), F.lit(time)), "call_id": ids})
    stamped.write.mode("append").parquet(path)
    written = calls.sparkSession.read.schema(stamped.schema).parquet(path)
    return written.where(F.startswith("call_id", F.lit(f"{batch}-")))


def rendered(report: DataFrame) -> DataFrame:
    """Lines of a fixed width."""
    line = F.format_string("%-24s %8d %12d %12d %12.6f %12.6f", F.coalesce(F.col("key").cast("string"), F.lit("-")), "calls", F.col("tok_in").cast("long"), F.col("tok_out").cast("long"), F.col("usd").cast("double"), F.col("eur").cast("double"))
    return report.select(line.alias("line"))
