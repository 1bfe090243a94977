"""The ledger as a stream: costs by hour as calls come in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(calls: DataFrame, late: str = "2 hours") -> DataFrame:
    """(start, purpose, calls, usd) of a stream or table with ts, purpose and usd. State is kept until the
    watermark has passed an hour; later calls for it are dropped."""
    watched = calls.withWatermark("ts", late) if calls.isStreaming else calls
    sums = watched.groupBy(F.window("ts", "1 hour").alias("w"), "purpose").agg(F.count(F.lit(1)).alias("calls"), F.sum("usd").alias("usd"))
    return sums.select(F.col("w.start").alias("start"), "purpose", "calls", "usd")
