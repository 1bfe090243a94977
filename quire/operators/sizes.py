"""Joins whose plan depends on how large a side is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and bytes up to which a side is sent to all tasks.
SMALL, SMALL_BYTES = 200_000, 8 << 20


def width(df: DataFrame) -> Column:
    """Bytes of a row, about: what its texts and lists hold, eight for whatever else."""
    def of(name: str, kind: str) -> Column:
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(name), F.lit(0))
        if kind.startswith(("array", "map", "struct")):
            return F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0))
        return F.lit(8)

    return sum((of(f"`{n}`", k) for n, k in df.dtypes), F.lit(16))


def is_small(df: DataFrame, rows: int = SMALL, size: int = SMALL_BYTES) -> bool:
    """Whether a look at no more than rows + 1 of df's rows finds at most so many rows and bytes. The look is a job of
    its own, made here."""
    n, total = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width(df)), F.lit(0))).first()
    return n <= rows and total <= size


def small(df: DataFrame, rows: int = SMALL, size: int = SMALL_BYTES) -> DataFrame:
    """df with the hint to broadcast it if it is_small(); else as it is, for a shuffled join."""
    return F.broadcast(df) if is_small(df, rows, size) else df
