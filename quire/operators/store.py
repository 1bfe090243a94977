"""Tables without a transaction log: append-only rows, and what is current among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What marks a rule in the flags of a review.
RULE_MARKERS = {
    "simbolo doppio": "lint:simbolo_doppio",
    "dingbat": "lint:dingbat",
    "header/footer": "lint:header_footer",
    "numero di pagina": "lint:numero_pagina",
    "numeri mancanti": "gate:numeri_mancanti",
    "overlap basso": "gate:overlap",
    "parole critiche": "gate:parole_critiche",
    "abbinamenti codice": "gate:pair_codici",
    "ripetizione": "gate:ripetizione",
    "artefatti": "gate:artefatti",
}


def latest(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key (an upsert): one aggregate, so that a hot key is reduced before the shuffle."""
    rest = [c for c in log.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return log.groupBy(*key).agg(last).select(*key, *[F.col(f"_last.{c}").alias(c) for c in rest]).select(*log.columns)


def latest_run(runs: DataFrame, run: str, order: list[str], extra: tuple[str, ...] = ()) -> DataFrame:
    """The run that was recorded last, by columns that tell their sequence; no row where there is none."""
    last = F.max_by(F.struct(run, *extra), F.struct(*order)).alias("_last")
    return runs.agg(last).where("_last is not null").select(*[F.col(f"_last.{c}").alias(c) for c in (run, *extra)])


def assert_unique(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows, or an error when read if a key stands twice (a plain insert)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    return rows.withColumn("_n", n).withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit("duplicate key")))).where("_n is null").drop("_n")


def orphans(child: DataFrame, parent: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose parent is missing (a foreign key)."""
    return child.join(parent.select(*on), on, "left_anti")


def patched(rows: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with the values of patch where it has the key; keys that rows lack are ignored."""
    new = patch.select(F.col(key).alias("_key"), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = rows.join(new, F.col(key) == F.col("_key"), "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def replaced_partition(rows: DataFrame, path: str, column: str) -> None:
    """Writes rows in place of the partitions that they have rows of; the others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def pending(rows: DataFrame, reviews: DataFrame, key: list[str]) -> DataFrame:
    """Rows that nobody has reviewed."""
    return rows.join(reviews.select(*key), key, "left_anti").orderBy(*key)


def governance(conversions: DataFrame, audits: DataFrame) -> DataFrame:
    """One row: pages, pages by route, escalated, share of escalated (0 of none), for humans, misses of the gate."""
    if_ = lambda c: F.count_if(F.expr(c))
    done = conversions.agg(
        F.count(F.lit(1)).alias("pages"), if_("route = 'A'").alias("route_a"), if_("route = 'B'").alias("route_b"),
        if_("escalations > 0").alias("escalated"), if_("status = 'needs_human'").alias("needs_human"),
    )
    rate = F.when(F.col("pages") == 0, F.lit(0.0)).otherwise(F.col("escalated") / F.col("pages"))
    return done.withColumn("rate", rate).crossJoin(audits.agg(if_("gate_miss").alias("gate_misses")))  # a row each


def false_positives(reviews: DataFrame, flags: str, markers: dict[str, str] | None = None) -> DataFrame:
    """(rule, n): how many rows name each rule. The markers are a few literals, so that one pass counts all."""
    found = F.array_compact(F.array(*[F.when(F.contains(F.lower(flags), F.lit(m)), F.lit(r)) for m, r in (markers or RULE_MARKERS).items()]))
    return reviews.select(F.explode(found).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def resolved(reviews: DataFrame) -> DataFrame:
    """What a reviewer's action makes of a page: its status, and the digests of what was refused and accepted."""
    fixed = F.col("action") == "correction"
    status = F.when(fixed, "corretta_umano").otherwise("accettata_umano")
    return reviews.withColumn("status", status).withColumn("sha_resolved", F.when(fixed, F.sha2("text_resolved", 256)).otherwise(F.sha2("text_refused", 256))).withColumn("sha_refused", F.sha2("text_refused", 256))
