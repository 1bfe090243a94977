"""A table on disk that takes changes by key, of which only the buckets of changed keys are read and rewritten.

Rows are dealt to folders by a hash of their key. A change reads the folders of its own keys; these are written anew and
swapped in when the whole job has succeeded (partition overwrite), so that a failed one changes nothing. The changed
keys are sent to the stored rows where they are few, behind a look at their size, so that what is stored is not
shuffled. A null key is a key like others. One writer at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.sizes import small
from quire.sources.scratch import written


class StoredTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        self.columns = spark.createDataFrame([], schema).columns

    def read(self) -> DataFrame:
        return self._stored().drop("bucket")

    def _stored(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        schema = f"{self.schema}, bucket int"
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def _same(self, keys: DataFrame) -> tuple[DataFrame, Column]:
        """Keys to join the stored rows with, and how."""
        names = keys.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.key)], *[F.col(c).alias(f"_{c}") for c in keys.columns if c not in (*self.key, "bucket")])
        return small(names), reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.key)])

    def _touched(self, changes: DataFrame) -> DataFrame:
        """The stored rows of the buckets of changes, at most `buckets` numbers."""
        numbers = [r.bucket for r in changes.select("bucket").distinct().collect()]
        return self._stored().where(F.col("bucket").isin(numbers))

    def _unique(self, rows: DataFrame) -> DataFrame:
        """rows by bucket, as scratch; ValueError where a key stands twice."""
        kept = written(self._dealt(rows.select(*self.columns)), "changes")
        if not kept.groupBy(*self.key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
            raise ValueError("a key stands twice in the change")
        return kept

    def _swap(self, rows: DataFrame) -> None:
        """Puts rows in the place of their buckets'; no change here leaves a bucket without rows."""
        rows.select(*self.columns, "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def insert(self, rows: DataFrame) -> None:
        """Adds rows; ValueError if a key is in the table already, or twice among them. Nothing is rewritten."""
        new = self._unique(rows)
        keys, same = self._same(new.select(*self.key))
        if not self._touched(new).join(keys, same, "left_semi").isEmpty():
            raise ValueError("a key is in the table already")
        new.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self.path)

    def upsert(self, rows: DataFrame) -> DataFrame:
        """Rows in place of those of the same keys, or as new ones; the plan of what was written, to be looked at."""
        new = self._unique(rows)
        keys, same = self._same(new.select(*self.key))
        merged = self._touched(new).join(keys, same, "left_anti").unionByName(new)
        self._swap(merged)
        return merged

    def update(self, rows: DataFrame, columns: list[str]) -> None:
        """Sets columns to their values in rows (key and these columns) where the table has the key."""
        patch = self._dealt(written(rows.select(*self.key, *columns), "patch"))
        if not patch.groupBy(*self.key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
            raise ValueError("a key stands twice in the change")
        keys, same = self._same(patch.withColumn("hit", F.lit(True)))
        joined = self._touched(patch).join(keys, same, "left")
        values = [F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in self.columns]
        self._swap(joined.select(*values, "bucket"))
