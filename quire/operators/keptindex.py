"""A keyword index on disk that takes changes without being built anew.

Below its folder: `base` holds what has been merged, a partition a bucket of terms, each row with the version up to which
its bucket is merged; `deltas` holds the changes of later versions, a file a task, as new term frequencies of terms and
nodes, the newest of which is right; `texts` holds the normal texts of each node by version, a partition a bucket of nodes,
so that a change finds what it takes back without a look at any posting; `counts` holds by how many nodes each version
changed their number. A version counts once its folder in `counts`, the last to be written, is complete; what a failed run
has left is ignored and its number taken again. Terms, nodes and frequencies stand in segments (segments.py), many in a
row, so that few rows are dealt; the more buckets, the smaller what a task holds of them at once. Document frequencies and weights are made when read. One writer at a time.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from quire.functions import text as tx
from quire.operators import segments
from quire.operators.sizes import small
from quire.sources.scratch import delete

_BASE = f"{segments.ROW}, upto int, bucket int"
_DELTAS = f"{segments.ROW}, bucket int, version int"
_TEXTS = "node_id {kind}, texts array<string>, weights array<double>, worded boolean, version int, bucket int"
_LISTS = ["texts", "weights"]


def _summed(s: Column, **sums: str) -> Column:
    """Of entries in order of their terms, (term, sums of their columns) of each run of equal terms. There are some."""
    def of(r: Column) -> Column:
        run = F.slice(s, r["i"], r["j"] - r["i"])
        totals = [F.aggregate(F.transform(run, lambda x: x[c].cast("double")), F.lit(0.0), lambda t, v: t + v).alias(name) for name, c in sums.items()]
        return F.struct(F.get(s, r["i"] - 1)["term"].alias("term"), *totals)

    n = F.size(s)
    first = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(s, i - 1)["term"] != F.get(s, F.greatest(i - 2, F.lit(0)))["term"]))
    bounds = lambda f: F.zip_with(f, F.concat(F.slice(f, F.lit(2), F.size(f)), F.array(n + 1)), lambda i, j: F.struct(i.alias("i"), j.alias("j")))
    return F.transform(F.transform(F.array(first), bounds)[0], of)


def weighed_terms(items: DataFrame, node: str, fields: dict[str, float], normal=tx.plain) -> DataFrame:
    """(node_id, terms): of each node the sum of the weights of its fields by term; null where it has none. A row's terms
    are summed where it stands; rows are brought together only if any repeat a node."""
    def weighed(column: str, weight: float) -> Column:
        return F.transform(tx.terms(normal(F.coalesce(F.col(column), F.lit("")))), lambda t: F.struct(t.alias("term"), F.lit(float(weight)).alias("w")))

    each = items.select(F.col(node).alias("node_id"), F.concat(*[weighed(c, w) for c, w in fields.items()]).alias("x"))
    if not items.groupBy(node).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
        each = each.groupBy("node_id").agg(F.flatten(F.collect_list("x")).alias("x"))
    # an array of one, so that the entries are put in order once
    terms = F.transform(F.array(F.sort_array("x")), lambda s: F.when(F.size(s) > 0, F.map_from_entries(_summed(s, tf="w"))))[0]
    return each.select("node_id", terms.alias("terms"))


def normal_texts(items: DataFrame, node: str, fields: dict[str, float], normal=tx.plain) -> DataFrame:
    """(node_id, texts, weights, worded): of each node its fields in normal form, their weights, and whether any term is in
    them. Rows are brought together only if any repeat a node."""
    texts = [normal(F.coalesce(F.col(c), F.lit(""))) for c in fields]
    each = items.select(F.col(node).alias("node_id"), F.array(*texts).alias("texts"), F.array(*[F.lit(float(w)) for w in fields.values()]).alias("weights"), reduce(or_, map(tx.has_terms, texts)).alias("worded"))
    if not items.groupBy(node).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
        each = each.groupBy("node_id").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in _LISTS], F.max("worded").alias("worded"))
    return each


def rounded(x: Column) -> Column:
    """F.round(x, 4), which goes through the digits of a number; here only of those that are large or nearly between two."""
    y = x * 1e4
    return F.when((F.abs(y) < 1e9) & (F.abs(y - F.rint(y)) < 0.499999), F.rint(y) / 1e4 + 0.0).otherwise(F.round(x, 4))


class KeptIndex:
    #: Parts of a bucket's terms, each of which one task reads and holds at once; tasks that a bucket's merge is dealt to.
    PARTS, TASKS = 32, 8

    def __init__(self, spark: SparkSession, path: str, node_kind: str = "bigint", buckets: int = 64):
        self.spark, self.path, self.kind, self.buckets = spark, path.rstrip("/"), node_kind, buckets
        self.parts, self.arrow = buckets * self.PARTS, to_arrow_type(DataType.fromDDL(node_kind))

    # -- files

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """Complete versions, a folder each."""
        fs, path = self._fs("counts")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith("version=") and fs.exists(self._fs(f"counts/{n}/_SUCCESS")[1]))

    def _read(self, name: str, schema: str) -> DataFrame:
        fs, path = self._fs(name)
        schema = schema.format(kind=self.kind)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if fs.exists(path) else self.spark.createDataFrame([], schema)

    def _bucket(self, node: str) -> Column:
        return F.pmod(F.xxhash64(node), F.lit(self.buckets)).cast("int")

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        """With the bucket of each row's part; parts of a bucket follow each other."""
        return rows.withColumn("bucket", F.floor(F.col("term_part") / self.PARTS).cast("int"))

    # -- changes

    def change(self, items: DataFrame, node: str, fields: dict[str, float], gone: DataFrame | None = None, normal=tx.plain) -> int:
        """Takes in nodes that are new or have changed (items), and takes out those gone (node_id); the new version.
        Of the stored index, only the texts in the buckets of these nodes are read, and nothing is rewritten."""
        done = self.versions()
        version = done[-1] + 1 if done else 1
        new = normal_texts(items, node, fields, normal)
        if gone is not None:
            rest = gone.select(F.col("node_id").cast(self.kind)).distinct().join(items.select(F.col(node).alias("node_id")), "node_id", "left_anti")
            none = [F.array().cast(kind).alias(c) for c, kind in zip(_LISTS, ("array<string>", "array<double>"))]
            new = new.unionByName(rest.select("node_id", *none, F.lit(False).alias("worded")))
        # each task writes a file for each bucket that it has rows of, so that nothing is shuffled
        new = new.withColumn("bucket", self._bucket("node_id"))
        new.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/texts/version={version}")
        new = self.spark.read.schema(_TEXTS.format(kind=self.kind)).parquet(f"{self.path}/texts/version={version}").select("node_id", *_LISTS, "worded")
        has = F.col("worded").cast("long").alias("has")
        if done:
            touched = [r.b for r in new.select(self._bucket("node_id").alias("b")).distinct().collect()]  # at most `buckets` numbers
            stored = self._read("texts", _TEXTS).where(F.col("bucket").isin(touched) & F.col("version").isin(done)).join(small(new.select("node_id")), "node_id", "left_semi")
            old = stored.groupBy("node_id").agg(F.max_by(F.struct(*_LISTS), "version").alias("x")).select("node_id", F.col("x.texts").alias("old"), F.col("x.weights").alias("old_weights"))
            had = stored.groupBy("node_id").agg(F.max_by("worded", "version").cast("long").alias("had"))  # apart, as texts are wide
            both, counted = new.join(old, "node_id", "left"), new.select("node_id", has).join(had, "node_id", "left")
        else:
            both = new.withColumns({"old": F.lit(None).cast("array<string>"), "old_weights": F.lit(None).cast("array<double>")})
            counted = new.select(has, F.lit(0).alias("had"))
        changes = both.select("node_id", *_LISTS, "old", "old_weights").mapInArrow(segments.of_texts(self.parts), segments.ROW)
        self._bucketed(changes).write.mode("overwrite").parquet(f"{self.path}/deltas/version={version}")
        gained = F.coalesce(F.sum(F.col("has") - F.coalesce("had", F.lit(0))), F.lit(0))
        counted.agg(gained.cast("long").alias("nodes")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/counts/version={version}")
        return version

    # -- reading

    def _segments(self) -> DataFrame:
        """(term_part, size, segment, version, bucket) of the base and of the versions that its bucket has not merged yet."""
        base = self._read("base", _BASE)
        later = self._read("deltas", _DELTAS).where(F.col("version").isin(self.versions() or [0]))
        upto = base.groupBy(F.col("bucket").alias("_b")).agg(F.max("upto").alias("_upto"))  # a row a bucket
        later = later.join(F.broadcast(upto), F.col("bucket") == F.col("_b"), "left").where(F.col("version") > F.coalesce("_upto", F.lit(0)))
        columns = ["term_part", "size", "segment", "version", "bucket"]
        return base.where("term_part is not null").withColumnRenamed("upto", "version").select(columns).unionByName(later.select(columns))

    def read(self, asked: DataFrame | None = None) -> DataFrame:
        """(term, node_id, tf, df, weight), the same as keyword_index() of all current nodes; of the asked terms alone
        if these are given (term)."""
        rows = self._segments().drop("bucket")
        if asked is not None:
            asked = small(asked.select("term").distinct())
            rows = rows.join(asked.select(segments.part(F.col("term"), self.parts).alias("term_part")).distinct(), "term_part", "left_semi")
        # dealt once, by parts of terms
        tf = rows.repartition("term_part").sortWithinPartitions("term_part").mapInArrow(segments.opened(self.arrow), f"term string, node_id {self.kind}, tf double, df long")
        if asked is not None:
            tf = tf.join(asked, "term", "left_semi")
        nodes = self._read("counts", "nodes long, version int").where(F.col("version").isin(self.versions() or [0])).agg(F.coalesce(F.sum("nodes"), F.lit(0)).alias("nodes"))
        idf = F.log((1 + F.col("nodes")) / (1 + F.col("df"))) + 1
        exact = tf.crossJoin(F.broadcast(nodes)).select("term", "node_id", "tf", "df", (F.col("tf") * idf).alias("_w"))  # nodes: one row
        return exact.select("term", "node_id", "tf", "df", rounded(F.col("_w")).alias("weight"))

    def merge(self) -> list[int]:
        """Merges all deltas into the base: only buckets that have any are read and rewritten, each whole or not at all.
        A bucket knows the version that it holds, so that a run that stops half-way leaves the index as it was; what all
        buckets have merged goes from the deltas."""
        done = self.versions()
        upto = done[-1] if done else 0
        later = self._read("deltas", _DELTAS).where(F.col("version").isin(done or [0]))
        base = self._read("base", _BASE)
        has = {r._b: r._upto for r in base.groupBy(F.col("bucket").alias("_b")).agg(F.max("upto").alias("_upto")).collect()}  # a row a bucket
        newest = {r.bucket: r.v for r in later.groupBy("bucket").agg(F.max("version").alias("v")).collect()}
        touched = sorted(b for b, v in newest.items() if v > has.get(b, 0))
        if touched:
            # dealt once, a bucket to some tasks, which both merge and write it
            rows = self._segments().where(F.col("bucket").isin(touched)).withColumn("_task", F.col("term_part") % self.TASKS)
            rows = rows.repartition("bucket", "_task").sortWithinPartitions("term_part").drop("bucket", "_task")
            rows = self._bucketed(rows.mapInArrow(segments.merged(self.arrow), segments.ROW)).withColumn("upto", F.lit(upto))
            # a bucket that loses its last entry keeps a row without a part, which says what it has merged
            marks = self.spark.createDataFrame([(None, None, None, upto, b) for b in touched], _BASE)
            rows.unionByName(marks).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/base")
        for version in done:
            delete(self.spark, f"{self.path}/deltas/version={version}")
        return touched
