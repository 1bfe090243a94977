"""Near duplicates by HyperMinHash (operator 3).

A document is the set of its distinct 5-word shingles; two are linked if their Jaccard similarity reaches the
threshold. Documents of equal sets form a class, and classes are what is searched:

1. HyperMinHash: for each of `PERMUTATIONS` hash functions, shingles fall into `BUCKETS` buckets; a bucket keeps
   of its smallest hash the count of leading zeros (6 bits) and the 10 bits behind the leading one. Empty
   buckets borrow from a neighbour.
2. `BANDS` bands of `ROWS` registers give keys; classes with a common key are candidates. At the threshold 0.75
   a pair has no key in common with probability (1 - 0.75**5)**50 = 1.3e-6. Registers of sets that have no more
   shingles than that depend on each other, so that sets of up to `EXACT` shingles get further keys by prefix
   filtering, which misses none: of n shingles, the n - ceil(t n) + 1 that the fewest small sets hold.
3. Candidates first are stars, so that a group of copies costs as many pairs as it has members: each class and
   the smallest of its keys; then, where a key still holds several components, each class and the three hubs that
   it shares most keys with, hubs being the classes with the fewest shingles of their own, and random ones. What
   then has a key in common but stands in different components is compared without exception. Keys of up to `FEW`
   members give their pairs. Of members of larger keys, a linked pair shares a shingle that at most `FEW` have,
   and then such a one in the prefixes of both; or it shares frequent shingles alone, of which both have enough.
4. A pair is estimated from its registers, corrected for equal registers that come from different shingles, and
   dropped if that lies 6 standard deviations under the threshold; the others are confirmed on their full sets. A
   hub's pairs are dealt to many tasks by their other member.

Shingles are known by 64-bit fingerprints, sets by the sum of their fingerprints. Null, empty and blank texts
have an empty set and are linked with nothing; texts of fewer than 5 words have one shingle. Null keys join
components but never name one that has another key. Repeated rows are members of one class. Empty tables give
no rows. Only the columns in `keep` go on, without any that is named like a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import textbytes as tb
from quire.llm.graph import components
from quire.llm.shared import bucketed, checkpointed, parts_for, scratch_scope, small_batches, tidy

SHINGLE, PERMUTATIONS, BUCKETS, ROWS, BANDS, EXACT, FEW = 5, 4, 64, 5, 50, 128, 64
REGISTERS = PERMUTATIONS * BUCKETS
MANTISSA = 10
RESULTS = ("n_shingles", "component_id", "kept")


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash sketches, a row of 16-bit registers for each set; no set is empty."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = np.empty((len(sets), REGISTERS), np.uint16)
    for p in range(PERMUTATIONS):
        x = tb.mix(flat ^ np.uint64(0xA0761D6478BD642F * (2 * p + 1) & 0xFFFFFFFFFFFFFFFF))
        least = np.full(len(sets) * BUCKETS, 0xFFFFFFFFFFFFFFFF, np.uint64)
        np.minimum.at(least, row * BUCKETS + (x >> np.uint64(58)).astype(np.int64), x << np.uint64(6))
        least = least.reshape(-1, BUCKETS)
        part = _compressed(least)
        at = np.where(np.tile(least, 2) == 0xFFFFFFFFFFFFFFFF, 2 * BUCKETS, np.arange(2 * BUCKETS))
        full = np.minimum.accumulate(at[:, ::-1], axis=1)[:, : BUCKETS - 1 : -1]
        far = full - np.arange(BUCKETS)  # a borrowed register is marked by how far it came
        part = np.take_along_axis(part, full % BUCKETS, axis=1)
        out[:, p * BUCKETS : (p + 1) * BUCKETS] = np.where(far, tb.mix(part.astype(np.uint64) << np.uint64(6) | far.astype(np.uint64)), part)
    return out


def _compressed(x: np.ndarray) -> np.ndarray:
    """Leading zeros, and the bits behind the leading one."""
    zeros = (64 - np.frexp(np.maximum(x, 1).astype(np.float64))[1]).clip(0, 58).astype(np.uint64)
    mantissa = (x << zeros << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return (zeros << np.uint64(MANTISSA) | mantissa).astype(np.uint16)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How likely registers of unrelated sets of n and m shingles agree: the same count of leading zeros, and
    then the same mantissa."""
    k = np.arange(40)[:, None]
    share = [(1 - 2.0 ** -(k + 1)) ** (x / BUCKETS) - (1 - 2.0**-k) ** (x / BUCKETS) for x in (n, m)]
    return (share[0] * share[1]).sum(axis=0) / 2**MANTISSA


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity of rows of registers, corrected for chance."""
    c = chance(n, m)
    return ((a == b).mean(axis=1) - c) / (1 - c)


def set_id(s: np.ndarray) -> int:
    return int(tb.mix(np.array([tb.mix(s).sum(dtype=np.uint64)], np.uint64)).view(np.int64)[0])


def _small(n: int, percent: int) -> bool:
    """Might a set of at most EXACT shingles be similar to one of n?"""
    return n * percent <= EXACT * 100


def _sketch(texts: list[bytes], percent: int) -> Iterator[tuple[int, int, bytes | None, bytes | None]]:
    """(size, set id, registers, shingles of sets that are _small) of each text."""
    for a, b in tb.chunks(texts):
        sets = tb.shingle_sets(texts[a:b], SHINGLE)
        full = [s for s in sets if len(s)]
        regs = iter(registers(full)) if full else iter(())
        for s in sets:
            small = s.tobytes() if len(s) and _small(len(s), percent) else None
            yield len(s), set_id(s), next(regs).tobytes() if len(s) else None, small


def _raw(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [x or b"" for x in batch.column(column).to_pylist()]


def _classes(df: DataFrame, text: str, percent: int, buckets: int) -> DataFrame:
    """One row a class (set id, size, registers, small set, a text), bucketed by set id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for whole in batches:
            every = _raw(whole, 0)
            for a, b in tb.chunks(every, 4 << 20):
                texts, out = every[a:b], []
                for t, (n, s, regs, small) in zip(texts, _sketch(texts, percent), strict=True):
                    if n and s not in met:  # copies mostly go no further than the task that reads them
                        out.append((s, n, regs, small, t))
                        met.add(s)
                if len(met) > 100_000:
                    met.clear()
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            ids = batch.column(0).to_numpy()
            new = np.append(True, ids[1:] != ids[:-1]) if len(ids) else np.zeros(0, bool)
            if len(ids) and last is not None and ids[0] == last:
                new[0] = False
            last = ids[-1] if len(ids) else last
            yield batch.filter(pa.array(new))

    names, schema = ["id", "n", "registers", "small", "text"], "id long, n long, registers binary, small binary, text binary"
    found = df.select(F.col(text).cast("binary").alias("text")).mapInArrow(tidy(run), schema)
    # the same hash deals rows to partitions and to buckets, so that each partition writes one file
    return bucketed(found.repartition(buckets, "id").sortWithinPartitions("id").mapInArrow(first, schema), buckets, "id")


def _members(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, mark, n, set id) of each row; key and mark tell one text of a repeated key from another."""
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), *[T.StructField(c, T.LongType()) for c in ("mark", "n", "id")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids, texts = [], [], _raw(batch, 2)
            for a, b in tb.chunks(texts):
                for s in tb.shingle_sets(texts[a:b], SHINGLE):
                    sizes.append(len(s))
                    ids.append(set_id(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(ids, pa.int64())], names=schema.names)

    return df.select(F.col(key).alias("key"), F.xxhash64(text).alias("mark"), F.col(text).cast("binary").alias("text")).mapInArrow(tidy(run), schema)


def _keys(classes: DataFrame, percent: int) -> DataFrame:
    """(key, id, n) for each band of a class, or each shingle of its prefix."""
    band = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)

    def of_bands(sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        rows = np.frombuffer(b"".join(sketches), np.uint16).reshape(len(sketches), -1)
        key = np.repeat(band, len(rows), axis=0)
        for r in range(ROWS):  # rows of a band come from different hash functions
            key = tb.mix(key + rows[:, (np.arange(BANDS) * ROWS + r) * 67 % REGISTERS].astype(np.uint64) + np.uint64(1))
        return key.ravel(), np.repeat(np.arange(len(rows)), BANDS)

    def of_sets(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(sets), np.uint64), np.repeat(np.arange(len(sets)), [len(s) // 8 for s in sets])

    def exploded(column: str, found) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for i in range(0, whole.num_rows, 2000):
                    batch = whole.slice(i, 2000)
                    key, of = found(batch.column(2).to_pylist())
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of))], names=["key", "id", "n"])

        return classes.where(F.col(column).isNotNull()).select("id", "n", column).mapInArrow(tidy(run), "key long, id long, n long")

    return exploded("registers", of_bands).union(_prefixes(exploded("small", of_sets), percent).drop("f"))


def _prefixes(rows: DataFrame, percent: int) -> DataFrame:
    """(key, id, n, f) of (key, id, n), a row a shingle: the n - ceil(percent n) + 1 keys of each id that the
    fewest ids have, f, but for keys that only one has; these come first of all and lead to no other."""
    common = rows.groupBy("key").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    shared = rows.join(common, "key").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("f", "key"))).alias("c"))
    shared = shared.withColumn("free", F.expr(f"int(n - (n * {percent} + 99) div 100 + 1 - (n - size(c)))")).where("free > 0")
    return shared.select(F.explode(F.slice("c", F.lit(1), F.col("free"))).alias("e"), "id", "n").select("e.key", "id", "n", "e.f")


def _shingles(classes: DataFrame) -> DataFrame:
    """(key, id, n): a row a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = _raw(whole, 2)
            for a, b in tb.chunks(texts):
                batch, sets = whole.slice(a, b - a), tb.shingle_sets(texts[a:b], SHINGLE)
                of = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), batch.column(0).take(of), batch.column(1).take(of)], names=["key", "id", "n"])

    return classes.select("id", "n", "text").mapInArrow(tidy(run), "key long, id long, n long")


def _with_both(pairs: DataFrame, classes: DataFrame, columns: list[str], parts: int) -> DataFrame:
    """Pairs with columns of both. A hub is the a of many pairs; it is sent to as many tasks as its pairs are."""

    def side(x: str) -> DataFrame:
        return classes.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])

    salted = pairs.withColumn("salt", F.pmod(F.hash("b"), F.lit(parts)))
    hubs = salted.select("a", "salt").distinct().repartition(parts, "a").join(side("a"), "a")
    return salted.repartition(parts, "b").join(side("b"), "b").join(hubs, ["a", "salt"])


def _confirmed(pairs: DataFrame, classes: DataFrame, percent: int, parts: int) -> DataFrame:
    """Of pairs (a, b) of classes, those that are linked: estimated by registers, then confirmed on the sets."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = percent / 100
        for batch in batches:
            n, m = (batch.column(f"n_{x}").to_numpy() for x in "ab")
            least = t - 6 * np.sqrt(t * (1 - t) / np.minimum(REGISTERS, np.minimum(n, m)))  # no more shingles than registers, no surer
            x, y = (np.frombuffer(b"".join(batch.column(f"registers_{v}").to_pylist()), np.uint16).reshape(len(n), -1) for v in "ab")
            take = np.minimum(n, m) * 100 >= np.maximum(n, m) * percent
            take[take] = estimate(x[take], y[take], n[take], m[take]) >= least[take]
            yield pa.RecordBatch.from_arrays([batch.column(x) for x in "ab"], names=["a", "b"]).filter(pa.array(take))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            left, right = _raw(whole, 2), _raw(whole, 3)
            for a, b in tb.spans([len(x) + len(y) for x, y in zip(left, right, strict=True)]):
                batch, take = whole.slice(a, b - a), []
                for x, y in zip(tb.shingle_sets(left[a:b], SHINGLE), tb.shingle_sets(right[a:b], SHINGLE), strict=True):
                    common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                    take.append(100 * common >= percent * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([batch.column(x) for x in "ab"], names=["a", "b"]).filter(pa.array(take))

    # cut here, so that no task runs two Python workers at a time
    pairs = checkpointed(pairs, parts)
    kept = checkpointed(_with_both(pairs, classes, ["n", "registers"], parts).select("a", "b", "n_a", "n_b", "registers_a", "registers_b").mapInArrow(tidy(likely), "a long, b long"), parts)
    return checkpointed(_with_both(kept, classes, ["text"], parts).select("a", "b", "text_a", "text_b").mapInArrow(tidy(linked), "a long, b long"), parts)


def _links(classes: DataFrame, percent: int, parts: int) -> DataFrame:
    """Links that connect whatever is connected."""
    keys = _keys(classes, percent)
    common = keys.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = bucketed(keys.join(common, "key").repartition(parts, "id"), parts, "id")

    def labelled(links: DataFrame) -> DataFrame:
        """Members of keys that still lie in several components."""
        roots = components(links, parts).withColumnRenamed("node", "id")
        rows = buckets.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        several = rows.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y")
        return checkpointed(rows.join(several.select("key"), "key"), parts)

    stars = buckets.where("id != hub").groupBy("id").agg(F.min("hub").alias("a")).select("a", F.col("id").alias("b"))
    links = _confirmed(stars, classes, percent, parts)
    rows = labelled(links)
    # dealt as the buckets are, so that the classes with their texts stay where they are
    shingles = _shingles(classes.join(rows.select("id").distinct().repartition(parts, "id"), "id", "left_semi"))
    met = shingles.groupBy("key").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    # of each class: shingles that others have too, and those that more than FEW have
    shared = checkpointed(shingles.join(met, "key").groupBy("id").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("f") > FEW).alias("often")), parts)

    def counted(rows: DataFrame) -> DataFrame:
        return checkpointed(rows.join(shared, "id", "left").fillna(0, ["c", "often"]), parts)

    def possible(x: str, y: str, count: str) -> Column:
        """Whether two that share no more than the lesser of their counts can be similar."""
        common = F.least(f"{x}{count}", f"{y}{count}")
        return common * 100 >= (F.col(f"{x}n") + F.col(f"{y}n") - common) * percent

    rows = counted(rows.drop("hub"))
    hub = lambda order: F.min(F.struct(*order, *[F.col(v).alias(f"h_{v}") for v in ("id", "root", "c", "n")]))
    hubs = rows.groupBy("key").agg(hub([-F.col("c") / F.col("n")]).alias("x"), hub([F.xxhash64("key", "id")]).alias("y"))
    hubs = hubs.select("key", F.explode(F.array(*[F.struct(f"{h}.h_id", f"{h}.h_root", f"{h}.h_c", f"{h}.h_n") for h in "xy"])).alias("h")).select("key", "h.*")
    stars = rows.join(hubs, (rows["key"] == hubs["key"]) & (F.col("root") != F.col("h_root")) & possible("", "h_", "c"))
    stars = stars.groupBy(F.col("h_id").alias("a"), F.col("id").alias("b")).agg(F.count(F.lit(1)).alias("keys"))
    most = Window.partitionBy("b").orderBy(F.desc("keys"), "a")  # at most two rows a key of b
    stars = stars.withColumn("place", F.row_number().over(most)).where("place <= 3").select("a", "b")
    links = links.union(_confirmed(stars, classes, percent, parts))
    rest = counted(labelled(links).drop("hub")).where(F.col("c") * 100 >= F.col("n") * percent)
    other = F.expr("x.id < y.id and x.root != y.root")

    def pairs(rows: DataFrame, condition: Column) -> DataFrame:
        x, y = rows.alias("x"), rows.alias("y")
        return x.join(y, (F.col("x.key") == F.col("y.key")) & condition).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))

    few = pairs(rest.where(F.col("members") <= FEW), other & possible("x.", "y.", "c"))
    many = rest.where(F.col("members") > FEW)
    often = pairs(many.where(F.col("often") * 100 >= F.col("n") * percent), other & possible("x.", "y.", "often"))
    hot = many.select("id", "root", "c").distinct()
    prefixes = _prefixes(_shingles(classes.join(hot.select("id").repartition(parts, "id"), "id", "left_semi")), percent).where(F.col("f") <= FEW)
    rare = pairs(prefixes.join(hot, "id"), other & possible("x.", "y.", "c"))
    return links.union(_confirmed(few.union(often).union(rare).distinct(), classes, percent, parts))


def near_duplicates(df: DataFrame, key: str, text: str, keep: list[str] | None = None, percent: int = 75) -> DataFrame:
    """Columns `keep` of df (at least key), n_shingles, component_id (the smallest key that can be reached) and
    kept (this row has that key), of each row. The result reads files in the shared folder."""
    spark = df.sparkSession
    small_batches(spark)
    keep = [key, *(c for c in keep or [] if c != key and c not in RESULTS)]
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    buckets = max(parts_for(size, 32 << 20, 12), parts_for(rows, 50_000, 12))
    with scratch_scope(spark):  # of classes and keys; what follows reads checkpoints alone
        roots = components(_links(_classes(df, text, percent, buckets), percent, buckets), buckets)
    members = checkpointed(_members(df, key, text), buckets)
    least = members.where("id is not null").groupBy("id").agg(F.min("key").alias("least"))
    rooted = least.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = rooted.join(names, "root").select("id", "component_id")
    named = members.join(of_class, "id", "left").withColumn("component_id", F.coalesce("component_id", "key"))
    kept = F.col("key").eqNullSafe(F.col("component_id")).alias("kept")
    named = named.select("key", "mark", F.col("n").alias("n_shingles"), "component_id", kept)
    results = [F.col(f"named.{c}") for c in RESULTS]
    if len(keep) == 1:
        return named.alias("named").select(F.col("key").alias(key), *results)
    same = F.col("named.key").eqNullSafe(F.col(f"rows.`{key}`")) & (F.col("named.mark") == F.xxhash64(F.col(f"rows.`{text}`")))
    once = named.dropDuplicates(["key", "mark"]).alias("named")  # repeated rows agree in all of it
    return df.alias("rows").join(once, same).select(*[F.col(f"rows.`{c}`") for c in keep], *results)
