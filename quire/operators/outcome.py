"""From attempts at pages to outcomes: escalation, audits, budgets, and batches that go on where they stopped."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.sizes import small
from quire.operators.store import governance


def escalation(attempts: DataFrame, page: list[str], step: str, passed: str, cost: str, reasons: str | None = None) -> DataFrame:
    """(page, escalations, needs_human, cost, reasons): the first attempt that passes ends the chain, and only
    attempts up to it cost. A window over the attempts of a page, which are a few tiers, then an aggregate by the same key."""
    first = F.min(F.when(F.col(passed), F.col(step))).over(Window.partitionBy(*page))
    made = attempts.withColumn("_first", first).where(F.col("_first").isNull() | (F.col(step) <= F.col("_first")))
    out = [(F.count(F.lit(1)) - 1).cast("int").alias("escalations"), F.max("_first").isNull().alias("needs_human"), F.sum(cost).alias("cost")]
    if reasons:
        out.append(F.max_by(reasons, step).alias("reasons"))
    return made.groupBy(*page).agg(*out)


def sampled(rows: DataFrame, group: list[str], order: list[str], accepted: Column, fraction: float) -> DataFrame:
    """rows with audited: every k-th accepted row of a group, k = round(1 / fraction)."""
    k = max(1, round(1 / fraction))
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    nth = F.sum(accepted.cast("int")).over(w)
    return rows.withColumn("audited", accepted & (nth % k == 0))


def spread(rows: DataFrame, order: list[str], n: int, group: list[str]) -> DataFrame:
    """At most n rows of each group in equal steps: every step-th, step = max(1, count // n)."""
    size, place = F.count(F.lit(1)).over(Window.partitionBy(*group)), F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    step = F.greatest(F.lit(1), F.floor(size / n))
    return rows.withColumn("_s", step).withColumn("_p", place - 1).where((F.col("_p") % F.col("_s") == 0) & (F.col("_p") / F.col("_s") < n)).drop("_s", "_p")


def within_budget(rows: DataFrame, group: list[str], order: list[str], cost: str, most: float) -> DataFrame:
    """Rows until the running cost exceeds the limit; the row that does so is the last."""
    w = Window.partitionBy(*group).orderBy(*order)
    before = F.coalesce(F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("spent", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", before).where(F.col("_b") <= most).drop("_b")


def breaker(rows: DataFrame, group: list[str], order: list[str], tripped: Column) -> DataFrame:
    """rows with open: whether an earlier row of the group tripped the breaker. The earliest such row of each group
    is one aggregate, so that no group is sorted or comes together."""
    place = F.struct(*order)
    first = rows.where(tripped).groupBy(*[F.col(g).alias(f"_{g}") for g in group]).agg(F.min(place).alias("_first"))
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group])
    joined = rows.join(small(first), same, "left").withColumn("open", F.coalesce(place > F.col("_first"), F.lit(False)))
    return joined.drop("_first", *[f"_{g}" for g in group])


def start_tier(rows: DataFrame, tiers: tuple[str, str] = ("economical", "strong")) -> DataFrame:
    """rows of breaker() with the tier that a page is first tried at: the stronger one once the breaker is open."""
    return rows.withColumn("tier", F.when(F.col("open"), tiers[1]).otherwise(tiers[0]))


def run_summary(conversions: DataFrame, audits: DataFrame) -> DataFrame:
    """One row: what governance() counts, whether an audit tripped the breaker, and the cost."""
    paid = conversions.agg(F.round(F.coalesce(F.sum("usd"), F.lit(0.0)), 4).alias("usd"))
    return governance(conversions, audits).withColumn("breaker_tripped", F.col("gate_misses") > 0).crossJoin(paid)  # a row each


def batch_summary(rows: DataFrame) -> DataFrame:
    """One row of counts by status (transcribed, skipped, failed), pages for review, and costs."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    spent = [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("usd", "eur")]
    return rows.agg(F.count(F.lit(1)).alias("pages"), of("transcribed"), of("skipped"), of("failed"), F.count_if("needs_review").alias("needs_review"), *spent)


def run_id() -> str:
    """The name of a run, given once by the driver; never a column's."""
    return f"run_{uuid.uuid4().hex}"


def rate_verdict(rate: Column) -> Column:
    """What a share of escalated pages advises."""
    return F.when(rate < 0.15, "cheap first").when(rate > 0.30, "strong first").otherwise("undecided")


def to_do(pages: DataFrame, done: DataFrame, reviewed: DataFrame, key: list[str], force: bool = False) -> DataFrame:
    """Pages not yet converted, nor locked by a review unless forced."""
    open_ = pages.join(done.select(*key), key, "left_anti")
    return open_ if force else open_.join(reviewed.select(*key), key, "left_anti")


CALLED = "answer string, error string, usd double, ms long"


def _one(call: Callable, prompt: str | None) -> tuple:
    """(answer, error, usd, ms) of a call."""
    import time

    began = time.perf_counter()
    try:
        said = call(prompt)
        answer, usd = said if isinstance(said, tuple) else (said, None)
        return answer, None, usd, int((time.perf_counter() - began) * 1000)
    except Exception as e:  # noqa: BLE001  one page's failure is that page's
        return None, f"{type(e).__name__}: {e}", None, None


def called(rows: DataFrame, column: str, call: Callable[[str], str | tuple[str, float]] | None, name: str = "", log: str | None = None, flight: int = 8) -> DataFrame:
    """rows with answer, error, usd and ms of a model call for each, which returns an answer or (answer, usd); an
    error stays with its row. Without a callable all are null: nothing is made up. usd and ms only stand there
    under a `name`, which then precedes all four. With `log` (a URI that all executors reach) a prompt is paid once:
    see replies()."""
    parts = {f.split()[0]: f.split()[1] for f in CALLED.split(", ")}
    wanted = [*parts] if name else ["answer", "error"]
    if call is None:
        return rows.withColumns({f"{name}{c}": F.lit(None).cast(parts[c]) for c in wanted})
    if log:
        found = replies(rows, column, call, log, flight).select(F.col("digest").alias("_digest"), *[F.col(c).alias(f"_{c}") for c in wanted])
        joined = rows.join(found, F.sha2(column, 256) == F.col("_digest"), "left")
        return joined.select(*[rows[c] for c in rows.columns], *[F.col(f"_{c}").alias(f"{name}{c}") for c in wanted])

    @F.pandas_udf(CALLED)
    def ask(prompts):
        import pandas as pd

        found = pd.DataFrame([_one(call, p) for p in prompts], columns=[*parts])
        return found.astype({"usd": "float64", "ms": "Int64"})

    said = rows.withColumn("_a", ask.asNondeterministic()(column))  # a call may answer otherwise the next time
    return said.select(*rows.columns, *[F.col(f"_a.{c}").alias(f"{name}{c}") for c in wanted])


class ReplyLog:
    """Replies in files of their own, named by the digests of their prompts; each appears whole or not at all."""

    def __init__(self, uri: str):
        from pyarrow.fs import FileSystem

        self.store, self.root = FileSystem.from_uri(uri)

    def _path(self, digest: str) -> str:
        return f"{self.root}/{digest[:2]}/{digest}.json"

    def read(self, digest: str) -> tuple | None:
        try:
            with self.store.open_input_stream(self._path(digest)) as f:
                return tuple(json.loads(f.read()))
        except FileNotFoundError:
            return None

    def write(self, digest: str, reply: tuple) -> None:
        path, part = self._path(digest), f"{self.root}/{digest[:2]}/.{uuid.uuid4().hex}"
        self.store.create_dir(path.rpartition("/")[0], recursive=True)
        with self.store.open_output_stream(part) as f:
            f.write(json.dumps(reply).encode())
        self.store.move(part, path)


def replies(rows: DataFrame, column: str, call: Callable[[str], str | tuple[str, float]], log: str, flight: int = 8) -> DataFrame:
    """(digest, answer, error, usd, ms) of each distinct prompt of a column. A task notes a reply below `log` before it
    hands it on, and looks there first, so that a second attempt, a second run or another row of that prompt pays
    nothing; errors aren't noted, and are tried again. A prompt is dealt to one task, which has at most `flight` calls
    under way. Of two attempts of a task that run at once (speculation) both may pay."""

    def ask(batches):
        from concurrent.futures import ThreadPoolExecutor

        import pandas as pd

        known = ReplyLog(log)

        def reply(row: tuple[str, str]) -> tuple:
            digest, prompt = row
            found = known.read(digest)
            if found is None:
                found = _one(call, prompt)
                if found[1] is None:
                    known.write(digest, found)
            return digest, *found

        with ThreadPoolExecutor(flight) as pool:
            for batch in batches:
                for i in range(0, len(batch), 4 * flight):
                    part = batch.iloc[i : i + 4 * flight]
                    done = list(pool.map(reply, zip(part["digest"], part["prompt"], strict=True)))
                    yield pd.DataFrame(done, columns=["digest", "answer", "error", "usd", "ms"]).astype({"usd": "float64", "ms": "Int64"})

    distinct = rows.where(F.col(column).isNotNull()).select(F.sha2(column, 256).alias("digest"), F.col(column).alias("prompt")).groupBy("digest").agg(F.first("prompt").alias("prompt"))
    return distinct.mapInPandas(ask, f"digest string, {CALLED}")
