import os
import random

import pytest

from quire.operators import outcome
from quire.streaming.escalate import Rules, State, advance, escalated

ATTEMPTS = "doc string, n int, route string, attempts array<struct<passed: boolean, usd: double>>, audit struct<differs: boolean, usd: double>"


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


# --- calls paid once


def caller(folder, fails=()):
    """A call that leaves a file behind, and one that takes its worker with it where told to."""

    def call(prompt):
        if prompt in fails and not os.path.exists(f"{folder}/died-{prompt}"):
            open(f"{folder}/died-{prompt}", "w").close()
            os._exit(1)
        with open(f"{folder}/{prompt}-{os.getpid()}-{random.random()}", "w"):
            pass
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper(), 0.5

    return call


def paid(folder):
    return sorted(f.partition("-")[0] for f in os.listdir(folder) if not f.startswith("died"))


def test_a_prompt_is_paid_once(spark, tmp_path):
    calls, log = tmp_path / "calls", (tmp_path / "log").as_uri()
    calls.mkdir()
    df = spark.createDataFrame([(i, f"p{i % 7}") for i in range(50)] + [(60, None), (61, "bad")], "i int, prompt string").repartition(6)
    call = caller(str(calls))
    for again in range(2):
        got = outcome.called(df, "prompt", call, "x_", log)
        assert got.columns == ["i", "prompt", "x_answer", "x_error", "x_usd", "x_ms"]
        want = [(i, f"P{i % 7}", None, 0.5) for i in range(50)] + [(60, None, None, None), (61, None, "ValueError: no", None)]
        assert rows(got, "i", "x_answer", "x_error", "x_usd") == sorted(want, key=str)
        assert paid(calls) == sorted([f"p{i}" for i in range(7)] + ["bad"] * (again + 1))


def test_a_killed_task_pays_nothing_twice(spark, tmp_path):
    calls, log = tmp_path / "calls", (tmp_path / "log").as_uri()
    calls.mkdir()
    df = spark.createDataFrame([(f"p{i:02d}",) for i in range(40)], "prompt string").coalesce(1)
    call = caller(str(calls), fails=("p23",))
    with pytest.raises(Exception, match="(?i)worker|EOF|aborted"):
        outcome.replies(df, "prompt", call, log, flight=1).collect()
    before = paid(calls)
    assert before and len(before) < 40
    got = outcome.replies(df, "prompt", call, log, flight=3)
    assert rows(got, "answer") == [(f"P{i:02d}",) for i in range(40)]
    twice = [p for p in set(paid(calls)) if paid(calls).count(p) > 1]
    assert not twice and set(paid(calls)) == {f"p{i:02d}" for i in range(40)}


def test_calls_under_way_are_bounded(spark, tmp_path):
    calls, log = tmp_path / "now", (tmp_path / "log").as_uri()
    calls.mkdir()
    folder = str(calls)

    def call(prompt):
        import time

        path = f"{folder}/{prompt}"
        open(path, "w").close()
        n = len(os.listdir(folder))
        time.sleep(0.02)
        os.remove(path)
        return str(n)

    df = spark.createDataFrame([(f"p{i}",) for i in range(60)], "prompt string").coalesce(1)
    got = [int(r.answer) for r in outcome.replies(df, "prompt", call, log, flight=3).coalesce(1).collect()]
    assert 1 < max(got) <= 3 * spark.sparkContext.defaultParallelism and len(got) == 60


# --- escalation with feedback


def plain(pages, every, first_cheap, breaker, budget):
    """The loop as it is described: a page at a time, with what went before in variables."""
    out, state = [], {}
    for doc, n, route, attempts, audit in sorted(pages, key=lambda p: (str(p[0]), p[1])):
        s = state.setdefault(doc, {"open": False, "ok": 0, "spent": 0.0})
        was = s["open"]
        if budget is not None and s["spent"] > budget:
            out.append((doc, n, None, None, 0, "over_budget", 0.0, False, False, was, s["spent"]))
            continue
        tiers = [2] if route == "B" else [1, 2] if s["open"] or not first_cheap else [0, 1, 2]
        usd, passed, tier = 0.0, False, None
        for tier in tiers:
            passed, cost = attempts[tier]
            usd += cost
            if passed:
                break
        audited = miss = False
        if passed and tier == 0:
            s["ok"] += 1
            audited = bool(every) and s["ok"] % every == 0
        s["spent"] += usd
        if audited:
            miss = audit[0]
            s["spent"] += audit[1]
            s["open"] = s["open"] or (miss and breaker)
        out.append((doc, n, tiers[0], tier, tier - tiers[0], "ok" if passed else "needs_human", usd, audited, miss, was, s["spent"]))
    return sorted(out, key=str)


def made(seed, docs=12):
    r = random.Random(seed)
    costs = (0.25, 1.0, 4.0)
    return [
        (f"d{d}", n, r.choice("AAAAB"), [(r.random() < p, c) for p, c in zip((0.8, 0.9, 0.95), costs, strict=True)], (r.random() < 0.3, 1.0))
        for d in range(docs) for n in range(r.randint(1, 30))
    ]


@pytest.mark.parametrize("rules", [Rules(3), Rules(2, budget=9.0), Rules(1, breaker=False), Rules(0), Rules(2, economical_first=False)])
def test_escalation_equals_a_plain_loop(spark, rules):
    pages = made(5)
    df = spark.createDataFrame(pages, ATTEMPTS).repartition(5)
    got = rows(escalated(df, "doc", "n", "route", "attempts", "audit", rules))
    want = plain(pages, rules.audit_every, rules.economical_first, rules.breaker, rules.budget)
    assert got == want
    if rules == Rules(3):  # a miss changes what later pages try and cost
        later = [x for x in want if x[9]]
        assert later and all(x[2] >= 1 for x in later)
        assert sum(x[6] for x in want) != sum(x[6] for x in plain(pages, 0, True, True, None))


def test_escalation_of_odd_rows(spark):
    df = spark.createDataFrame([("d", 1, None, None, None), ("d", None, "A", [(None, None)], (True, None)), (None, 2, "B", [(True, 1.0)], None)], ATTEMPTS)
    got = rows(escalated(df, "doc", "n", "route", "attempts", "audit", Rules(1)))
    assert got == sorted([
        ("d", None, 0, 0, 0, "needs_human", 0.0, False, False, False, 0.0), ("d", 1, None, None, 0, "needs_human", 0.0, False, False, False, 0.0),
        (None, 2, 0, 0, 0, "ok", 1.0, False, False, False, 1.0),
    ], key=str)
    assert escalated(df.limit(0), "doc", "n", "route", "attempts", "audit").count() == 0


def test_state_is_carried_across_batches_of_a_stream(spark, tmp_path):
    pages = made(8, 4)
    schema = spark.createDataFrame(pages[:1], ATTEMPTS).schema
    for k in range(3):  # pages 0 to 9, 10 to 19, 20 and more
        part = [p for p in pages if min(2, p[1] // 10) == k]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = escalated(stream, "doc", "n", "route", "attempts", "audit", Rules(2, budget=30.0))
    q = found.writeStream.outputMode("append").format("memory").queryName("escalated_pages").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert len([p for p in q.recentProgress if p["numInputRows"]]) == 3
    assert rows(spark.table("escalated_pages")) == plain(pages, 2, True, True, 30.0)


def test_one_step():
    state, out = advance(Rules(1), State(), "A", [(True, 0.5), (True, 1.0)], (True, 2.0))
    assert state == State(True, 1, 2.5) and out == (0, 0, 0, "ok", 0.5, True, True, False, 2.5)
    state, out = advance(Rules(1), state, "A", [(True, 0.5), (True, 1.0), (True, 4.0)], (False, None))
    assert state == State(True, 1, 3.5) and out == (1, 1, 0, "ok", 1.0, False, False, True, 3.5)
