"""Escalation with feedback: what an audit finds changes how later pages of a document are tried."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

_STATE = "open boolean, accepted long, spent double"
_PAGE = "first_tier int, tier int, escalations int, status string, usd double, audited boolean, gate_miss boolean, open boolean, spent double"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class State(NamedTuple):
    """Of a document: whether an audit has found a miss, pages accepted at the first tier, and money spent."""

    open: bool = False
    accepted: int = 0
    spent: float = 0.0


class Rules(NamedTuple):
    """Every audit_every-th page accepted at the cheapest tier is audited (0: none); with `breaker` a miss has later
    pages begin at the next tier, as all do unless economical_first; once more than budget is spent no page is tried."""

    audit_every: int = 10
    economical_first: bool = True
    breaker: bool = True
    budget: float | None = None


def advance(rules: Rules, state: State, route: str | None, attempts: list, audit: tuple) -> tuple[State, tuple]:
    """The next page: attempts are (passed, usd) by tier, cheapest first, the last one the other route's, which pages of
    route B begin with; audit is (differs, usd). What a row doesn't tell did not pass and cost nothing."""
    if rules.budget is not None and state.spent > rules.budget:
        return state, (None, None, 0, "over_budget", 0.0, False, False, state.open, state.spent)
    last = len(attempts) - 1
    first = last if route == "B" else min(1, max(0, last - 1)) if state.open or not rules.economical_first else 0
    usd, tier, passed = 0.0, None, False
    for t in range(max(0, first), last + 1):
        passed, cost = attempts[t]
        usd, tier, passed = usd + (cost or 0.0), t, bool(passed)
        if passed:
            break
    cheap = passed and tier == 0 and route != "B"
    accepted = state.accepted + cheap
    audited = bool(cheap and rules.audit_every and accepted % rules.audit_every == 0)
    miss = audited and bool(audit[0])
    spent = state.spent + usd + ((audit[1] or 0.0) if audited else 0.0)
    out = (None if tier is None else max(0, first), tier, 0 if tier is None else tier - max(0, first), "ok" if passed else "needs_human", usd, audited, miss, state.open, spent)
    return State(state.open or (miss and rules.breaker), accepted, spent), out


class _Pages(StatefulProcessor):
    def __init__(self, doc: str, page: str, rules: Rules):
        self.doc, self.page, self.rules = doc, page, rules

    def init(self, handle) -> None:
        self.state = handle.getValueState("state", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the interface's names
        state, out = State(*self.state.get()) if self.state.exists() else State(), []
        pages = pd.concat(list(rows)).sort_values("page", kind="stable", na_position="first")
        for page, route, attempts, differs, cost in zip(*(pages[c] for c in ("page", "route", "attempts", "differs", "audit_usd")), strict=True):
            state, found = advance(self.rules, state, route, [(a["passed"], a["usd"]) for a in (attempts if attempts is not None else [])], (differs, None if pd.isna(cost) else cost))
            out.append((key[0], page, *found))
        self.state.update(tuple(state))
        found = pd.DataFrame(out, columns=[self.doc, self.page, *(f.split()[0] for f in _PAGE.split(", "))])
        yield found.astype({"first_tier": "Int32", "tier": "Int32"})

    def close(self) -> None:
        pass


def escalated(pages: DataFrame, doc: str, page: str, route: str, attempts: str, audit: str, rules: Rules = Rules()) -> DataFrame:  # noqa: B008  immutable
    """(doc, page, first_tier, tier, escalations, status, usd, audited, gate_miss, open, spent) of each page of a table
    or of a stream: attempts is an array of (passed, usd) by tier, audit a struct (differs, usd); open is whether the
    breaker was when the page began, spent what its document had cost after it, audits included. Documents run side by
    side; the pages of one are taken in order, across micro-batches in the order of arrival. Held at a time are the
    numbers of one document's pages of a batch."""
    spark = pages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)  # what stateful processors need
    _ = spark.streams.active  # starts what keeps track of state, for tables as well
    kinds = pages.schema
    sent = pages.select(
        F.col(doc).alias("doc"), F.col(page).alias("page"), F.col(route).alias("route"), F.col(attempts).alias("attempts"),
        F.coalesce(F.col(f"{audit}.differs"), F.lit(False)).alias("differs"), F.col(f"{audit}.usd").alias("audit_usd"),
    )
    schema = f"`{doc}` {kinds[doc].dataType.simpleString()}, `{page}` {kinds[page].dataType.simpleString()}, {_PAGE}"
    return sent.groupBy("doc").transformWithStateInPandas(_Pages(doc, page, rules), schema, "Append", "None")
