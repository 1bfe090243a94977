import hashlib
import re
import zlib

import pytest

from quire.llm import prefixtrie as pt
from quire.llm.shared import scratch_scope

SCHEMA = "conv_id long, turn int, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """All nodes, from plain lists."""
    talks = {}
    for c, turn, role, text in rows:
        if c is not None:
            talks.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    talks = {c: [x[1:] for x in sorted(t, key=lambda x: x[0])] for c, t in talks.items()}
    built = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = talks.get(c - c % 20, [])[:h] + own[h:]
    members = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[:-1] == q for r in members)]
        saved = sum((len(members[q]) - 1) * len(WORD.findall(q[-1][1])) for q in below if q)
        ends = ",".join(str(c) for c in sorted(cs) if built[c] == list(p))
        up = min(members[p[:-1]]) if p else None
        out.append((min(cs), len(p), up, len(cs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, limit):
    with scratch_scope(spark):
        talks = pt.turns(spark.createDataFrame(rows, SCHEMA), "conv_id", "turn", "role", "text")
        return sorted((tuple(r) for r in pt.trie(pt.rebuilt(talks), limit).collect()), key=str)


def talks(n, common):
    """Conversations of 0 to 6 turns; the greater `common`, the longer their common beginnings and the more copies."""
    return [(c, i, ("user", "assistant")[i % 2], f"hello  there {i}" if i < common else f"w{(c * 7 + i) % 5} x") for c in range(n) for i in range(1 + c % 6)]


@pytest.mark.parametrize(("common", "limit"), [(0, 4000), (3, 4000), (0, 3), (3, 10), (6, 1)])
def test_against_brute_force(spark, common, limit):
    rows = talks(70, common)
    assert found(spark, rows, limit) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (0, None, None, None), (0, 1, "user", ""), (0, 1, "user", ""), (20, 3, "a", "x" * 30_000 + " y"), (21, 0, None, "\x1c z"), (41, 0, "user", "only its own"),
        (None, 1, "user", "nobody's"), (10**12, 0, "", "\n"), (10**12 + 1, 0, "user", "b"), (63, 0, "user", "no base"),
    ]
    assert found(spark, rows, 2) == brute(rows)
    assert found(spark, [], 10) == []


def test_no_turns_are_left(spark):
    """A conversation whose turns are all replaced by those of one that isn't there."""
    c = next(c for c in range(1, 99) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "user", "gone")]
    assert found(spark, rows, 10) == brute(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
