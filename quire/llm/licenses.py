"""License scans with Aho-Corasick and a shunting-yard parser (operator 10).

One automaton over lower-cased words finds identifier tags and notice phrases. Where a document holds an SPDX
tag, the expression behind it is parsed (`with` binds tighter than `and`, that tighter than `or`) and
evaluated against the licences that are allowed. It ends where prose begins (an operand that is no licence, or after
`with` no exception, ends it before its operator), and with the line or before the next tag at the latest. Stops and
dashes at the end of a part are the prose's. A tag with no licence behind it is marked as broken.

Null texts count as empty and give no labels and score 0. Broken expressions are marked as such and never
raise. Rows are independent of each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import textbytes as tb

# The phrases of the contract and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Further notices as words, their labels and how sure they are.
NOTICES = {
    "all rights reserved": ("proprietary", 0.6),
    "cc by nc": ("cc-by-nc", 0.9),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "creative commons": ("creative-commons", 0.5),
    "public domain": ("public-domain", 0.5),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "bsd license": ("bsd", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
    "permission is hereby granted free of charge": ("mit", 0.8),
    "licensed under the": ("notice", 0.3),
}
BASE_WEIGHT = 0.9

# SPDX identifiers of licences that allow reuse with attribution at most.
PERMISSIVE = ("mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "unlicense", "cc0-1.0", "cc-by-4.0", "0bsd")

# Further SPDX identifiers, without the version where several are in use; what may follow these; and exceptions.
OTHERS = (
    "aal", "afl-3.0", "artistic-1.0", "artistic-2.0", "blueoak-1.0.0", "bsd-1-clause", "bsd-4-clause", "bsl-1.0", "busl-1.1", "bzip2-1.0.6", "cecill-2.1", "cddl-1.0", "cddl-1.1", "cpl-1.0", "curl",
    "ecl-2.0", "epl-1.0", "epl-2.0", "eupl-1.1", "eupl-1.2", "ftl", "hpnd", "ijg", "intel", "ipl-1.0", "json", "libpng", "lppl-1.3c", "mit-0", "mpl-1.0", "mpl-1.1", "mpl-2.0", "ms-pl", "ms-rl", "mulanpsl-2.0",
    "ncsa", "ntp", "odbl-1.0", "ofl-1.1", "openssl", "osl-3.0", "php-3.01", "postgresql", "psf-2.0", "python-2.0", "qpl-1.0", "ruby", "sleepycat", "sspl-1.0", "tcl", "unicode-dfs-2016", "upl-1.0", "vim", "w3c",
    "wtfpl", "x11", "zpl-2.1", "apache-1.0", "apache-1.1", "none", "noassertion",
)
_FAMILIES = re.compile(r"(gpl-[123]\.0|lgpl-(2\.[01]|3\.0)|agpl-[13]\.0|gfdl-1\.[123])(\+|-only|-or-later)?|cc-by(-nc)?(-sa|-nd)?-[1-4]\.[05]|(licenseref|documentref)-\S+").fullmatch
_EXCEPTION = re.compile(r".+-exception(-[\w.]+)?|additionref-\S+|llvm-exception|font-exception-2\.0").fullmatch

_TAG = re.compile(r"spdx-license-identifier:", re.I | re.A)
_LINE_END = re.compile(r"[\r\n]")
_PART = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_BINDS = {"or": 1, "and": 2, "with": 3}


_ONES = frozenset((*PERMISSIVE, *OTHERS))


def _fits(part: str, after: str) -> bool:
    """Whether an operand can stand behind an operator."""
    if after == "with":
        return bool(_EXCEPTION(part))
    return part in _ONES or part.removesuffix("+") in _ONES or bool(_FAMILIES(part))


def parse(expression: str) -> list[str]:
    """The SPDX expression that a text begins with, in reverse Polish order; ValueError if there is none."""
    out: list[str] = []
    stack: list[str] = []
    operand, waiting = False, ""  # did an operand end just before? the operator that waits for its right side
    for m in _PART.finditer(expression.lower()):  # no further than the expression goes
        part = m[0].rstrip(".-:") or m[0]
        if part in _BINDS:
            if not operand:
                raise ValueError("operator without a left side")
            operand, waiting = False, part
            continue
        if waiting and part != ")":
            if part != "(" and not _fits(part, waiting):
                operand = True  # the operator was a word of the prose that follows
                break
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[waiting]:
                out.append(stack.pop())
            stack.append(waiting)
        if part == "(":
            if operand:
                break  # prose follows
            stack.append(part)
        elif part == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack or not operand:
                raise ValueError("unmatched parenthesis")
            stack.pop()
        elif operand:
            break
        elif not waiting and not _fits(part, ""):
            raise ValueError("no licence")
        else:
            out.append(part)
            operand = True
        waiting = ""
    if not operand or "(" in stack:
        raise ValueError("unfinished expression")
    return out + stack[::-1]


def allowed(postfix: list[str], permissive: frozenset[str]) -> bool:
    """`or` leaves the choice, `and` asks for both; an exception (`with`) never takes rights away."""
    stack: list[bool] = []
    for part in postfix:
        if part not in _BINDS:
            stack.append(part in permissive)
        else:
            right, left = stack.pop(), stack.pop()
            stack.append({"or": left or right, "and": left and right, "with": left}[part])
    return stack[0]


@lru_cache(maxsize=4)
def _automaton(phrases: tuple[tuple[str, str], ...]) -> ahocorasick.Automaton:
    """Phrases in blanks, so that they match whole words; the blank between two is shared."""
    found = ahocorasick.Automaton()
    for phrase, kind in phrases:
        found.add_word(f" {phrase} ", (phrase, kind))
    found.make_automaton()
    return found


def _phrases() -> tuple[tuple[str, str], ...]:
    both = {**{p: "notice" for p in NOTICES}, **{p: "base" for p in BASE}, "spdx license identifier": "tag"}
    return tuple(sorted(both.items()))


def scan_text(text: str, permissive: frozenset[str]) -> tuple:
    words = text.encode().translate(tb.ALNUM_OR_SPACE).split()
    line = " " + b" ".join(words).decode("latin-1") + " "  # a byte a character
    base, labels, doubt, tagged, ends = [], set(), 1.0, False, []
    for end, (phrase, kind) in _automaton(_phrases()).iter(line):
        if kind == "base":
            base.append(BASE[phrase])
            ends.append(end - len(phrase) - 1)
            doubt *= 1 - BASE_WEIGHT
        elif kind == "notice":
            labels.add(NOTICES[phrase][0])
            doubt *= 1 - NOTICES[phrase][1]
        tagged |= kind == "tag"
    first = last = None
    if ends:
        blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        at = np.searchsorted(blanks, ends)
        first, last = int(at.min()), int(at.max())
    expressions = []
    if tagged:
        tags = [m.span() for m in _TAG.finditer(text)]
        for (_, start), (following, _) in zip(tags, [*tags[1:], (len(text), 0)], strict=True):
            doubt = 0.0
            line_end = _LINE_END.search(text, start, following)
            try:
                postfix = parse(text[start : line_end.start() if line_end else following])
                labels |= {f"{'exception' if _EXCEPTION(x) else 'spdx'}:{x}" for x in postfix if x not in _BINDS}
                labels.add("permissive" if allowed(postfix, permissive) else "restricted")
                expressions.append(" ".join(postfix))
            except ValueError:
                labels.add("spdx-broken")
    names = sorted({*base})
    return len(words), len(base), first, last, names, sorted({*labels, *names}), 1 - doubt, expressions


def scan(df: DataFrame, key: str, text: str, permissive: tuple[str, ...] = PERMISSIVE) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions) of each row."""
    allow = frozenset(x.lower() for x in permissive)
    names = [key, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions"]
    kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [scan_text(t, allow) for t in batch.column(1).to_pylist()]
            columns = [pa.array([x[i] for x in got], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    rows = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text))
    kind = df.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, expressions array<string>")
