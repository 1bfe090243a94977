import random
import re

import pytest

from quire.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    ws = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    at = [(i, label) for phrase, label in licenses.BASE.items() for p in [phrase.split()] for i in range(len(ws)) if ws[i : i + len(p)] == p]
    starts = [i for i, _ in at]
    return len(ws), len(at), min(starts, default=None), max(starts, default=None), sorted({x for _, x in at})


def test_against_brute_force(spark, docs, odd_texts):
    r = random.Random(5)
    parts = ["MIT", "license", "GNU general", "public", "License", "apache", "CC", "by", "nc", "é", "1", "--", "\n", "CC-BY"]
    texts = [*odd_texts, *(" ".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(200))]
    rows = spark.createDataFrame([(i, t, "labels") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = licenses.scan(rows, "doc_id", "text").collect()
    assert sum(x.n_base for x in got) > 50
    for x in got:
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == brute(texts[x.doc_id])
        assert {*x.base_labels} <= {*x.labels} and 0 <= x.score <= 1


@pytest.mark.parametrize(
    "text, postfix, free",
    [
        ("MIT", "mit", True),
        ("GPL-2.0-only OR MIT AND Apache-2.0", "gpl-2.0-only mit apache-2.0 and or", True),
        ("(GPL-2.0-only OR MIT) AND LGPL-2.1", "gpl-2.0-only mit or lgpl-2.1 and", False),
        ("GPL-2.0-or-later WITH Classpath-exception-2.0 AND MIT", "gpl-2.0-or-later classpath-exception-2.0 with mit and", False),
    ],
)
def test_expressions(text, postfix, free):
    assert " ".join(licenses.parse(text)) == postfix
    assert licenses.allowed(licenses.parse(text), frozenset(licenses.PERMISSIVE)) is free


@pytest.mark.parametrize("text", ["", "OR MIT", "(MIT", "MIT)", "MIT OR", "()"])
def test_broken_expressions(text):
    with pytest.raises(ValueError):
        licenses.parse(text)


@pytest.mark.parametrize(
    "text, labels",
    [
        ("MIT.", ["permissive", "spdx:mit"]),
        ("MIT-->", ["permissive", "spdx:mit"]),
        ("MIT and enjoy it", ["permissive", "spdx:mit"]),
        ("MIT or (GPL-2.0+ and ISC). Then", ["permissive", "spdx:gpl-2.0+", "spdx:isc", "spdx:mit"]),
        ("see LICENSE", ["spdx-broken"]),
        ("and MIT", ["spdx-broken"]),
        ("(MIT and enjoy it)", ["spdx-broken"]),
        ("GPL-2.0-only WITH Classpath-exception-2.0", ["exception:classpath-exception-2.0", "restricted", "spdx:gpl-2.0-only"]),
        ("MIT with love", ["permissive", "spdx:mit"]),
        ("MIT AND LicenseRef-own-1", ["restricted", "spdx:licenseref-own-1", "spdx:mit"]),
        ("MPL-2.0+ text", ["restricted", "spdx:mpl-2.0+"]),
    ],
)
def test_expressions_in_prose(text, labels):
    got = licenses.scan_text(f"SPDX-License-Identifier: {text}", frozenset(licenses.PERMISSIVE))
    assert [x for x in got[5] if x not in got[4]] == labels


def test_tags():
    allow = frozenset(licenses.PERMISSIVE)
    assert licenses.scan_text("// SPDX-License-Identifier: MIT OR GPL-2.0-only\nx", allow)[5] == ["permissive", "spdx:gpl-2.0-only", "spdx:mit"]
    assert licenses.scan_text("SPDX-License-Identifier: (", allow)[5] == ["spdx-broken"]


@pytest.mark.parametrize("form", ["{}", "({})"])
@pytest.mark.parametrize("last", ["MIT", "GPL-2.0-only"])
def test_long_expressions(form, last):
    """Of more than 400 characters: the last term counts as the first does."""
    names = ["MIT", "ISC", "Zlib", "Apache-2.0"] * 30 + [last]
    expression = form.format(" AND ".join(names))
    assert len(expression) > 800
    got = licenses.scan_text(f"# SPDX-License-Identifier: {expression}\nx", frozenset(licenses.PERMISSIVE))
    kinds = {"permissive" if last == "MIT" else "restricted", *(f"spdx:{n.lower()}" for n in names)}
    assert got[5] == sorted(kinds) and got[7] == [" ".join(licenses.parse(expression))]
    assert got[7][0].split().count("and") == 120


def test_tags_on_one_line():
    text = "SPDX-License-Identifier: MIT " + "some prose " * 60 + "SPDX-License-Identifier: ISC SPDX-License-Identifier: Zlib"
    got = licenses.scan_text(text, frozenset(licenses.PERMISSIVE))
    assert got[7] == ["mit", "isc", "zlib"]
