import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ta", "re", "no", "li", "mu", "és", "ku"]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, very long, repeated, and characters of all lengths."""
    long = prose(1, 20_000)
    return [None, "", " \n\t ", "a", "Aé日😀 x\x1cy\x85z", long, long, prose(2, 300), prose(2, 300), "'s 12 34!!  \r\n tail ", "x" * 50_000]


@pytest.fixture(scope="session")
def docs(spark, odd_texts):
    rows = [(i, t, None, "text", None) for i, t in enumerate(odd_texts)] + [(3, "a", None, None, None)]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)
