import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gone_id string, `row` string, copies int, size int, fp string"
WORDS = "alpha beta gamma delta omega sigma kappa theta lambda river stone cloud forest winter summer garden letter number silver copper".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, a very long text, repeated rows, copies, and clashing columns."""
    rows = [(i, prose(i, 30 + i), "en", f"s{i % 3}", 1, "x", "y", 7, 8, "z") for i in range(40)]
    rows += [(100, prose(1, 31), "en", None, None, None, None, None, None, None), (101, None, None, "s0", None, None, None, None, None, None)]
    rows += [(102, "", "en", "s1", 0, None, None, None, None, None), (103, " \t\n ", "en", "s2", 3, None, None, None, None, None)]
    rows += [(104, prose(7, 60_000), "en", "s0", 9, None, None, None, None, None), (None, "Some text without an id", "en", "s1", 9, None, None, None, None, None)]
    rows += [(105, "one two", "en", "s1", 7, None, None, None, None, None), rows[3], rows[3], (106, "é ß 漢字 <|endoftext|> don't 12", "de", "s2", 1, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, int(i % 2), int(i % 4 == 1)) for i in range(40)] + [(100, None, None), (None, 1, 1), (999, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
