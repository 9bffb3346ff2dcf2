import os

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    long = "word and other " * 40_000
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, "one", "en", None), (5, long, "en", "b"), (5, long, "en", "b"), (None, "no id here at all", "de", "b"), (7, "one", "en", "a"), (8, "12 34 %%", None, "c"), (9, "é ß ñ", "fr", "c")]
    df = spark.createDataFrame([(*r, 1, 2, 3, "x", 4, 5) for r in rows], "doc_id long, text string, lang string, source string, shard int, slot int, size int, record string, id int, copies int")
    return df


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
