"""A table of odd documents, and an empty one."""

import pytest

DOCS = "doc_id long, text string, source string, __score string, node string"
TEXTS = [None, "", " ", "one", "one two", "One two", "the same words again and again here", "the same words again and again here", "日本 語 😀 text", "x" * 5000, "a\n\n  b\t c ", "mail me at a.b@c.de or +1 (743) 555-3824 now", "word " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "s1", "s2"][i % 3], "x", "y") for i, t in enumerate(TEXTS)] + [(None, "no id", "s1", "x", "y"), (4, TEXTS[4], "s2", "x", "y")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)
