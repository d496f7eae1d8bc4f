from __future__ import annotations

import pytest

#: doc_id null, repeated rows, null and empty texts, white space only, clashing column names.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, name string, row long"


@pytest.fixture(scope="session")
def documents(spark):
    def make(rows):
        full = [(i, t, "en", s, None, 1, "x", 7) for i, t, s in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


AWKWARD = [
    (1, "a b c d", "s"), (2, "a b c d", "s"), (2, "a b c d", "s"), (3, None, None), (4, "", "s"), (5, " \t\n ", "t"), (None, "a b c d", "t"), (None, None, None),
    (6, "x " * 3000, "s"), (7, "x " * 3000 + "y", "s"), (8, "é 日本 \U0001f600", "t"), (9, "a  b\tc\nd", None),
]


@pytest.fixture(scope="session")
def awkward(documents):
    return documents(AWKWARD)


@pytest.fixture(scope="session")
def nothing(documents):
    return documents([])
