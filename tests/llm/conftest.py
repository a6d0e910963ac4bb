from __future__ import annotations

import pytest

from oncolens.llm.common import ship

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def texts(spark):
    """Documents from texts: ids 0, 1, ... and two columns whose names operators use themselves."""

    def make(*values, ids=None):
        rows = [(k if ids is None else ids[k], t, "x", -1) for k, t in enumerate(values)]
        return spark.createDataFrame(rows, "doc_id long, text string, fp string, TEXT long")

    return make


LONG = " ".join(f"w{k}" for k in range(30_000))
ODD = [None, "", "  \n\t", "one", "One", "one two three four five", "one two three four five", LONG, LONG + " end", "é ß ñ 日本 x"]
