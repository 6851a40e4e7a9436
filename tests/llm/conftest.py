"""What the tests of this folder share."""

from __future__ import annotations

import pytest

from brooklet.llm.registry import prepare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def llm(spark):
    prepare(spark)
    return spark


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty, wordless and long texts, ties and repeats."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    return [(1, "a b c d e f g"), (2, None), (3, ""), (4, " .,;\n\t!"), (5, long), (5, long), (None, "no id here at all"), (7, "é ñ ß 漢字 🎉 é"), (8, "a b c d e f g")]


@pytest.fixture(scope="session")
def odd_docs(llm, odd_texts):
    """The odd texts with columns whose names operators use themselves."""
    rows = [(i, t, "x", k, None) for k, (i, t) in enumerate(odd_texts)]
    return llm.createDataFrame(rows, "doc_id long, text string, score string, n int, items string")
