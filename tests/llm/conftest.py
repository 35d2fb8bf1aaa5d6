import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot string, block int, hi long, label int"

ODD_TEXTS = [
    None,
    "",
    " \t\n ",
    "one",
    "two words",
    "The quick brown fox jumps over the lazy dog. " * 3,
    "The quick brown fox jumps over the lazy dog. " * 3,
    "Licensed under CC BY-NC 4.0. All rights reserved. GNU General Public License, version 3.",
    "ÄÖÜ ñandú İstanbul     x\x0by 漢字 😀😀",
    "long " * 30000,
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, blank, short, repeated and very long texts, a repeated row, null sources, and columns with clashing names."""
    rows = [(i, t, "en", None if i % 4 == 3 else f"s{i % 3}", len(t or ""), 1, "x", 2, 3, 4) for i, t in enumerate(ODD_TEXTS)]
    return spark.createDataFrame([*rows, rows[5]], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
