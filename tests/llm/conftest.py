from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "a long text of many words " * 20_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, odd white space and characters."""
    base = [f"The quick brown fox number {k} jumps over the lazy dog and runs to the river bank.\nA line that all share, more or less." for k in range(8)]
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(base)]
    rows += [(20, None, None, None, None), (21, "", "en", "s1", 0), (22, " \t\x0b\x0c\r\n ", "en", "s1", 7), (23, LONG, "en", "s0", len(LONG)), (24, base[0], "en", None, 1), (24, base[0], "en", None, 1), (25, "é ß  ü\x85x ÀB", "fr", "é", 1), (26, "one", "en", "s0", 3), (27, "one two", "en", "s0", 7), (None, base[1], "en", "s0", 1), (28, "<|endoftext|> it's\n\n\n  a  'test' 12345 \U0001f600!!", "en", "", 1), (29, LONG, "en", "s2", 1), (30, base[2] + " x", "en", "s2", 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small_docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
