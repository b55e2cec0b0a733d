from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__
from quillon.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(rows, columns):
    """Rows as text, columns by name, numbers as doubles."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(x):
        if isinstance(x, bool) or x is None or isinstance(x, str):
            return x
        return "nan" if isinstance(x, float) and math.isnan(x) else str(x) if not isinstance(x, (int, float)) and not hasattr(x, "as_tuple") else float(x)

    return sorted(repr([one(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    want = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    rows = want.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert plain(got, df.columns) == plain(rows, columns)


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and set(registry.QUERIES) <= set(queries)


def test_nothing_else_imports_the_corpus_operators():
    root = os.path.dirname(__spark_entry__.__file__)
    for folder, _, names in os.walk(os.path.join(root, "quillon")):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(folder, n)) as f:
                        assert ".llm" not in f.read()
