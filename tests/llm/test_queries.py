import os

import duckdb
import pytest

from strandweave.llm import queries


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, sf, name):
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rel = duck.execute(queries.ORACLES[name])
    have = [c[0] for c in rel.description]
    assert sorted(have) == cols
    want = sorted(repr(tuple(r[have.index(c)] for c in cols)) for r in rel.fetchall())
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == want


def test_queries_without_sql_are_tested_elsewhere():
    """By brute force or the library in test_similar.py and test_texts.py."""
    assert set(queries.QUERIES) - set(queries.ORACLES) == {"p5_clusters", "p7_ids", "p8_found", "p8_pieces", "p8_windows", "p9_classes", "p9_found", "p9_text"}
