"""Every core query with SQL against that SQL on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from strandweave.operators import overlaps
from strandweave.plans import base, registry
from strandweave.plans.params import E, H

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def normal(rows, cols):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rel = duck.execute(registry.oracles()[name])
    cols = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(cols)
    assert normal(map(tuple, df.collect()), df.columns) == normal(rel.fetchall(), cols)


def test_queries_without_sql(spark):
    """They have definite results of their own, beside the brute-force tests of their operators."""
    assert set(registry.queries()) - set(registry.oracles()) == {"em_confusion", "cluster_neighbors", "cluster_semi_join", "correct"}
    table = registry.queries()["em_confusion"](spark, SF)
    at = table.groupBy("pos", "called_b").agg(F.count("*").alias("n"), F.sum("w").alias("w")).collect()
    assert all(r.n == 4 and r.w > 0 for r in at) and {r.called_b for r in at} == {0, 1, 2, 3}
    brothers = spark.read.parquet(f"{SF}/brothers.parquet").where("seq is not null and target_id is not null and read_id is not null")
    pairs = {tuple(r) for r in brothers.select("target_id", "read_id").distinct().collect()}
    kept = [tuple(r) for r in registry.queries()["cluster_neighbors"](spark, SF).collect()]
    assert len(kept) == len(set(kept)) and set(kept) <= pairs
    assert {t for t, _ in kept} == {t for t, _ in pairs} and {(t, r) for t, r in pairs if t == r} <= set(kept)
    edges = {tuple(r) for r in overlaps.refilter(base.edges(spark, SF), H, E).select("r1", "r2", "offs", "nerr").collect()}
    within = [tuple(r) for r in registry.queries()["cluster_semi_join"](spark, SF).collect()]
    assert len(within) == len(set(within)) and set(within) <= edges and {e for e in edges if e[0] == e[1] and e[0] % 2 == 0} <= set(within)
