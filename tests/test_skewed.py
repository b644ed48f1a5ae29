import random
from collections import defaultdict

import pytest

from strandweave.operators.skewed import heavy_keys, key_counts

SCHEMA = "key string, record long, rows string, part string"


def brute(rows):
    n, seen = defaultdict(int), defaultdict(set)
    for k, r, *_ in rows:
        n[k] += 1
        if r is not None:
            seen[k].add(r)
    return {k: (n[k], len(seen[k])) for k in n}


def counted(df, partitions):
    return {r.key: (r.rows, r.records) for r in key_counts(df, "key", "record", partitions).collect()}


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_heavy_key_spans_partitions(spark, partitions):
    rng = random.Random(partitions)
    rows = [("hot", rng.randrange(50), "x", "y") for _ in range(3000)] + [(rng.choice(["a", "b", None, ""]), rng.choice([None, 1, 2, 3]), "x", "y") for _ in range(500)]
    rows += [("hot", None, "x", "y")] * 300 + [("same", 7, "x", "y")] * 2000 + [("null records", None, "x", "y")] * 9
    rng.shuffle(rows)
    assert counted(spark.createDataFrame(rows, SCHEMA).repartition(5), partitions) == brute(rows)


def test_key_is_split(spark):
    """One key and one record: no partition of the range exchange gets all of it."""
    df = spark.createDataFrame([("k", 1)] * 4000, "key string, record long").repartition(4)
    from pyspark.sql import functions as F

    ranged = df.withColumn("tie", (F.monotonically_increasing_id() % 1024).cast("short")).repartitionByRange(8, "key", "record", "tie")
    sizes = [r["count"] for r in ranged.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 2000
    assert counted(df, 8) == {"k": (4000, 1)}


def test_empty_and_long(spark):
    assert counted(spark.createDataFrame([], SCHEMA), 4) == {}
    long = "x" * 200_000
    assert counted(spark.createDataFrame([(long, 1, "", ""), (long, 2, "", ""), (long + "y", 1, "", "")], SCHEMA), 4) == {long: (2, 2), long + "y": (1, 1)}


def test_heavy_keys_at_the_share(spark):
    rows = [("a", 1)] * 10 + [("b", 1)] * 9 + [(None, 1)] * 500 + [(f"c{i}", 1) for i in range(81)]
    assert {r.key for r in heavy_keys(spark.createDataFrame(rows, "key string, record long"), "key", "record", 0.1).collect()} == {"a"}
    assert heavy_keys(spark.createDataFrame([], "key string, record long"), "key", "record").count() == 0
