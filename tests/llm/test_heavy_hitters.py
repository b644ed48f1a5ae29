import random
from collections import Counter
from fractions import Fraction

from strandweave.llm.heavy_hitters import frequent


def test_against_counts(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(1 << 40),) for _ in range(20_000)] + [(v,) for k in range(1, 60) for v in [-k * 7919] * (k * 10)] + [(None,)] * 500
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "hash long").repartition(7)
    n = Counter(v % (1 << 32) for (v,) in rows if v is not None)
    total = sum(n.values())
    got = {r.value: r.n for r in frequent(df, "hash", Fraction(1, 400), modulus=1 << 32).collect()}
    assert got == {v: c for v, c in n.items() if c * 400 >= total} and len(got) > 30


def test_strings_ties_and_clashing_names(spark):
    rows = [(w, 1, 2) for w in ["", "a", "b" * 10_000] for _ in range(100)] + [(f"w{i}", 1, 2) for i in range(700)] + [(None, 1, 2)] * 900
    df = spark.createDataFrame(rows, "value string, key long, n long")
    assert {(r.value, r.n) for r in frequent(df, "value", Fraction(1, 10)).collect()} == {("", 100), ("a", 100), ("b" * 10_000, 100)}
    assert frequent(df, "value", Fraction(101, 1000)).collect() == []


def test_empty_table_and_only_nulls(spark):
    assert frequent(spark.createDataFrame([], "hash long"), "hash", Fraction(1, 400), modulus=1 << 32).collect() == []
    assert frequent(spark.createDataFrame([(None,)] * 5, "hash long"), "hash", Fraction(1, 400), modulus=1 << 32).collect() == []


def test_one_value(spark):
    assert [tuple(r) for r in frequent(spark.createDataFrame([(-1,)] * 50, "hash long"), "hash", Fraction(1, 2), modulus=1 << 32).collect()] == [((1 << 32) - 1, 50)]


def test_values_that_the_first_sketch_cannot_tell_apart(spark):
    """Far more heavy values than buckets, all alike: later sketches find what the first one misses."""
    rows = [(f"v{i}",) for i in range(120) for _ in range(20)] + [(f"w{i}",) for i in range(3000)]
    df = spark.createDataFrame(rows, "value string").repartition(5)
    got = {(r.value, r.n) for r in frequent(df, "value", Fraction(1, 400), depth=2, log_width=6).collect()}
    assert got == {(f"v{i}", 20) for i in range(120)}
