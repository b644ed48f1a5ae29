import math

import pytest
from pyspark.sql import functions as F

from strandweave.functions import dna


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_revcomp_and_codes(spark):
    assert one(spark, dna.revcomp(F.lit("ACGTN")), dna.revcomp(F.lit("")), dna.revcomp(F.lit(None).cast("string"))) == ("NACGT", "", None)
    assert one(spark, *[dna.base_code(F.lit(c)) for c in "ACGTN_"]) == (0, 1, 2, 3, 4, 4)
    assert one(spark, dna.code_base(F.lit(2)), dna.code_base(F.lit(4))) == ("G", None)
    assert one(spark, dna.iupac(F.lit(3), F.lit(0)), dna.iupac(F.lit(1), F.lit(1))) == ("W", "C")


def test_kmer_hash_wraps(spark):
    def plain(k):
        return sum({"C": 1, "G": 2, "T": 3}.get(c, 0) << (2 * (i % 16)) for i, c in enumerate(k)) % (1 << 32)

    for k in ("", "ACGT", "T" * 40, "NNACGTNZ", "GATTACA" * 5):
        assert one(spark, dna.kmer_hash(F.lit(k)))[0] == plain(k)


def test_hamming(spark):
    rows = [("ACGT", "ACGA"), ("", ""), ("A", None), ("AC", "A"), ("NNN", "NNA")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r[0] for r in df.select(dna.hamming("a", "b")).collect()] == [1, 0, None, None, 1]


def test_k_rule_and_caps(spark):
    assert one(spark, dna.k_rule(150, 8000), dna.k_rule(36, 16000), dna.k_rule(36, 10**9)) == (30, 10, 18)
    assert one(spark, dna.coverage_caps(F.lit(9)), dna.coverage_caps(F.lit(0))) == (24, 3)


def test_arrays(spark):
    a = F.array(F.lit(1.0), F.lit(3.0))
    assert one(spark, dna.array_normalize(a), dna.array_normalize(F.array(F.lit(0.0)))) == ([0.25, 0.75], None)
    picks = one(spark, *[dna.weighted_pick(F.array(F.lit(0.25), F.lit(0.75)), F.lit(t)) for t in (0.0, 0.25, 0.99, 1.0)])
    assert picks == (0, 1, 1, -1)
    assert one(spark, dna.lgamma(F.lit(5.0)))[0] == pytest.approx(math.lgamma(5))


def test_log_gamma():
    import numpy as np

    x = np.concatenate([np.arange(1, 400.0), np.random.default_rng(1).random(500) * 40 + 1e-9, [1e5, 1e12, 1e300]])
    want = np.array([math.lgamma(v) for v in x])
    assert np.all(np.abs(dna.log_gamma(x) - want) <= 1e-13 * np.maximum(1, np.abs(want)) + 1e-13)
    assert list(dna.log_gamma(np.array([0.0, -3.0, np.inf]))) == [math.inf] * 3
