"""Column functions on bases, sequences and arrays."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASES = "ACGT"
#: The code letters of two different bases.
IUPAC = {"AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K"}
#: Bases after which the positions of the k-mer hash begin anew: 16 fill its 32 bits.
HASH_BASES = 16


def revcomp(seq: Column) -> Column:
    """Reverse complement of an upper-case sequence; N stays N.  Null for null."""
    return F.reverse(F.translate(seq, "ACGTN", "TGCAN"))


def base_code(base: Column) -> Column:
    """0 to 3 for A, C, G, T; 4 for anything else; null for null."""
    at = F.instr(F.lit(BASES), base)
    return F.when((F.length(base) == 1) & (at > 0), at - 1).when(base.isNotNull(), F.lit(4))


def code_base(code: Column) -> Column:
    """The base of a code from 0 to 3; null for any other code."""
    return F.when(code.between(0, 3), F.substring(F.lit(BASES), code.cast("int") + 1, F.lit(1)))


def is_any_base(code: Column) -> Column:
    """True for a code that is no particular base."""
    return code >= 4


def iupac(code1: Column, code2: Column) -> Column:
    """The letter of a genotype of two base codes, in either order."""
    pair = F.concat(code_base(F.least(code1, code2)), code_base(F.greatest(code1, code2)))
    named = F.create_map(*[F.lit(x) for kv in IUPAC.items() for x in kv])
    return F.when(code1 == code2, code_base(code1)).otherwise(named[pair])


def kmer_hash(kmer: Column) -> Column:
    """The 32-bit hash of a k-mer over A, C, G, T, N: base codes as two-bit digits, the first one lowest,
    that begin anew after 16 bases; N counts 0.

    Every 16 bases are one number to the base 4, so a k-mer takes a few conversions, not one a base.
    """
    digits = F.translate(kmer, "ACGTNZ", "012300")
    parts = F.transform(
        F.sequence(F.lit(0), F.floor(F.greatest(F.length(kmer) - 1, F.lit(0)) / HASH_BASES).cast("int")),
        lambda i: F.coalesce(F.conv(F.reverse(F.substring(digits, i * HASH_BASES + 1, F.lit(HASH_BASES))), 4, 10).cast("long"), F.lit(0).cast("long")),
    )
    return F.pmod(F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(1 << 32).cast("long"))


@F.arrow_udf(T.IntegerType())
def hamming(a: pa.Array, b: pa.Array) -> pa.Array:
    """Differing positions of two ASCII strings of one length; null if either is null or lengths differ."""
    a, b = a.cast(pa.large_binary()), b.cast(pa.large_binary())
    n = len(a)
    (_, oa, da), (_, ob, db) = a.buffers(), b.buffers()
    oa, ob = np.frombuffer(oa, np.int64)[a.offset : a.offset + n + 1], np.frombuffer(ob, np.int64)[b.offset : b.offset + n + 1]
    la, lb = np.diff(oa), np.diff(ob)
    ok = (la == lb) & a.is_valid().to_numpy(zero_copy_only=False) & b.is_valid().to_numpy(zero_copy_only=False)
    size = np.where(ok, la, 0)
    end = np.cumsum(size)
    step = np.arange(end[-1] if n else 0) - np.repeat(end - size, size)
    da, db = (np.frombuffer(d, np.uint8) if d is not None else np.zeros(0, np.uint8) for d in (da, db))
    differ = da[np.repeat(oa[:-1], size) + step] != db[np.repeat(ob[:-1], size) + step]
    total = np.concatenate([[0], np.cumsum(differ)])
    return pa.array((total[end] - total[end - size]).astype(np.int32), mask=~ok)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function; infinite at zero and below.

    Arguments are raised to 8 or more by its recurrence, where eight terms of Stirling's series are exact to doubles.
    """
    x = np.asarray(x, float)
    up = np.where((x > 0) & (x < 8), np.ceil(8 - np.minimum(x, 8)), 0)
    z = np.where(x > 0, x + up, 8.0)
    product = np.ones_like(z)
    for k in range(8):
        product *= np.where(k < up, x + k, 1.0)
    i = 1 / (z * z)
    tail = 1 / 12 - i * (1 / 360 - i * (1 / 1260 - i * (1 / 1680 - i * (1 / 1188 - i * (691 / 360360 - i / 156)))))
    with np.errstate(invalid="ignore"):
        value = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + tail / z - np.log(product)
    return np.where(np.isnan(x), np.nan, np.where(x <= 0, np.inf, np.where(np.isinf(x), np.inf, value)))


@F.arrow_udf(T.DoubleType())
def lgamma(x: pa.Array) -> pa.Array:
    """:func:`log_gamma` of a column; null for null."""
    return pa.array(log_gamma(x.fill_null(1.0).to_numpy(zero_copy_only=False)), mask=x.is_null().to_numpy(zero_copy_only=False))


def rounded(x: Column, digits: int) -> Column:
    """``x`` to so many digits, halves away from 0, in plain arithmetic on doubles (below 2^63 / 10^digits), which is
    many times faster than the exact decimals of ``round``."""
    return F.signum(x) * F.floor(F.abs(x) * 10.0**digits + 0.5) / 10.0**digits


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def array_normalize(a: Column) -> Column:
    """An array divided by its sum; null where the sum is 0."""
    total = array_sum(a)
    return F.when(total != 0, F.transform(a, lambda x: x / total))


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns alone: the first eight hex digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, 8), 16, 10).cast("double") / float(1 << 32)


def weighted_pick(weights: Column, t: Column) -> Column:
    """The first index at which the running sum of the weights passes ``t``; -1 if it never does."""
    running = F.aggregate(
        weights,
        F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("i"), F.lit(-1).alias("at")),
        lambda s, x: F.struct(
            (s["sum"] + x).alias("sum"), (s["i"] + 1).alias("i"), F.when((s["at"] < 0) & (t < s["sum"] + x), s["i"]).otherwise(s["at"]).alias("at")
        ),
    )
    return running["at"]


def bernoulli(p: float | Column, *key: Column) -> Column:
    """True with probability ``p``, decided by the key columns."""
    return unit_hash(*key) < p


def k_rule(max_len: Column | int, n_reads: Column | int, part: int = 5) -> Column:
    """The k-mer length for reads of both strands: a fifth (``part``) of the longest, or what makes k-mers
    of all bases rare, whichever is greater."""
    max_len, n_reads = ((c if isinstance(c, Column) else F.lit(c)).cast("double") for c in (max_len, n_reads))
    return F.greatest(F.floor(max_len / part), F.ceil(F.round(F.log(n_reads * max_len) / math.log(4), 9))).cast("int")


def coverage_caps(cov: Column) -> Column:
    """The greatest number of votes that is believed at a coverage: five deviations above it, at least 3."""
    return F.greatest(F.lit(3), F.ceil(F.round(cov + 5 * F.sqrt(cov), 9)).cast("int"))
