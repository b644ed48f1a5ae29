"""The most frequent values in bounded memory, by combinatorial group testing.

A sketch has ``depth`` rows of ``width`` buckets.  A bucket counts the items that hash to it and, for every
bit of an item's 64-bit (or shorter) key, those that have the bit set.  In a bucket where one value holds
the majority, the majority of each bit spells that value.  Sketches of tasks add up, so tasks send one
sketch each whatever the number of distinct values.  A second pass counts the decoded candidates exactly.

What the counted candidates leave in the buckets tells whether a value can still be missing: it would leave
the share in one bucket of every row.  Then the values in such buckets alone are sketched again with other hash
functions, until none is left, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.scratch import Scratch

#: Odd multipliers of the rows' hash functions (fixed values), as many as there may be rows.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Sketches after the first one have up to so many times 2 the buckets; more than TURNS are an error.
WIDER, TURNS = 4, 32


def _bucket(keys: np.ndarray, row: int, log_width: int, turn: int = 0) -> np.ndarray:
    mixer = np.uint64(MULTIPLIERS[row] * (2 * turn + 1) % (1 << 64))
    h = keys ^ (keys >> np.uint64(33))
    h = h * mixer
    h = (h ^ (h >> np.uint64(29))) * mixer
    return (h >> np.uint64(64 - log_width)).astype(np.int64)


class Suspects:
    """Keys that may still be missing: not counted yet, and in a bucket with too much left in every row so far."""

    def __init__(self):
        self.known = np.zeros(0, np.uint64)
        self.marks: list[tuple[int, int, np.ndarray]] = []  # turn, log_width, marked buckets by row

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        on = ~np.isin(keys, self.known)
        for turn, log_width, marked in self.marks:
            for r in range(len(marked)):
                on &= marked[r][_bucket(keys, r, log_width, turn)]
        return on


def _sketch(bits: int, depth: int, log_width: int, turn: int, suspects: Suspects):
    width = 1 << log_width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((depth, width))
        ones = np.zeros((bits, depth, width))
        held, n, any_row = [], 0, False

        def flush():
            nonlocal held, n
            if not held:
                return
            keys, cnt = np.unique(np.concatenate(held), return_counts=True)
            held, n = [], 0
            if turn:
                on = suspects(keys)
                keys, cnt = keys[on], cnt[on]
            cnt = cnt.astype(float)
            at = [_bucket(keys, r, log_width, turn) for r in range(depth)]
            for r in range(depth):
                total[r] += np.bincount(at[r], cnt, width)
            for b in range(bits):
                on = np.flatnonzero((keys >> np.uint64(b)) & np.uint64(1))
                c = cnt[on]
                for r in range(depth):
                    ones[b, r] += np.bincount(at[r][on], c, width)

        for x in batches:
            if x.num_rows:
                any_row = True
                held.append(x.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                n += x.num_rows
                if n >= 1 << 20:
                    flush()
        flush()
        if any_row:
            r, b = np.nonzero(total)
            cols = [pa.array(r, pa.int32()), pa.array(b, pa.int32()), pa.array(total[r, b].astype(np.int64))]
            cols += [pa.array(ones[k, r, b].astype(np.int64)) for k in range(bits)]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "bucket", "total", *(f"b{k}" for k in range(bits))])

    return run


def _genuine(log_width: int, turn: int, suspects: Suspects):
    """Keeps decoded keys that hash to the bucket they come from, and suspects only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            row, bucket, key = (x.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            keys = key.astype(np.int64).view(np.uint64)
            on = suspects(keys)
            for r in np.unique(row):
                on &= (row != r) | (_bucket(keys, int(r), log_width, turn) == bucket)
            yield pa.RecordBatch.from_arrays([pa.array(key[on], pa.int64())], names=["key"])

    return run


def sketched(keys: DataFrame, bits: int, depth: int, log_width: int, turn: int, suspects: Suspects) -> DataFrame:
    """``(row, bucket, total, b0, b1, ...)``: the sketch of all rows, at most depth * width rows."""
    names = [f"b{k}" for k in range(bits)]
    parts = keys.mapInArrow(_sketch(bits, depth, log_width, turn, suspects), "row int, bucket int, total long, " + ", ".join(f"{x} long" for x in names))
    return parts.groupBy("row", "bucket").agg(F.sum("total").alias("total"), *(F.sum(x).alias(x) for x in names))


def decoded(sketch: DataFrame, bits: int, least: int, log_width: int, turn: int, suspects: Suspects) -> DataFrame:
    """``key``: values spelt by the buckets with at least ``least`` items, at most depth * width of them."""
    key = F.lit(0).cast("long")
    for k in range(bits):
        bit = F.shiftleft(F.lit(1).cast("long"), k) if k < 63 else F.lit(-(1 << 63)).cast("long")
        key = key.bitwiseOR(F.when(F.col(f"b{k}") * 2 > F.col("total"), bit).otherwise(F.lit(0).cast("long")))
    spelt = sketch.where(F.col("total") >= least).select("row", "bucket", key.alias("key"))
    return spelt.mapInArrow(_genuine(log_width, turn, suspects), "key long").distinct()


def frequent(df: DataFrame, column: str, share: float, modulus: int | None = None, depth: int = 4, log_width: int | None = None) -> DataFrame:
    """``(value, n)``: every value held by at least ``share`` of the rows with a non-null value, and its count.

    ``modulus`` folds a whole-number column to 0 .. modulus - 1 first (a power of two; its bits are the
    key), any other column is sketched by its 64-bit hash.  The sketch finds the candidates, the second
    pass verifies them, so the counts are exact and nothing below the share is returned; values that no
    bucket spells are looked for in further sketches, so none is missed.  ``log_width`` defaults to ten buckets
    for each value that could reach the share.  Nulls are left out, empty strings and repeated
    rows count, ties are all kept, an empty table gives no rows; further columns are not read.
    """
    value = F.col(column)
    if modulus:
        value = F.pmod(value.cast("long"), F.lit(modulus).cast("long"))
    rows = df.select(value.alias("value")).where(F.col("value").isNotNull())
    bits = (modulus - 1).bit_length() if modulus else 64
    keyed = rows.withColumn("key", F.col("value") if modulus else F.xxhash64("value"))
    part = Fraction(str(share)) if isinstance(share, float) else Fraction(share)
    log_width = log_width or max(8, int(10 / part).bit_length())
    scratch, suspects, least, found = Scratch(df.sparkSession, "sketch"), Suspects(), 1, None
    for turn in range(TURNS):
        wide = log_width + min(turn, WIDER)
        sketch = scratch.keep(sketched(keyed.select("key"), bits, depth, wide, turn, suspects))
        # depth * width numbers at most, as the counted candidates below
        totals = sketch.select("row", "bucket", "total").toArrow()
        row, bucket, total = (totals[c].to_numpy() for c in ("row", "bucket", "total"))
        if not turn:
            n = int(total[row == 0].sum())
            least = max(1, -(-part.numerator * n // part.denominator))
        # at most depth * width candidates, so the broadcast has a fixed bound
        some = F.broadcast(decoded(sketch, bits, least, wide, turn, suspects))
        counted = scratch.keep(keyed.join(some, "key", "left_semi").groupBy("key", "value").agg(F.count("*").alias("n")))
        found = counted if found is None else found.unionByName(counted)
        per_key = counted.groupBy("key").agg(F.sum("n").alias("n")).toArrow()
        keys = per_key["key"].to_numpy().view(np.uint64)
        left = np.zeros((depth, 1 << wide))
        left[row, bucket] = total
        for r in range(depth):
            np.subtract.at(left[r], _bucket(keys, r, wide, turn), per_key["n"].to_numpy())
        if not (left >= least).any(axis=1).all():  # a missing value would show in every row
            return found.where(F.col("n") >= least).select("value", "n")
        suspects.known = np.union1d(suspects.known, keys)
        suspects.marks.append((turn, wide, left >= least))
    raise RuntimeError(f"values at the share are not told apart after {TURNS} sketches")
