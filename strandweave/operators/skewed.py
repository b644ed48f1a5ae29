"""Per-key results when a few keys hold most rows.

Rows are range-partitioned on (key, record, row number) at quantiles that Spark samples, so a heavy key
spans as many partitions as its share of the rows deserves, and even one repeated (key, record) is split.
Every partition is then one sorted run that is aggregated in a streaming pass.  A key that lies whole
inside a partition is finished there; only the first and the last key of a partition stay open, and those
at most two states a partition are stitched together.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweave.scratch import Scratch

#: Equal (key, record) rows may be split into as many ranges.
TIES = 1024
#: Rows of a range: the fewest, the most, and the number of ranges up to which they stay few.
FEW, MANY, RANGES = 1 << 18, 1 << 23, 10_000


def _runs(col: pa.Array) -> np.ndarray:
    """True where a value differs from the one before it (nulls are equal to each other)."""
    n = len(col)
    out = np.ones(n, bool)
    if n > 1:
        a, b = col.slice(1), col.slice(0, n - 1)
        same = pc.fill_null(pc.equal(a, b), False)
        both = pc.and_(pc.is_null(a), pc.is_null(b))
        out[1:] = ~pc.or_(same, both).to_numpy(zero_copy_only=False)
    return out


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One state per key of a sorted partition; the first and the last one are marked open."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held: dict | None = None  # the state of the last key so far
    first = True

    def emit(keys, rows, records, lo, hi, is_open):
        return pa.RecordBatch.from_arrays(
            [keys, pa.array(rows, pa.int64()), pa.array(records, pa.int64()), lo, hi, pa.array(is_open, pa.bool_()), pa.array(np.full(len(rows), part), pa.int32())],
            names=["key", "rows", "records", "first_record", "last_record", "open", "part"],
        )

    def one(s, is_open):
        return emit(pa.array([s["key"]], s["type"]), [s["rows"]], [s["records"]], pa.array([s["lo"]], s["rtype"]), pa.array([s["hi"]], s["rtype"]), [is_open])

    for b in batches:
        if not b.num_rows:
            continue
        key, rec = b.column(0), b.column(1)
        new_key = _runs(key)
        new_rec = (new_key | _runs(rec)) & rec.is_valid().to_numpy(zero_copy_only=False)
        at = np.flatnonzero(new_key)
        rows = np.diff(np.append(at, b.num_rows))
        records = np.add.reduceat(new_rec.astype(np.int64), at)
        last = np.append(at[1:], b.num_rows) - 1
        # nulls sort first within a key, so a run's first valid record is its first new one
        pos = np.where(new_rec, np.arange(b.num_rows), b.num_rows)
        lo_at = np.minimum.reduceat(pos, at)
        lo = rec.take(pa.array(np.where(lo_at < b.num_rows, lo_at, at), pa.int64()))
        hi = rec.take(pa.array(last, pa.int64()))
        keys = key.take(pa.array(at, pa.int64()))
        start = 0
        k0 = keys[0].as_py()
        if held is not None and k0 == held["key"]:
            held["rows"] += int(rows[0])
            held["records"] += int(records[0]) - int(held["hi"] is not None and held["hi"] == lo[0].as_py())
            held["lo"] = lo[0].as_py() if held["lo"] is None else held["lo"]
            held["hi"] = hi[0].as_py() if hi[0].as_py() is not None else held["hi"]
            start = 1
        if len(at) > start:
            if held is not None:
                yield one(held, first)
                first = False
            end = len(at) - 1
            if end > start:
                flag = np.zeros(end - start, bool)
                flag[0] = first
                first = False
                yield emit(keys.slice(start, end - start), rows[start:end], records[start:end], lo.slice(start, end - start), hi.slice(start, end - start), flag)
            held = {"key": keys[end].as_py(), "rows": int(rows[end]), "records": int(records[end]), "lo": lo[end].as_py(), "hi": hi[end].as_py(), "type": key.type, "rtype": rec.type}
    if held is not None:
        yield one(held, True)


def ranges(rows: int, least: int) -> int:
    """The number of ranges for so many rows."""
    return max(least, -(-rows // min(MANY, max(FEW, rows // RANGES))))


def key_counts(df: DataFrame, key: str, record: str, partitions: int | None = None) -> DataFrame:
    """``(key, rows, records)``: of every key its rows and distinct non-null records, evenly spread.

    A null key is a key of its own, a null record counts as a row but as no record; an empty table gives
    no rows; only the two named columns are read, so any further ones, whatever their names, are ignored.
    Repeated rows count as rows.  ``partitions`` defaults to what keeps a range small whatever the input:
    ranges of ``FEW`` rows, larger ones (up to ``MANY``) once there are ``RANGES``, and at least
    ``spark.sql.shuffle.partitions``.
    """
    spark = df.sparkSession
    n = partitions or ranges(df.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(F.col(key).alias("key"), F.col(record).alias("record"))
    kt, rt = rows.schema["key"].dataType, rows.schema["record"].dataType
    schema = T.StructType([
        T.StructField("key", kt), T.StructField("rows", T.LongType()), T.StructField("records", T.LongType()),
        T.StructField("first_record", rt), T.StructField("last_record", rt), T.StructField("open", T.BooleanType()), T.StructField("part", T.IntegerType()),
    ])
    ranged = (
        rows.withColumn("tie", (F.monotonically_increasing_id() % TIES).cast("short"))
        .repartitionByRange(n, "key", "record", "tie")
        .sortWithinPartitions("key", "record")
        .select("key", "record")
    )
    states = Scratch(spark, "key-counts").keep(ranged.mapInArrow(_partials, schema))
    closed = states.where(~F.col("open")).select("key", "rows", "records")
    # Open states: at most two a partition.  A record that ends one state and begins the next counts once.
    order = Window.partitionBy("key").orderBy("part")
    seen = F.last("last_record", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    stitched = (
        states.where("open")
        .withColumn("again", F.coalesce((seen == F.col("first_record")).cast("long"), F.lit(0)))
        .groupBy("key")
        .agg(F.sum("rows").alias("rows"), F.sum(F.col("records") - F.col("again")).alias("records"))
    )
    return closed.unionByName(stitched)


def heavy_keys(df: DataFrame, key: str, record: str, share: float = 0.01) -> DataFrame:
    """Keys of :func:`key_counts` with at least ``share`` of the rows whose key is not null."""
    counts = key_counts(df.where(F.col(key).isNotNull()), key, record)
    total = counts.agg(F.sum("rows")).first()[0] or 0
    part = Fraction(str(share))
    return counts.where(F.col("rows") * part.denominator >= F.lit(part.numerator * total))
