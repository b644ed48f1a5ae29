"""Filling fixed-capacity windows by sum-of-squares online packing.

Each task places its documents as they come.  It tracks how many open windows stand at every fill level and
puts a document where the sum of the squares of these numbers grows least, or in a new window.  A document
of more than a window fills whole windows of its own; what is left over is placed like any other item.
Windows still open at the end of a task are items of a second round in which the tasks of a few partitions
are packed together; only these few leftovers are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweave.scratch import Scratch

#: Partitions whose leftover windows are packed together.
FAN_IN = 32


class Levels:
    """Open windows by fill level, placed by the sum of squares."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.windows: list[list[int]] = [[] for _ in range(capacity)]
        self.made = 0

    def place(self, size: int) -> tuple[int, int, bool]:
        """``(window, start, full)`` for an item of 1 to ``capacity``."""
        c, cap = self.count, self.capacity
        fills = np.flatnonzero(c[: cap - size + 1])
        best, gain = 0, 2 * c[size] + 1 if size < cap else 0
        if len(fills):
            after = fills + size
            d = np.where(after < cap, 2 * c[np.minimum(after, cap)] + 1, 0) - 2 * c[fills] + 1
            k = len(d) - 1 - int(np.argmin(d[::-1]))  # of equal ones the fullest
            if d[k] <= gain:
                best = int(fills[k])
        if best:
            window = self.windows[best].pop()
            c[best] -= 1
        else:
            window, self.made = self.made, self.made + 1
        end = best + size
        if end < cap:
            c[end] += 1
            self.windows[end].append(window)
        return window, best, end == cap


_SCHEMA = "piece int, first long, tokens long, window long, start long"


def _pack(key: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        levels, open_rows = Levels(capacity), {}

        def out(rows, still_open):
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [None, pa.int32(), *[pa.int64()] * 4]
            arrays = [pa.array(cols[0], kind), *(pa.array(c, t) for c, t in zip(cols[1:], types[1:], strict=True))]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([still_open] * len(rows), pa.bool_())], names=[key, "piece", "first", "tokens", "window", "start", "open"])

        kind = None
        for b in batches:
            kind = b.column(0).type
            closed = []
            for k, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not size:
                    closed.append((k, 0, 0, 0, None, None))
                    continue
                for piece, first in enumerate(range(0, size, capacity)):
                    n = min(capacity, size - first)
                    w, start, full = levels.place(n)
                    row = (k, piece, first, n, base + w, start)
                    if full:
                        closed.extend(open_rows.pop(w, []))
                        closed.append(row)
                    else:
                        open_rows.setdefault(w, []).append(row)
            if closed:
                yield out(closed, False)
        if open_rows:
            yield out([r for rows in open_rows.values() for r in rows], True)

    return run


def _repack(key: str, capacity: int):
    def run(t: pa.Table) -> pa.Table:
        """Whole windows as items, the fullest first; a window takes the id of the first one put in it."""
        w, n = t["window"].to_numpy(), t["tokens"].to_numpy()
        ids, at = np.unique(w, return_inverse=True)
        fill = np.bincount(at, n).astype(np.int64)
        levels, name = Levels(capacity), {}
        new, shift = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for i in np.lexsort((ids, -fill)):
            window, start, _ = levels.place(int(fill[i]))
            new[i], shift[i] = name.setdefault(window, ids[i]), start
        t = t.set_column(t.column_names.index("window"), "window", pa.array(new[at]))
        return t.set_column(t.column_names.index("start"), "start", pa.array(t["start"].to_numpy() + shift[at])).drop_columns(["open", "packed_with"])

    return run


def pack(df: DataFrame, key: str, size: str, capacity: int = 4096) -> DataFrame:
    """``(key, piece, first, tokens, window, start)``: where every token of every document stands.

    A document of at most ``capacity`` is one piece (0); a longer one is cut into pieces of ``capacity``
    and a rest, ``first`` is a piece's first token.  ``start`` is its place in ``window``.  A document
    without tokens, of null or negative size, is one row with no window.  Repeated rows are documents of
    their own; only the two named columns are read; an empty table gives no rows.
    """
    rows = df.select(F.col(key), F.greatest(F.col(size).cast("long"), F.lit(0)).alias("size"))
    kind = rows.schema[key]
    schema = T.StructType([kind, *T._parse_datatype_string(_SCHEMA).fields])
    first = Scratch(df.sparkSession, "packing").keep(rows.mapInArrow(_pack(key, capacity), T.StructType([*schema.fields, T.StructField("open", T.BooleanType())])))
    left = first.where("open").withColumn("packed_with", F.shiftright("window", 32) / FAN_IN)
    left = left.withColumn("packed_with", F.floor("packed_with")).groupBy("packed_with").applyInArrow(_repack(key, capacity), schema)
    return first.where("not open").drop("open").unionByName(left)


def windows(packed: DataFrame) -> DataFrame:
    """``(window, pieces, tokens)`` of every window."""
    return packed.where("window is not null").groupBy("window").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"))
