"""Occurrence and record counts of every distinct term, by burst tries that workers merge.

1. A bounded sample of the terms grows an access trie whose leaves are the adaptive prefixes: a prefix is
   extended until few enough sampled terms lie below it.  It decides only where counters meet.
2. Spark groups rows by (term, record), with a combine before the shuffle, so a frequent term, or a record
   with very many terms, is spread evenly.
3. Each task counts its pairs in a burst trie and emits one front-coded subtree a prefix.  A frequent term
   is by now one entry a task.
4. Subtrees of one prefix meet in one task and are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.burst_trie import SCHEMA, BurstTrie, combine, cut, flat, pack, unpack

#: Terms in the sample that chooses the prefixes; it affects only how evenly the work is spread.
PLAN_TERMS = 40_000
#: Pairs that a task gathers before it sorts them into its trie.
CHUNK = 1 << 19


def prefixes(terms: list[bytes], leaves: int) -> list[bytes]:
    """Lower bounds of about ``leaves`` prefixes: those of a burst trie over the sampled terms."""
    trie = BurstTrie(max(1, len(terms) // max(1, leaves)))
    ones = np.ones(len(terms), np.int64)
    t = pa.table([pa.array(terms, pa.large_binary()), ones, ones], schema=SCHEMA)
    trie.insert(combine(t))
    return sorted({b"", *(p for p, _ in trie.leaves())})


def _grow(bounds: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held, n = BurstTrie(), [], 0

        def flush():
            nonlocal held, n
            if held:
                trie.insert(combine(pa.concat_tables(held)))
            held, n = [], 0

        for b in batches:
            term = pc.cast(b.column(0), pa.large_binary())
            held.append(pa.table([term, b.column(2), pc.cast(b.column(1), pa.int64())], schema=SCHEMA))
            n += b.num_rows
            if n >= CHUNK:
                flush()
        flush()
        parts: dict[int, list[pa.Table]] = {}
        for _, t in trie.leaves():
            for leaf, part in cut(t, bounds):
                parts.setdefault(leaf, []).append(part)
        for leaf, ts in parts.items():  # leaves come in order, so their tables join to a sorted one
            row = pack(pa.concat_tables(ts).combine_chunks())
            yield pa.RecordBatch.from_pydict({"leaf": pa.array([leaf], pa.int32()), **{k: pa.array([v], pa.binary()) for k, v in row.items()}})

    return run


def _merge(t: pa.Table) -> pa.Table:
    trie = BurstTrie()
    for row in t.to_pylist():
        trie.insert(unpack(row["shared"], row["rest"], row["bytes"], row["occurrences"], row["records"]))
    out = pa.concat_tables([x for _, x in trie.leaves()])
    return out.set_column(0, "term", pc.cast(pc.cast(out["term"], pa.large_string()), pa.string()))


def _pairs(df: DataFrame, term: str, record: str) -> DataFrame:
    """``(term, record, n)``: each distinct pair and its rows."""
    rows = df.select(F.col(term).alias("term"), F.col(record).alias("record")).where(F.col("term").isNotNull())
    return rows.groupBy("term", "record").agg(F.count("*").alias("n"))


def _counts(df: DataFrame, pairs: DataFrame, term: str, leaves: int | None) -> DataFrame:
    spark = df.sparkSession
    leaves = leaves or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = df.count()  # from file metadata where the source has it
    few = df.select(F.substring(term, 1, 256).alias("term")).where("term is not null").sample(min(1.0, PLAN_TERMS / max(n, 1)), seed=7).distinct().limit(2 * PLAN_TERMS)
    bounds = prefixes([r[0].encode() for r in few.collect()], leaves)
    trees = pairs.select("term", F.col("record").isNotNull().cast("long").alias("one"), "n").mapInArrow(
        _grow(bounds), "leaf int, shared binary, rest binary, bytes binary, occurrences binary, records binary"
    )
    return trees.groupBy("leaf").applyInArrow(_merge, "term string, occurrences long, records long")


def term_counts(df: DataFrame, term: str, record: str, leaves: int | None = None) -> DataFrame:
    """``(term, occurrences, records)``: rows of every distinct term and its distinct non-null records.

    Null terms are left out; an empty term is a term; terms of any length are counted whole; a null record
    adds an occurrence but no record; repeated rows are occurrences; an empty table gives no rows.  Only the
    two named columns are read, so further columns may have any name.  ``leaves`` is the number of prefixes,
    by default four a shuffle partition.
    """
    return _counts(df, _pairs(df, term, record), term, leaves)


def marked(df: DataFrame, term: str, record: str, common: float = 0.01, least: int = 2) -> DataFrame:
    """:func:`term_counts` with ``mark``: ``common`` from the share ``common`` of all records on, ``rare``
    below ``least`` records, else null.  All records are those of rows with a term; without any record no
    term is common."""
    pairs = _pairs(df, term, record)
    # the shuffle of the pairs is the same as that of the counts and is reused; ``n`` keeps its columns the same
    total = pairs.agg(F.countDistinct(F.when(F.col("n") > 0, F.col("record"))).alias("total"))
    counts = _counts(df, pairs, term, None)
    part = Fraction(str(common))
    often = (F.col("records") > 0) & (F.col("records") * part.denominator >= F.col("total") * part.numerator)
    return counts.withColumn("total", total.scalar()).withColumn("mark", F.when(often, "common").when(F.col("records") < least, "rare")).drop("total")
