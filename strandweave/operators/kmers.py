"""The k-mer index, held flat: one row an occurrence, since a frequent k-mer's list has no bound."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions.dna import kmer_hash
from strandweave.operators.ranking import first_per_key, with_ordinal

#: Leading bits of a hash by which k-mers are counted before a range of them is read.
CELL_BITS = 14


def explode_kmers(reads: DataFrame, k: int) -> DataFrame:
    """``(kmer, read_id, is_orig, pos)``: every window of ``k`` bases; reads shorter than ``k`` have none."""
    at = reads.where(F.length("seq") >= k).withColumn("pos", F.explode(F.sequence(F.lit(0), F.length("seq") - k)))
    return at.select(F.substring("seq", F.col("pos") + 1, F.lit(k)).alias("kmer"), "read_id", "is_orig", "pos")


def clean_occurrences(df: DataFrame) -> DataFrame:
    """Occurrences in upper case, with the strand of the read; rows with a null k-mer, read or position are left out."""
    rows = df.where("kmer is not null and read_id is not null and pos is not null")
    return rows.select(F.upper("kmer").alias("kmer"), "read_id", (F.col("read_id") % 2 == 0).alias("is_orig"), "pos", "block")


def dedupe(occurrences: DataFrame) -> DataFrame:
    """One occurrence of each k-mer a read: the first of an original read, the last of a reverse complement."""
    one = occurrences.groupBy("kmer", "read_id", "is_orig").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    return one.select("kmer", "read_id", F.when(F.col("is_orig"), F.col("lo")).otherwise(F.col("hi")).alias("pos"))


def index_counts(occurrences: DataFrame) -> DataFrame:
    """``(kmer, occ)`` of the index."""
    return occurrences.groupBy("kmer").agg(F.count("*").alias("occ"))


def with_order(df: DataFrame) -> DataFrame:
    """K-mers with ``khash``; the order of the index is (khash, kmer)."""
    return df.withColumn("khash", kmer_hash(F.col("kmer")))


def range_scan(index: DataFrame, first: int, end: int) -> DataFrame:
    """K-mers with ordinals ``first`` to ``end`` - 1 in the order of the index.

    K-mers are counted by the leading bits of their hash; only those of the cells that the range touches are
    read again, ranked, and numbered on from the count before them.
    """
    rows = with_order(index).withColumn("cell", F.shiftright("khash", 32 - CELL_BITS))
    sizes = [(r.cell, r["count"]) for r in rows.groupBy("cell").count().orderBy("cell").collect()]  # at most 2 ^ CELL_BITS
    ends = list(accumulate(n for _, n in sizes))
    cells = [(c, done - n) for (c, n), done in zip(sizes, ends, strict=True) if done > first and done - n < end]
    if not cells:
        return rows.drop("cell").withColumn("ordinal", F.lit(0).cast("long")).limit(0)
    some = rows.where(F.col("cell").between(cells[0][0], cells[-1][0])).drop("cell")
    numbered = with_ordinal(some, ["khash", "kmer"]).withColumn("ordinal", F.col("ordinal") + cells[0][1])
    return numbered.where((F.col("ordinal") >= first) & (F.col("ordinal") < end))


def bucket(df: DataFrame, n: int, first: int, end: int) -> DataFrame:
    """K-mers whose hash modulo ``n`` is in [first, end)."""
    return with_order(df).withColumn("bucket", F.col("khash") % n).where((F.col("bucket") >= first) & (F.col("bucket") < end))


def frequency_filter(occurrences: DataFrame, max_cov: int) -> DataFrame:
    """Occurrences of k-mers that are seen less than 3 * max_cov times; 0 keeps all.

    This is how overlap detection is defined: repeats are no evidence for an overlap.  Repeats are at most one in
    3 * max_cov k-mers, so their table is the small side.
    """
    if max_cov <= 0:
        return occurrences
    heavy = index_counts(occurrences).where(F.col("occ") >= 3 * max_cov)
    return occurrences.join(heavy.select("kmer"), "kmer", "left_anti")


def bin_cap(occurrences: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` occurrences of each k-mer by read and position; part of the index format."""
    return first_per_key(occurrences, ["kmer"], ["read_id", "pos"], cap)


def merge_indexes(*indexes: DataFrame) -> DataFrame:
    """The union of indexes ``(kmer, occ)``: counts of equal k-mers are added."""
    whole = indexes[0]
    for x in indexes[1:]:
        whole = whole.unionByName(x)
    return whole.groupBy("kmer").agg(F.sum("occ").alias("occ"))
