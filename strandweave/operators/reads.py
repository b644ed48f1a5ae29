"""The read store: clean reads, both strands, and figures over all reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions.dna import revcomp


def clean_reads(df: DataFrame) -> DataFrame:
    """``(read_id, src_row, is_orig, seq, len)``: the latest load of each read, in upper case.

    Rows without an id or a sequence are left out; a read's row number is the greatest one loaded.
    """
    rows = df.where("read_id is not null and seq is not null")
    one = rows.groupBy("read_id").agg(F.max("src_row").alias("src_row"), F.max("is_orig").alias("is_orig"), F.max_by(F.upper("seq"), "loaded_at").alias("seq"))
    return one.withColumn("len", F.length("seq"))


def both_strands(reads: DataFrame) -> DataFrame:
    """Every original ``(src_row, seq)`` as two rows: id 2 n as it is and 2 n + 1 reverse-complemented."""
    strands = F.array(F.struct(F.lit(True).alias("is_orig"), F.col("seq").alias("seq")), F.struct(F.lit(False).alias("is_orig"), revcomp(F.col("seq")).alias("seq")))
    return reads.select("src_row", F.explode(strands).alias("s")).select((F.col("src_row") * 2 + F.when(F.col("s.is_orig"), 0).otherwise(1)).alias("read_id"), "src_row", "s.is_orig", "s.seq")


def read_stats(reads: DataFrame) -> DataFrame:
    """One row: the number of reads, the longest and shortest, and all bases."""
    return reads.agg(F.count("*").alias("n_reads"), F.max("len").alias("max_len"), F.min("len").alias("min_len"), F.sum("len").alias("n_bases"))


def shuffled(reads: DataFrame, seed: int = 1) -> DataFrame:
    """Reads with ``shuffle_key``: sorting by it is a fixed random order, and ranges of it are samples."""
    return reads.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(seed), "read_id")))
