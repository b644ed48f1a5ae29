"""Queries on keys that hold most rows (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.operators.skewed import heavy_keys, key_counts
from strandweave.sources.tables import table


def _kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "kmer_occurrence").select(F.upper("kmer").alias("kmer"), "read_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys(_kmers(spark, sf_dir), "kmer", "read_id", 0.01).select(F.col("key").alias("kmer"))


def p2_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_counts(_kmers(spark, sf_dir), "kmer", "read_id").select(F.col("key").alias("kmer"), F.col("rows").alias("n_rows"), F.col("records").alias("n_reads"))


QUERIES = {"p2_found": p2_found, "p2_keys": p2_keys}
ORACLES = {
    "p2_found": """
        SELECT upper(kmer) AS kmer FROM kmer_occurrence WHERE kmer IS NOT NULL GROUP BY 1
        HAVING count(*) * 100 >= (SELECT count(*) FROM kmer_occurrence WHERE kmer IS NOT NULL)""",
    "p2_keys": "SELECT upper(kmer) AS kmer, count(*) AS n_rows, count(DISTINCT read_id) AS n_reads FROM kmer_occurrence GROUP BY 1",
}
