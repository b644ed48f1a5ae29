"""Clean relations that several queries begin with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandweave.operators import kmers, overlaps
from strandweave.operators import reads as R
from strandweave.scratch import Scratch
from strandweave.sources.tables import table


def reads(spark: SparkSession, d: str) -> DataFrame:
    return R.clean_reads(table(spark, d, "seq_reads"))


def occurrences(spark: SparkSession, d: str) -> DataFrame:
    return kmers.clean_occurrences(table(spark, d, "kmer_occurrence"))


def index(spark: SparkSession, d: str) -> DataFrame:
    return kmers.dedupe(occurrences(spark, d))


def stored_reads(spark: SparkSession, d: str) -> DataFrame:
    """Clean reads written once, for queries that join them several times."""
    return Scratch(spark, "reads").keep(reads(spark, d))


def edges(spark: SparkSession, d: str, stored: DataFrame | None = None) -> DataFrame:
    return overlaps.clean_edges(table(spark, d, "neighbors"), stored if stored is not None else stored_reads(spark, d))
