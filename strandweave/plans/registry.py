"""All queries of the library but those of the optional subpackage for training data."""

from __future__ import annotations

from strandweave.plans import cluster_queries, io_queries, kmer_queries, model_queries, overlap_queries, pipeline_queries, read_queries, skew_queries, vote_queries

MODULES = (read_queries, kmer_queries, overlap_queries, skew_queries, vote_queries, model_queries, cluster_queries, io_queries, pipeline_queries)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
