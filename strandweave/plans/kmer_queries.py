"""Queries on the k-mer index."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandweave.operators import kmers
from strandweave.plans import base
from strandweave.plans.params import BIN, MAX_COV, K
from strandweave.plans.sql import KHASH, OCC, READS
from strandweave.sources.tables import table


def kmer_explode(spark, d):
    windows = kmers.explode_kmers(base.reads(spark, d), K)
    return windows.groupBy("kmer").agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"), F.sum(F.col("is_orig").cast("long")).alias("n_orig"))


def kmer_dedupe(spark, d):
    return base.index(spark, d)


def kmer_index(spark, d):
    one = base.index(spark, d)
    return kmers.with_order(one.groupBy("kmer").agg(F.count("*").alias("occ"), F.min("read_id").alias("first_read"), F.max("read_id").alias("last_read"), F.sum("pos").alias("pos_sum")))


def kmer_counts(spark, d):
    return kmers.index_counts(base.index(spark, d)).agg(F.count("*").alias("n_kmers"), F.sum("occ").alias("n_occ"), F.max("occ").alias("max_occ"))


def kmer_order(spark, d):
    stored = table(spark, d, "kmer_occurrence").where("kmer is not null and hash is not null")
    both = stored.select(F.upper("kmer").alias("kmer"), F.pmod("hash", F.lit(1 << 32)).alias("stored_hash")).distinct()
    return kmers.with_order(both).withColumn("same", F.col("khash") == F.col("stored_hash"))


def kmer_range_scan(spark, d):
    index = kmers.index_counts(base.index(spark, d))
    return kmers.range_scan(index, 1000, 3000).select("ordinal", "khash", "kmer", "occ")


def kmer_bucket(spark, d):
    return kmers.bucket(kmers.index_counts(base.index(spark, d)), 16, 3, 6)


def kmer_freq_filter(spark, d):
    return kmers.frequency_filter(base.index(spark, d), MAX_COV)


def kmer_bin_cap(spark, d):
    return kmers.bin_cap(base.index(spark, d), BIN)


def kmer_index_merge(spark, d):
    occ = base.occurrences(spark, d)
    part = lambda r: kmers.index_counts(kmers.dedupe(occ.where(F.col("read_id") % 3 == r)))
    return kmers.merge_indexes(part(0), part(1), part(2))


QUERIES = {f.__name__: f for f in (kmer_explode, kmer_dedupe, kmer_index, kmer_counts, kmer_order, kmer_range_scan, kmer_bucket, kmer_freq_filter, kmer_bin_cap, kmer_index_merge)}

_CNT = f"{OCC}, cnt AS (SELECT kmer, count(*) AS occ FROM ded GROUP BY kmer)"
ORACLES = {
    "kmer_explode": f"""
        WITH {READS}, w AS (SELECT substr(seq, p::INTEGER + 1, {K}) AS kmer, p AS pos, is_orig FROM reads, unnest(range(0, len - {K} + 1)) AS t(p))
        SELECT kmer, count(*) AS n, sum(pos)::BIGINT AS pos_sum, sum(is_orig::INTEGER)::BIGINT AS n_orig FROM w GROUP BY kmer""",
    "kmer_dedupe": f"WITH {OCC} SELECT kmer, read_id, pos FROM ded",
    "kmer_index": f"""
        WITH {OCC}, g AS (SELECT kmer, count(*) AS occ, min(read_id) AS first_read, max(read_id) AS last_read, sum(pos)::BIGINT AS pos_sum FROM ded GROUP BY kmer)
        SELECT *, {KHASH} AS khash FROM g""",
    "kmer_counts": f"WITH {_CNT} SELECT count(*) AS n_kmers, sum(occ)::BIGINT AS n_occ, max(occ) AS max_occ FROM cnt",
    "kmer_order": f"""
        WITH k AS (SELECT DISTINCT upper(kmer) AS kmer, ((hash % 4294967296) + 4294967296) % 4294967296 AS stored_hash FROM kmer_occurrence WHERE kmer IS NOT NULL AND hash IS NOT NULL)
        SELECT kmer, stored_hash, {KHASH} AS khash, {KHASH} = stored_hash AS same FROM k""",
    "kmer_range_scan": f"""
        WITH {_CNT}, h AS (SELECT kmer, occ, {KHASH} AS khash FROM cnt)
        SELECT ordinal, khash, kmer, occ FROM (SELECT *, row_number() OVER (ORDER BY khash, kmer) - 1 AS ordinal FROM h) WHERE ordinal >= 1000 AND ordinal < 3000""",
    "kmer_bucket": f"WITH {_CNT}, h AS (SELECT kmer, occ, {KHASH} AS khash FROM cnt) SELECT *, khash % 16 AS bucket FROM h WHERE khash % 16 >= 3 AND khash % 16 < 6",
    "kmer_freq_filter": f"WITH {_CNT} SELECT kmer, read_id, pos FROM ded SEMI JOIN (SELECT kmer FROM cnt WHERE occ < {3 * MAX_COV}) USING (kmer)",
    "kmer_bin_cap": f"WITH {OCC} SELECT kmer, read_id, pos FROM ded QUALIFY row_number() OVER (PARTITION BY kmer ORDER BY read_id, pos) <= {BIN}",
    "kmer_index_merge": f"WITH {_CNT} SELECT kmer, occ FROM cnt",
}
