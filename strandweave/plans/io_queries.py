"""Queries that write the given tables in each format and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandweave.operators import kmers
from strandweave.plans import base, model_queries, vote_queries
from strandweave.plans.sql import EDGES, OCC
from strandweave.plans.vote_queries import called_sql
from strandweave.scratch import Scratch
from strandweave.sources import files, readers
from strandweave.sources.tables import table


def _place(spark, name):
    return Scratch(spark, "io").root + "/" + name


def _counts(rows):
    return rows.groupBy("seq").agg(F.count("*").alias("n"))


def scan_reads_text(spark, d):
    path = _place(spark, "reads.txt")
    table(spark, d, "seq_reads").where("seq is not null").select(F.concat(F.lit(" "), "seq")).write.text(path)
    return _counts(readers.scan_text(spark, path))


def scan_reads_gzip(spark, d):
    path = _place(spark, "reads.txt.gz")
    table(spark, d, "seq_reads").where("seq is not null").select("seq").write.option("compression", "gzip").text(path)
    return _counts(readers.scan_reads(spark, path))


def scan_fastq(spark, d):
    path = _place(spark, "reads.fastq")
    rows = table(spark, d, "seq_reads").where("seq is not null and read_id is not null")
    record = F.concat_ws("\n", F.concat(F.lit("@r"), F.col("read_id").cast("string")), "seq", F.lit("+"), F.repeat(F.lit("@"), F.length("seq")))
    rows.select(record).write.text(path)
    return readers.scan_fastq(spark, path).groupBy("name", "seq", "qual").agg(F.count("*").alias("n"))


def index_store(spark, d):
    """The index in 32 buckets, read eight at a time and merged."""
    path = _place(spark, "index")
    files.write_index(base.index(spark, d), path)
    return kmers.merge_indexes(*[kmers.index_counts(files.read_index(spark, path, list(range(k, k + 8)))) for k in range(0, 32, 8)])


def neighbor_store(spark, d):
    path = _place(spark, "neighbors")
    files.write_neighbors(base.edges(spark, d).select("r1", "r2", "offs", "nerr"), path)
    return files.read_neighbors(spark, path, table(spark, d, "seq_reads").where("read_id is not null").select("read_id").distinct())


def confusion_store(spark, d):
    path = _place(spark, "confusion")
    files.write_confusion(table(spark, d, "confusion"), path)
    return files.read_confusion(spark, path)


def histogram_store(spark, d):
    path = _place(spark, "histogram")
    files.write_histogram(model_queries.first_coverage(spark, d), path)
    return files.read_histogram(spark, path)


def fastq_records(spark, d):
    return files.fastq(vote_queries.corrected_reads(spark, d))


QUERIES = {f.__name__: f for f in (scan_reads_text, scan_reads_gzip, scan_fastq, index_store, neighbor_store, confusion_store, histogram_store, fastq_records)}

_SEQS = "SELECT upper(seq) AS seq, count(*) AS n FROM seq_reads WHERE seq IS NOT NULL AND seq <> '' GROUP BY 1"
ORACLES = {
    "scan_reads_text": _SEQS,
    "scan_reads_gzip": _SEQS,
    "scan_fastq": "SELECT 'r' || read_id AS name, upper(seq) AS seq, repeat('@', length(seq)) AS qual, count(*) AS n FROM seq_reads WHERE seq IS NOT NULL AND read_id IS NOT NULL GROUP BY ALL",
    "index_store": f"WITH {OCC} SELECT kmer, count(*) AS occ FROM ded GROUP BY kmer",
    "neighbor_store": f"WITH {EDGES} SELECT i.read_id AS r1, r2, offs, nerr FROM (SELECT DISTINCT read_id FROM seq_reads WHERE read_id IS NOT NULL) i LEFT JOIN edges ON r1 = read_id",
    "confusion_store": "SELECT pos, true_b, called_b, coalesce(w, 0) AS w FROM confusion",
    "histogram_store": model_queries.ORACLES["first_coverage"],
    "fastq_records": f"""
        WITH {called_sql()}, s AS (SELECT r1, string_agg(base, '' ORDER BY col) AS seq, string_agg(qual, '' ORDER BY col) AS qual FROM called GROUP BY r1),
        o AS (SELECT src_row, s.seq, s.qual, row_number() OVER (ORDER BY src_row NULLS FIRST, r1) - 1 AS record FROM s JOIN reads ON read_id = r1)
        SELECT record, src_row, '@' || record || chr(10) || seq || chr(10) || '+' || chr(10) || qual AS value FROM o""",
}
