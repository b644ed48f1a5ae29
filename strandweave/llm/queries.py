"""The queries of the operators for training data, and their SQL where it can express them."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm.bpe import token_ids, token_sizes
from strandweave.llm.components import groups
from strandweave.llm.frequency import marked
from strandweave.llm.heavy_hitters import frequent
from strandweave.llm.look import look_alike_classes, look_alike_pairs, one_form
from strandweave.llm.packing import pack, windows
from strandweave.llm.similar import clusters, described, membership
from strandweave.llm.spans import coverage, shared_spans
from strandweave.sources.tables import table

WINDOW = 4096
SPAN = 48


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    kmers = table(spark, sf_dir, "kmer_occurrence").select(F.upper("kmer").alias("kmer"), "read_id")
    return marked(kmers, "kmer", "read_id", 0.01, 2).select(F.col("term").alias("kmer"), "occurrences", F.col("records").alias("reads"), "mark")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_terms(spark, sf_dir).where("mark is not null").select("kmer", "mark")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent(table(spark, sf_dir, "kmer_occurrence"), "hash", Fraction(1, 400), modulus=1 << 32).select(F.col("value").alias("hash"))


def p3_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kmers = table(spark, sf_dir, "kmer_occurrence").select(F.upper("kmer").alias("kmer"))
    return frequent(kmers, "kmer", Fraction(1, 400)).select(F.col("value").alias("kmer"), "n")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "neighbors").select("r1", "r2").union(table(spark, sf_dir, "brothers").select("target_id", "read_id"))
    return groups(links, "r1", "r2").select("group_id", F.col("id").alias("read_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters(table(spark, sf_dir, "brothers"), "target_id", "read_id", "seq", 0.1)
    return membership(found).select(F.col("grp").alias("target_id"), F.col("first").alias("first_read"), F.col("member").alias("read_id"))


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters(table(spark, sf_dir, "brothers"), "target_id", "read_id", "seq", 0.1)
    return described(found).withColumnsRenamed({"grp": "target_id", "first": "first_read"})


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = shared_spans(table(spark, sf_dir, "brothers"), "target_id", "read_id", "seq", SPAN)
    return spans.select(F.col("grp").alias("target_id"), F.col("member").alias("read_id"), "span_start", "span_len")


def p6_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = coverage(table(spark, sf_dir, "brothers"), "target_id", "read_id", "seq", SPAN)
    return shares.withColumnsRenamed({"grp": "target_id", "member": "read_id"})


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_sizes(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", "tokens", WINDOW)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_pieces(spark, sf_dir).where("piece = 1").select("doc_id")


def p8_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(p8_pieces(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alike_pairs(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alike_classes(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_form(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "shown")


QUERIES = {f.__name__: f for f in (p1_found, p1_terms, p3_found, p3_kmers, p4_found, p5_found, p5_clusters, p6_found, p6_shared, p7_ids, p8_found, p8_pieces, p8_windows, p9_found, p9_classes, p9_text)}

_SPANS = """
    WITH b AS (SELECT DISTINCT target_id, read_id, upper(seq) AS seq FROM brothers WHERE seq IS NOT NULL AND read_id IS NOT NULL),
    w AS (
        SELECT target_id, read_id, seq, s, substr(seq, s + 1, 48) AS w FROM b, range(0, 103) AS t(s)
        WHERE regexp_full_match(substr(seq, s + 1, 48), '[ACGT]{48}')),
    two AS (SELECT w FROM w GROUP BY w HAVING min(read_id) <> max(read_id)),
    hit AS (SELECT target_id, read_id, seq, s, s - lag(s) OVER (PARTITION BY target_id, read_id, seq ORDER BY s) AS gap FROM w SEMI JOIN two USING (w)),
    run AS (SELECT *, sum(CASE WHEN gap <= 48 THEN 0 ELSE 1 END) OVER (PARTITION BY target_id, read_id, seq ORDER BY s) AS run FROM hit),
    span AS (SELECT target_id, read_id, min(s) AS span_start, max(s) + 48 - min(s) AS span_len FROM run GROUP BY target_id, read_id, seq, run)
"""
_MARKS = """
    WITH k AS (SELECT upper(kmer) AS kmer, read_id FROM kmer_occurrence WHERE kmer IS NOT NULL),
    n AS (SELECT count(DISTINCT read_id) AS n FROM k),
    c AS (SELECT kmer, count(*) AS occurrences, count(DISTINCT read_id) AS reads FROM k GROUP BY 1),
    m AS (SELECT c.*, CASE WHEN reads > 0 AND reads * 100 >= n THEN 'common' WHEN reads < 2 THEN 'rare' END AS mark FROM c, n)
"""
ORACLES = {
    "p1_terms": _MARKS + "SELECT kmer, occurrences, reads, mark FROM m",
    "p1_found": _MARKS + "SELECT kmer, mark FROM m WHERE mark IS NOT NULL",
    "p3_found": """
        WITH h AS (SELECT ((hash % 4294967296) + 4294967296) % 4294967296 AS hash FROM kmer_occurrence WHERE hash IS NOT NULL)
        SELECT hash FROM h GROUP BY 1 HAVING count(*) * 400 >= (SELECT count(*) FROM h)""",
    "p3_kmers": """
        SELECT upper(kmer) AS kmer, count(*) AS n FROM kmer_occurrence WHERE kmer IS NOT NULL GROUP BY 1
        HAVING count(*) * 400 >= (SELECT count(*) FROM kmer_occurrence WHERE kmer IS NOT NULL)""",
    "p4_found": """
        WITH RECURSIVE e AS (
            SELECT r1 AS a, r2 AS b FROM neighbors WHERE r1 <> r2 UNION SELECT r2, r1 FROM neighbors WHERE r1 <> r2
            UNION SELECT target_id, read_id FROM brothers WHERE target_id <> read_id
            UNION SELECT read_id, target_id FROM brothers WHERE target_id <> read_id),
        r(id, low) AS (SELECT a, a FROM e UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.id WHERE r.low < e.b)
        SELECT min(low) AS group_id, id AS read_id FROM r GROUP BY id""",
    "p5_found": """
        WITH RECURSIVE s AS (
            SELECT DISTINCT target_id, read_id, upper(seq) AS seq FROM brothers
            WHERE seq IS NOT NULL AND target_id IS NOT NULL AND read_id IS NOT NULL),
        p AS (
            SELECT x.target_id, x.read_id AS a, y.read_id AS b,
                list_transform(range(1, 151), lambda i: CASE
                    WHEN instr('ACGT', substr(x.seq, i, 1)) = 0 OR substr(x.seq, i, 1) = '' OR instr('ACGT', substr(y.seq, i, 1)) = 0 OR substr(y.seq, i, 1) = '' THEN 0
                    WHEN substr(x.seq, i, 1) = substr(y.seq, i, 1) THEN 1 ELSE 1000 END) AS c
            FROM s x JOIN s y ON x.target_id = y.target_id AND x.read_id < y.read_id),
        alike AS (
            SELECT target_id, a, b FROM (SELECT *, list_sum(c) // 1000 AS differ, len(list_filter(c, lambda v: v > 0)) AS shared FROM p)
            WHERE shared > 0 AND differ * 10 <= shared),
        e AS (SELECT target_id, a, b FROM alike UNION SELECT target_id, b, a FROM alike),
        r(target_id, id, low) AS (
            SELECT target_id, a, a FROM e
            UNION SELECT r.target_id, e.b, r.low FROM r JOIN e ON e.target_id = r.target_id AND e.a = r.id WHERE r.low < e.b)
        SELECT target_id, min(low) AS first_read, id AS read_id FROM r GROUP BY target_id, id""",
    "p6_found": _SPANS + "SELECT * FROM span",
    "p6_shared": _SPANS + """
        SELECT t.target_id, t.read_id, t.bases, coalesce(c.shared, 0) AS shared
        FROM (SELECT target_id, read_id, sum(length(regexp_replace(seq, '[^ACGT]', '', 'g')))::BIGINT AS bases FROM b GROUP BY 1, 2) t
        LEFT JOIN (SELECT target_id, read_id, sum(span_len)::BIGINT AS shared FROM span GROUP BY 1, 2) c USING (target_id, read_id)""",
}
