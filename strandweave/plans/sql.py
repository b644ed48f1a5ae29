"""Common table expressions of the comparison SQL."""

READS = """reads AS (
    SELECT read_id, max(src_row) AS src_row, bool_or(is_orig) AS is_orig, arg_max(upper(seq), loaded_at) AS seq,
        length(arg_max(upper(seq), loaded_at))::INTEGER AS len
    FROM seq_reads WHERE read_id IS NOT NULL AND seq IS NOT NULL GROUP BY read_id)"""

OCC = """occ AS (
    SELECT upper(kmer) AS kmer, read_id, read_id % 2 = 0 AS is_orig, pos, block FROM kmer_occurrence
    WHERE kmer IS NOT NULL AND read_id IS NOT NULL AND pos IS NOT NULL),
ded AS (SELECT kmer, read_id, CASE WHEN read_id % 2 = 0 THEN min(pos) ELSE max(pos) END AS pos FROM occ GROUP BY kmer, read_id)"""

#: The k-mer hash of a column ``kmer``.
KHASH = """(list_sum(list_transform(range(1, length(kmer) + 1), lambda i:
    greatest(instr('CGT', substr(kmer, i, 1)), 0)::BIGINT * (1::BIGINT << (2 * ((i - 1) % 16))::INTEGER)))::BIGINT % 4294967296)"""

PLACED = """
    greatest(offs, 0) AS st1, greatest(-offs, 0) AS st2, least(a.len - greatest(offs, 0), b.len - greatest(-offs, 0)) AS overlap"""

EDGES = READS + """,
e0 AS (SELECT r1, r2, offs, nerr FROM neighbors WHERE r1 <> r2 AND offs IS NOT NULL),
e1 AS (SELECT r1, r2, offs, max(nerr) AS nerr FROM (SELECT * FROM e0 UNION ALL SELECT r2, r1, -offs, nerr FROM e0) GROUP BY 1, 2, 3),
e2 AS (
    SELECT r1, r2, offs, nerr, a.len AS len1, b.len AS len2, a.seq AS seq1, b.seq AS seq2,""" + PLACED + """
    FROM e1 JOIN reads a ON a.read_id = r1 JOIN reads b ON b.read_id = r2),
e3 AS (
    SELECT r1, r2, offs, coalesce(nerr, hamming(substr(seq1, st1 + 1, overlap), substr(seq2, st2 + 1, overlap)))::INTEGER AS nerr, overlap, len1, len2
    FROM e2 WHERE overlap > 0),
e4 AS (SELECT r1, r2, arg_min({'offs': offs, 'nerr': nerr, 'overlap': overlap, 'len1': len1, 'len2': len2}, (nerr / overlap, offs)) AS b FROM e3 GROUP BY r1, r2),
edges AS (
    SELECT r1, r2, b.offs AS offs, b.nerr AS nerr, b.overlap AS overlap, b.len1 AS len1, b.len2 AS len2 FROM e4
    UNION ALL SELECT read_id, read_id, 0, 0, len, len, len FROM reads WHERE len > 0)"""

#: A number in [0, 1) that depends on a text alone.
UNIT = "(('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0)"
