"""Queries on reads and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandweave.functions import dna
from strandweave.operators import reads as R
from strandweave.operators.ranking import with_ordinal
from strandweave.plans import base
from strandweave.plans.sql import READS, UNIT
from strandweave.sources.tables import table


def reads_both_strands(spark, d):
    return R.both_strands(base.reads(spark, d).where("is_orig and src_row is not null"))


def revcomp(spark, d):
    return base.reads(spark, d).select("read_id", dna.revcomp(F.col("seq")).alias("rc"))


def read_stats(spark, d):
    return R.read_stats(base.reads(spark, d))


def shuffled_reads(spark, d):
    """Each read's place in the seeded order."""
    return with_ordinal(R.shuffled(base.reads(spark, d).select("read_id"), 7), ["shuffle_key", "read_id"]).select("read_id", "ordinal")


def base_codec(spark, d):
    letters = table(spark, d, "seq_reads").where("seq is not null").select(F.explode(F.split("seq", "")).alias("base")).where("base <> ''")
    counts = letters.groupBy("base").agg(F.count("*").alias("n"))
    code = dna.base_code(F.col("base"))
    return counts.select("base", code.cast("int").alias("code"), dna.code_base(code).alias("back"), dna.is_any_base(code).alias("is_any"), "n")


def iupac_code(spark, d):
    pairs = table(spark, d, "confusion").select("true_b", "called_b").distinct()
    return pairs.select("true_b", "called_b", dna.iupac(F.col("true_b"), F.col("called_b")).alias("code"))


def k_rule(spark, d):
    s = R.read_stats(base.reads(spark, d))
    return s.select("max_len", "n_reads", dna.k_rule(F.col("max_len"), F.col("n_reads")).alias("k_serial"), dna.k_rule(F.col("max_len"), F.col("n_reads"), 6).alias("k_parallel"))


def param_grid(spark, d):
    s = R.read_stats(base.reads(spark, d))
    hs = F.explode(F.sequence(F.floor(F.col("max_len") * 0.5).cast("int"), F.floor(F.col("max_len") * 0.66).cast("int"), F.lit(2)))
    return s.select(hs.alias("h")).select("h", F.explode(F.array(F.lit(5), F.lit(10), F.lit(15))).alias("e_percent"))


def array_normalize(spark, d):
    rows = table(spark, d, "confusion").groupBy("pos", "true_b").agg(F.transform(F.array_sort(F.collect_list(F.struct("called_b", F.coalesce("w", F.lit(0.0)).alias("w")))), lambda s: s["w"]).alias("ws"))
    return rows.select("pos", "true_b", F.round(dna.array_sum(F.col("ws")), 6).alias("total"), F.posexplode(dna.array_normalize(F.col("ws"))).alias("called_b", "p")).select("pos", "true_b", "called_b", "total", F.round("p", 6).alias("p"))


def weighted_pick(spark, d):
    rows = table(spark, d, "confusion").groupBy("pos", "true_b").agg(F.transform(F.array_sort(F.collect_list(F.struct("called_b", F.coalesce("w", F.lit(0.0)).alias("w")))), lambda s: s["w"]).alias("ws"))
    t = dna.unit_hash(F.col("pos"), F.col("true_b"))
    return rows.select("pos", "true_b", dna.weighted_pick(dna.array_normalize(F.col("ws")), t).alias("picked"))


def bernoulli_test(spark, d):
    return base.reads(spark, d).select("read_id", dna.bernoulli(0.25, F.col("read_id"), F.lit("b")).alias("hit"))


QUERIES = {f.__name__: f for f in (reads_both_strands, revcomp, read_stats, shuffled_reads, base_codec, iupac_code, k_rule, param_grid, array_normalize, weighted_pick, bernoulli_test)}

_RC = "reverse(translate({}, 'ACGTN', 'TGCAN'))"
_WS = """WITH w AS (SELECT pos, true_b, list(coalesce(w, 0) ORDER BY called_b) AS ws FROM confusion GROUP BY 1, 2)"""
ORACLES = {
    "reads_both_strands": f"""
        WITH {READS}, o AS (SELECT * FROM reads WHERE is_orig AND src_row IS NOT NULL)
        SELECT src_row * 2 AS read_id, src_row, true AS is_orig, seq FROM o
        UNION ALL SELECT src_row * 2 + 1, src_row, false, {_RC.format("seq")} FROM o""",
    "revcomp": f"WITH {READS} SELECT read_id, {_RC.format('seq')} AS rc FROM reads",
    "read_stats": f"WITH {READS} SELECT count(*) AS n_reads, max(len) AS max_len, min(len) AS min_len, sum(len)::BIGINT AS n_bases FROM reads",
    "shuffled_reads": f"WITH {READS} SELECT read_id, row_number() OVER (ORDER BY md5('7|' || read_id), read_id) - 1 AS ordinal FROM reads",
    "base_codec": """
        SELECT base, CASE instr('ACGT', base) WHEN 0 THEN 4 ELSE instr('ACGT', base) - 1 END::INTEGER AS code,
            CASE WHEN instr('ACGT', base) > 0 THEN base END AS back, instr('ACGT', base) = 0 AS is_any, count(*) AS n
        FROM (SELECT unnest(string_split(seq, '')) AS base FROM seq_reads WHERE seq IS NOT NULL) WHERE base <> '' GROUP BY base""",
    "iupac_code": """
        SELECT DISTINCT true_b, called_b, CASE WHEN true_b = called_b THEN substr('ACGT', true_b + 1, 1)
            ELSE substr('MRWSYK', CASE least(true_b, called_b) WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 3 END + greatest(true_b, called_b), 1) END AS code
        FROM confusion""",
    "k_rule": f"""
        WITH {READS}, s AS (SELECT max(len) AS max_len, count(*) AS n_reads FROM reads)
        SELECT max_len, n_reads, greatest(floor(max_len / 5), ceil(round(ln(n_reads * max_len) / ln(4), 9)))::INTEGER AS k_serial,
            greatest(floor(max_len / 6), ceil(round(ln(n_reads * max_len) / ln(4), 9)))::INTEGER AS k_parallel FROM s""",
    "param_grid": f"""
        WITH {READS}, s AS (SELECT max(len) AS max_len FROM reads)
        SELECT h::INTEGER AS h, e AS e_percent FROM s, unnest(range(floor(max_len * 0.5)::BIGINT, floor(max_len * 0.66)::BIGINT + 1, 2)) AS t(h), (VALUES (5), (10), (15)) AS v(e)""",
    "array_normalize": _WS + """
        SELECT pos, true_b, i::INTEGER AS called_b, round(list_sum(ws), 6) AS total, round(ws[i + 1] / list_sum(ws), 6) AS p FROM w, range(0, 4) AS t(i)""",
    "weighted_pick": _WS + f""",
        c AS (SELECT pos, true_b, i, list_sum(ws[1 : i + 1]) / list_sum(ws) AS run, {UNIT.format("pos || '|' || true_b")} AS t FROM w, range(0, 4) AS r(i))
        SELECT pos, true_b, coalesce(min(i) FILTER (t < run), -1)::INTEGER AS picked FROM c GROUP BY pos, true_b""",
    "bernoulli_test": f"WITH {READS} SELECT read_id, {UNIT.format("read_id || '|b'")} < 0.25 AS hit FROM reads",
}
