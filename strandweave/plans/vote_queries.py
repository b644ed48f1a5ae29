"""Queries on votes and base calls."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from strandweave.functions.dna import rounded
from strandweave.operators import voting
from strandweave.operators.overlaps import refilter
from strandweave.plans import base
from strandweave.plans.params import COV, H_RATE, MAX_VOTES, MIN_VOTES, SMOOTHING, E, H
from strandweave.plans.sql import EDGES
from strandweave.scratch import Scratch
from strandweave.sources.tables import table

#: Likelihoods have nine digits; this keeps them off the halves that the two engines round to different sides.
OFF = 1.23e-10


def max_len(reads):
    return reads.agg(F.max("len")).first()[0] or 0


def _edges(spark, d, reads):
    return refilter(base.edges(spark, d, reads), H, E)


def votes(spark, d):
    reads = base.stored_reads(spark, d)
    return voting.votes(_edges(spark, d, reads), reads)


def placed(spark, d, reads):
    """Edges with their neighbours' bases, written once."""
    return Scratch(spark, "placed").keep(voting.placed(_edges(spark, d, reads), reads))


def columns(spark, d, h_rate=0.0, reads=None):
    reads = reads if reads is not None else base.stored_reads(spark, d)
    ll = voting.likelihoods(table(spark, d, "confusion"), max_len(reads), smoothing=SMOOTHING)
    return voting.columns(placed(spark, d, reads), ll, COV, h_rate)


def called(spark, d, h_rate=0.0, reads=None):
    return voting.call(columns(spark, d, h_rate, reads), MAX_VOTES, MIN_VOTES, h_rate)


def collect_votes(spark, d):
    """Every vote, equal ones of a read and column counted."""
    return votes(spark, d).where("base is not null").groupBy("r1", "col", "pos", "base", "rc", "own").agg(F.count("*").alias("n"))


def self_prior_votes(spark, d):
    own = votes(spark, d).where("own and base is not null")
    return own.groupBy("col", "base").agg(F.sum(F.lit(voting.prior_votes(COV))).alias("n_prior"), F.sum(F.lit(voting.prior_votes(COV, H_RATE))).alias("n_prior_het"))


def column_coverage(spark, d):
    return votes(spark, d).groupBy("r1", "col").agg(F.count("base").alias("cov"))


def hypothesis_loglik(spark, d):
    return columns(spark, d).select("r1", "col", *[rounded(F.col(f"{x}{b}{b}") + OFF, 6).alias(f"{x}{b}{b}") for b in range(4) for x in "lq"])


def genotype_loglik(spark, d):
    return columns(spark, d, H_RATE).select("r1", "col", *[rounded(F.col(f"l{a}{b}") + OFF, 6).alias(f"l{a}{b}") for a, b in voting.HETEROZYGOUS])


def genotype_call(spark, d):
    return voting.joined_columns(called(spark, d, H_RATE), "mapped")


def map_consensus(spark, d):
    return voting.joined_columns(called(spark, d), "mapped")


def quality_score(spark, d):
    return voting.joined_columns(called(spark, d), "qual")


def consensus_accept(spark, d):
    return voting.joined_columns(called(spark, d).withColumn("taken", F.when(F.col("accepted"), "+").otherwise("-")), "taken")


def corrected_reads(spark, d):
    reads = base.stored_reads(spark, d)
    return voting.corrected(called(spark, d, reads=reads), reads)


def confusion_mstep(spark, d):
    return voting.expected_calls(called(spark, d)).withColumn("w", F.round("w", 5))


QUERIES = {f.__name__: f for f in (collect_votes, self_prior_votes, column_coverage, hypothesis_loglik, genotype_loglik, genotype_call, map_consensus, quality_score, consensus_accept, corrected_reads, confusion_mstep)}

VOTES = EDGES + f""",
pl AS (
    SELECT r1, r2, greatest(offs, 0) AS st1, greatest(-offs, 0) AS st2, overlap, len2, b.is_orig AS orig2, b.seq AS seq2
    FROM edges JOIN reads a ON a.read_id = r1 JOIN reads b ON b.read_id = r2 WHERE a.is_orig AND overlap >= {H} AND nerr <= overlap * {E}::DOUBLE),
ex AS (SELECT *, instr('ACGT', substr(seq2, (st2 + i + 1)::INTEGER, 1)) - 1 AS code FROM pl, unnest(range(0, overlap)) AS t(i)),
v AS (
    SELECT r1, (st1 + i)::INTEGER AS col, (CASE WHEN orig2 THEN st2 + i ELSE len2 - st2 - i - 1 END)::INTEGER AS pos,
        (CASE WHEN code < 0 THEN NULL WHEN orig2 THEN code ELSE 3 - code END)::INTEGER AS base, NOT orig2 AS rc, r1 = r2 AS own
    FROM ex WHERE code >= 0 OR r1 = r2)"""
SMOOTHED = """
cw AS (SELECT pos, true_b, called_b, coalesce(w, 0) + {}::DOUBLE AS w FROM confusion),
cp AS (SELECT pos, true_b, called_b, w / sum(w) OVER (PARTITION BY pos, called_b) AS p FROM cw)"""
LL = """,
l0 AS (SELECT pos, called_b AS base, """ + ", ".join(f"max(ln(p)) FILTER (true_b = {b}) AS ll{b}" for b in range(4)) + """ FROM cp GROUP BY 1, 2),
ml AS (SELECT max(len) AS max_len FROM reads), lp AS (SELECT max(pos) AS last FROM l0),
ll AS (
    SELECT * FROM l0 UNION ALL
    SELECT p::INTEGER, base, ll0, ll1, ll2, ll3 FROM l0, lp, ml, unnest(range(last + 1, max_len)) AS t(p) WHERE pos = last)"""


def columns_sql(h_rate: float = 0.0) -> str:
    w = 1 + voting.prior_votes(COV, h_rate)
    seen = [f"CASE WHEN rc THEN ll{3 - b} ELSE ll{b} END" for b in range(4)]
    aggs = []
    for a, b in voting.hypotheses(h_rate):
        one = seen[a] if a == b else f"ln(0.5::DOUBLE * exp({seen[a]}) + 0.5::DOUBLE * exp({seen[b]}))"
        prior = math.log(0.25) + math.log(1 - h_rate) if a == b else -math.log(6) + math.log(h_rate)
        for x, weight in (("l", f"(CASE WHEN own THEN {w} ELSE 1 END)"), ("q", "1")):
            aggs.append(f"round(coalesce(sum(({one}) * {weight}), 0) + {prior!r}::DOUBLE, 9) AS {x}{a}{b}")
    return VOTES + "," + SMOOTHED.format(SMOOTHING) + LL + f""",
c AS (SELECT r1, col, count(base) AS n, max(base) FILTER (own) AS orig, {", ".join(aggs)} FROM v LEFT JOIN ll USING (pos, base) GROUP BY r1, col)"""


def called_sql(h_rate: float = 0.0) -> str:
    pairs = voting.hypotheses(h_rate)
    letters = "ACGT" if len(pairs) == 4 else "AMRWCSYGKT"
    top = "greatest(" + ", ".join(f"l{a}{b}" for a, b in pairs) + ")"
    best = "CASE " + " ".join(f"WHEN l{a}{b} = {top} THEN {i}" for i, (a, b) in enumerate(pairs)) + " END"
    own = "CASE orig " + " ".join(f"WHEN {a} THEN {i}" for i, (a, b) in enumerate(pairs) if a == b) + " END"
    qs = "[" + ", ".join(f"q{a}{b}" for a, b in pairs) + "]"
    return columns_sql(h_rate) + f""",
b1 AS (SELECT *, {best} AS best, n <> 0 AND n <= {MAX_VOTES} AND n >= {MIN_VOTES} AS accepted FROM c),
b2 AS (SELECT *, substr('{letters}', best + 1, 1) AS mapped, CASE WHEN accepted THEN best ELSE {own} END AS ref FROM b1),
b3 AS (SELECT *, list_transform({qs}, lambda x: exp(x - ({qs})[ref + 1])) AS odds FROM b2),
b4 AS (SELECT *, CASE WHEN ref IS NOT NULL THEN list_sum(odds) END AS total FROM b3),
b5 AS (SELECT *, list_sum(list_transform(range(0, len(odds)), lambda i: CASE WHEN i = ref THEN 0 ELSE odds[i + 1] END)) / total AS error FROM b4),
called AS (
    SELECT *, CASE WHEN accepted THEN mapped ELSE coalesce(substr('ACGT', orig + 1, 1), 'N') END AS base,
        chr(CASE WHEN error >= 1e-100 THEN least(93, greatest(0, floor(round(-10 * log10(error) / greatest(1, n), 6)))) + 33 ELSE 126 END::INTEGER) AS qual
    FROM b5)"""


_STR = "SELECT r1 AS read_id, string_agg({0}, '' ORDER BY col) AS {0} FROM called GROUP BY r1"
ORACLES = {
    "collect_votes": f"WITH {VOTES} SELECT r1, col, pos, base, rc, own, count(*) AS n FROM v WHERE base IS NOT NULL GROUP BY ALL",
    "self_prior_votes": f"WITH {VOTES} SELECT col, base, (count(*) * {voting.prior_votes(COV)})::BIGINT AS n_prior, 0::BIGINT AS n_prior_het FROM v WHERE own AND base IS NOT NULL GROUP BY 1, 2",
    "column_coverage": f"WITH {VOTES} SELECT r1, col, count(base) AS cov FROM v GROUP BY 1, 2",
    "hypothesis_loglik": f"WITH {columns_sql()} SELECT r1, col, {', '.join(f'round({x}{b}{b} + {OFF}::DOUBLE, 6) AS {x}{b}{b}' for b in range(4) for x in 'lq')} FROM c",
    "genotype_loglik": f"WITH {columns_sql(H_RATE)} SELECT r1, col, {', '.join(f'round(l{a}{b} + {OFF}::DOUBLE, 6) AS l{a}{b}' for a, b in voting.HETEROZYGOUS)} FROM c",
    "genotype_call": f"WITH {called_sql(H_RATE)} " + _STR.format("mapped"),
    "map_consensus": f"WITH {called_sql()} " + _STR.format("mapped"),
    "quality_score": f"WITH {called_sql()} " + _STR.format("qual"),
    "consensus_accept": f"WITH {called_sql()} SELECT r1 AS read_id, string_agg(CASE WHEN accepted THEN '+' ELSE '-' END, '' ORDER BY col) AS taken FROM called GROUP BY r1",
    "corrected_reads": f"""
        WITH {called_sql()}, s AS (SELECT r1, string_agg(base, '' ORDER BY col) AS seq, string_agg(qual, '' ORDER BY col) AS qual FROM called GROUP BY r1)
        SELECT r1 AS read_id, src_row, s.seq, qual FROM s JOIN reads ON read_id = r1""",
    "confusion_mstep": f"""
        WITH {called_sql()}, sh AS (SELECT col AS pos, orig AS called_b, i, odds[i + 1] / total AS w FROM called, unnest(range(0, 4)) AS t(i) WHERE orig IS NOT NULL AND total > 0)
        SELECT pos, i::INTEGER AS true_b, called_b, round(sum(w), 5) AS w FROM sh GROUP BY 1, 2, 3""",
}
