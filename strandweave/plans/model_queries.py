"""Queries on model fitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandweave.operators import model, voting
from strandweave.plans import base, vote_queries
from strandweave.plans.params import COV, MAX_VOTES, MIN_VOTES
from strandweave.plans.vote_queries import LL, SMOOTHED, VOTES, called_sql
from strandweave.sources.tables import table


def confusion_normalize(spark, d):
    rows = voting.normalized(table(spark, d, "confusion"))
    return rows.select("pos", "true_b", "called_b", F.round("p", 9).alias("p"), F.round(F.log("p"), 9).alias("ll"))


def likelihood_fill(spark, d):
    """Likelihoods up to 40 positions beyond the table: the last one is repeated."""
    ll = voting.likelihoods(table(spark, d, "confusion"), 190)
    return ll.select("pos", F.col("called").alias("called_b"), *[F.round(f"ll{b}", 9).alias(f"ll{b}") for b in range(4)])


def confusion_delta(spark, d):
    new = voting.expected_calls(vote_queries.called(spark, d))
    return model.delta(table(spark, d, "confusion"), new).select(F.round("delta", 4).alias("delta"))


def em_one_step(spark, d):
    new = voting.expected_calls(vote_queries.called(spark, d))
    return voting.normalized(new).select("pos", "true_b", "called_b", F.round("p", 6).alias("p"))


def em_confusion(spark, d):
    """EM on the votes of all reads."""
    reads = base.stored_reads(spark, d)
    return model.em(vote_queries.placed(spark, d, reads), vote_queries.max_len(reads), COV, MAX_VOTES, MIN_VOTES)


def _first(spark, d):
    reads = base.stored_reads(spark, d)
    cov = model.first_coverage(base.edges(spark, d, reads), reads)
    return cov.groupBy("cov").agg(F.count("*").alias("n"))


def first_coverage(spark, d):
    return _first(spark, d)


def poisson_fit(spark, d):
    return model.poisson_fit(_first(spark, d)).select("cov", F.round("tv", 6).alias("tv"))


def coverage_caps(spark, d):
    return model.poisson_fit(_first(spark, d)).select("cov", *model.caps(F.col("cov")))


def coverage_histogram(spark, d):
    reads = base.stored_reads(spark, d)
    return model.coverage_histogram(base.edges(spark, d, reads), reads)


def param_grid_histograms(spark, d):
    """Over all reads: limits from 75 to 99 columns, and 5, 10 and 15 % mismatches."""
    reads = base.stored_reads(spark, d)
    return model.grid_histograms(base.edges(spark, d, reads), reads, list(range(75, 100, 2)), [0.05, 0.1, 0.15])


def param_select(spark, d):
    return model.select_params(param_grid_histograms(spark, d))


QUERIES = {f.__name__: f for f in (confusion_normalize, likelihood_fill, confusion_delta, em_one_step, em_confusion, first_coverage, poisson_fit, coverage_caps, coverage_histogram, param_grid_histograms, param_select)}

_MSTEP = called_sql() + """,
sh AS (SELECT col AS pos, orig AS called_b, i, odds[i + 1] / total AS w FROM called, unnest(range(0, 4)) AS t(i) WHERE orig IS NOT NULL AND total > 0),
ms AS (SELECT pos, i::INTEGER AS true_b, called_b, sum(w) AS w FROM sh GROUP BY 1, 2, 3)"""
_HIST = VOTES.split(",\npl AS")[0] + """,
fc AS (
    SELECT r1, sum((offs <= 0 AND instr('ACGT', substr(b.seq, 1 - offs, 1)) > 0)::INTEGER)::BIGINT AS cov
    FROM edges JOIN reads a ON a.read_id = r1 JOIN reads b ON b.read_id = r2 WHERE a.is_orig GROUP BY r1),
hist AS (SELECT cov, count(*) AS n FROM fc GROUP BY cov)"""
_FIT = _HIST + """,
mo AS (SELECT coalesce(arg_max(cov, (n, -cov)) FILTER (cov >= 2), 2) AS mode, sum(n) AS total, greatest(max(cov), 499) AS last FROM (SELECT * FROM hist UNION ALL SELECT 0, 0)),
bi AS (
    SELECT mode, m, k, coalesce(n, 0) / total AS x,
        CASE WHEN m = 0 THEN (k = 0)::INTEGER::DOUBLE ELSE exp(-m + k * ln(m) - lgamma(k + 1)) END AS p
    FROM mo CROSS JOIN unnest(range(mode - 2, mode + 3)) AS t(m) CROSS JOIN unnest(range(0, last + 1)) AS u(k) LEFT JOIN hist ON cov = k),
tv AS (SELECT mode, m, round(0.5 * sum(abs(x - p)) + 0.5 * (1 - sum(p)), 9) AS tv FROM bi GROUP BY 1, 2),
fit AS (SELECT coalesce(arg_min(m, (tv, m)) FILTER (tv < 1), any_value(mode) + 1) AS cov, coalesce(min(tv) FILTER (tv < 1), 1.0) AS tv FROM tv)"""

def greedy_sql(links: str, keys: tuple[str, ...] = ()) -> str:
    """``left_out(keys, id)``: what a greedy pass in the order of ids leaves out, of ``links(keys, a, b)``.

    A step keeps every open vertex (st 0) whose open neighbours are all greater (1) and leaves out their neighbours (2).
    """
    k, g = "".join(f"{c}, " for c in keys), "".join(f"g.{c}, " for c in keys)
    same = lambda x, y: "".join(f" AND {x}.{c} = {y}.{c}" for c in keys)
    return f"""ln AS (SELECT {k}a, b FROM {links} UNION SELECT {k}b, a FROM {links}),
gr({k}id, st, step) AS (
    SELECT DISTINCT {k}a, 0, 0 FROM ln
    UNION ALL
    SELECT {g}g.id, CASE WHEN g.st <> 0 THEN g.st WHEN low.id IS NOT NULL THEN 1 WHEN nx.id IS NOT NULL THEN 2 ELSE 0 END, g.step + 1
    FROM gr g
    LEFT JOIN (SELECT {k}id FROM gr WHERE st = 0 EXCEPT SELECT {"".join(f"ln.{c}, " for c in keys)}ln.a FROM ln JOIN gr o ON o.id = ln.b{same("o", "ln")} WHERE o.st = 0 AND o.id < ln.a) low
        ON low.id = g.id{same("low", "g")}
    LEFT JOIN (
        SELECT DISTINCT {"".join(f"ln.{c}, " for c in keys)}ln.b AS id FROM ln
        JOIN (SELECT {k}id FROM gr WHERE st = 0 EXCEPT SELECT {"".join(f"ln.{c}, " for c in keys)}ln.a FROM ln JOIN gr o ON o.id = ln.b{same("o", "ln")} WHERE o.st = 0 AND o.id < ln.a) lw
        ON lw.id = ln.a{same("lw", "ln")}) nx ON nx.id = g.id{same("nx", "g")}
    WHERE EXISTS (SELECT 1 FROM gr WHERE st = 0)),
left_out AS (SELECT DISTINCT {k}id FROM gr WHERE st = 2)"""


_EDGES = VOTES.split(",\npl AS")[0]


def _histogram_sql(edges: str, keys: tuple[str, ...] = ()) -> str:
    """``co``, the coverage of original reads, and ``hi``, its histogram without what the greedy pass leaves out."""
    k = "".join(f"{c}, " for c in keys)
    same = lambda x, y: "".join(f" AND {x}.{c} = {y}.{c}" for c in keys)
    return f""",
co AS (
    SELECT {k}r1, sum((offs <= 0 AND instr('ACGT', substr(b.seq, 1 - offs, 1)) > 0)::INTEGER)::BIGINT AS cov
    FROM {edges} JOIN reads a ON a.read_id = r1 JOIN reads b ON b.read_id = r2 WHERE a.is_orig GROUP BY {k}r1),
li AS (
    SELECT {k}r1 AS a, r2 AS b FROM {edges} x WHERE r1 < r2
    AND EXISTS (SELECT 1 FROM co WHERE co.r1 = x.r1{same("co", "x")}) AND EXISTS (SELECT 1 FROM co WHERE co.r1 = x.r2{same("co", "x")})),
{greedy_sql("li", keys)},
hi AS (SELECT {k}cov, count(*) AS n FROM co WHERE NOT EXISTS (SELECT 1 FROM left_out l WHERE l.id = r1{same("l", "co")}) GROUP BY {k}cov)"""


_HISTOGRAM = _EDGES + _histogram_sql("edges")
_GRID = _EDGES + """,
gd AS (SELECT edges.*, h::INTEGER AS h, e::DOUBLE AS e FROM edges, unnest(range(75, 100, 2)) AS t(h), unnest([0.05::DOUBLE, 0.1::DOUBLE, 0.15::DOUBLE]) AS u(e)
    WHERE overlap >= h AND nerr <= overlap * e)""" + _histogram_sql("gd", ("h", "e"))
_GRID_FIT = _GRID + """,
mo AS (SELECT h, e, coalesce(arg_max(cov, (n, -cov)) FILTER (cov >= 2), 2) AS mode, sum(n) AS total, greatest(max(cov), 499) AS last FROM hi GROUP BY h, e),
bi AS (
    SELECT mo.h, mo.e, mode, m, k, coalesce(n, 0) / total AS x,
        CASE WHEN m = 0 THEN (k = 0)::INTEGER::DOUBLE ELSE exp(-m + k * ln(m) - lgamma(k + 1)) END AS p
    FROM mo CROSS JOIN unnest(range(mode - 2, mode + 3)) AS t(m) CROSS JOIN unnest(range(0, last + 1)) AS u(k) LEFT JOIN hi ON hi.h = mo.h AND hi.e = mo.e AND hi.cov = k),
tv AS (SELECT h, e, mode, m, round(0.5 * sum(abs(x - p)) + 0.5 * (1 - sum(p)), 9) AS tv FROM bi GROUP BY ALL),
fit AS (SELECT h, e, coalesce(arg_min(m, (tv, m)) FILTER (tv < 1), any_value(mode) + 1) AS cov, coalesce(min(tv) FILTER (tv < 1), 1.0) AS tv FROM tv GROUP BY h, e)"""
ORACLES = {
    "confusion_normalize": f"WITH {SMOOTHED.format(1)} SELECT pos, true_b, called_b, round(p, 9) AS p, round(ln(p), 9) AS ll FROM cp",
    "likelihood_fill": f"WITH reads AS (SELECT 190 AS len), {SMOOTHED.format(1)}{LL} SELECT pos, base AS called_b, " + ", ".join(f"round(ll{b}, 9) AS ll{b}" for b in range(4)) + " FROM ll",
    "confusion_delta": f"""
        WITH {_MSTEP}, f AS (
            SELECT coalesce(c.w, 0) AS a, coalesce(ms.w, 0) AS b FROM confusion c FULL JOIN ms ON c.pos = ms.pos AND c.true_b = ms.true_b AND c.called_b = ms.called_b)
        SELECT round(sum(abs(a - b)) / sum(abs(a)), 4) AS delta FROM f""",
    "em_one_step": f"""
        WITH {_MSTEP} SELECT pos, true_b, called_b, round((w + 1) / sum(w + 1) OVER (PARTITION BY pos, called_b), 6) AS p FROM ms""",
    "first_coverage": f"WITH {_HIST} SELECT cov, n FROM hist",
    "poisson_fit": f"WITH {_FIT} SELECT cov, round(tv, 6) AS tv FROM fit",
    "coverage_histogram": f"WITH RECURSIVE {_HISTOGRAM} SELECT cov, n FROM hi",
    "param_grid_histograms": f"WITH RECURSIVE {_GRID} SELECT h, e, cov, n FROM hi",
    "param_select": f"WITH RECURSIVE {_GRID_FIT} SELECT h, e, cov, tv FROM fit ORDER BY tv, h, e LIMIT 1",
    "coverage_caps": f"WITH {_FIT} SELECT cov, greatest(3, ceil(round(cov + 5 * sqrt(cov), 9)))::INTEGER AS max_cov, 0 AS min_cov FROM fit",
}
