"""Queries on clusters of aligned reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandweave.operators import clustering, overlaps
from strandweave.plans import base
from strandweave.plans.params import SMOOTHING, E, H
from strandweave.plans.vote_queries import SMOOTHED
from strandweave.sources.tables import table


def _brothers(spark, d):
    return clustering.clean_brothers(table(spark, d, "brothers"))


def _clusters(spark, d):
    return clustering.clean_clusters(table(spark, d, "clusters"))


def _members(spark, d):
    return clustering.members_of(_clusters(spark, d), _brothers(spark, d))


def _matrix(spark, d):
    return clustering.Matrix(table(spark, d, "confusion"), smoothing=SMOOTHING)


def read_distance(spark, d):
    pairs = clustering.distances(_brothers(spark, d), clustering.centers_of(_clusters(spark, d)), _matrix(spark, d))
    return pairs.withColumn("dist", F.round("dist", 6))


def nearest_centroid(spark, d):
    pairs = clustering.distances(_brothers(spark, d), clustering.centers_of(_clusters(spark, d)), _matrix(spark, d))
    return clustering.nearest(pairs).select("target_id", "read_id", "cluster")


def cluster_centroid(spark, d):
    return clustering.centroids(_members(spark, d), table(spark, d, "confusion"), SMOOTHING)


def kmeans_assign_step(spark, d):
    return clustering.kmeans_step(_brothers(spark, d), clustering.centers_of(_clusters(spark, d)), _matrix(spark, d), table(spark, d, "confusion"), SMOOTHING)


def log_multinomial(spark, d):
    return clustering.log_multinomial(_members(spark, d)).withColumn("value", F.round("value", 5))


def log_beta(spark, d):
    return clustering.log_beta(_members(spark, d)).withColumn("value", F.round("value", 4))


def cluster_loglik(spark, d):
    got = clustering.log_likelihood(_members(spark, d), clustering.centers_of(_clusters(spark, d)), _matrix(spark, d))
    return got.withColumn("loglik", F.round("loglik", 3))


def cluster_neighbors(spark, d):
    """A target that is not among its brothers is placed by its sequence in the read store."""
    own = base.reads(spark, d).select(F.col("read_id").alias("target_id"), "seq")
    return clustering.cluster_neighbors(_brothers(spark, d), _matrix(spark, d), own=own)


def cluster_semi_join(spark, d):
    """Overlaps of original reads, put into the read's columns, clustered, and kept within the read's cluster."""
    reads = base.stored_reads(spark, d)
    edges = overlaps.refilter(base.edges(spark, d, reads), H, E).join(reads.where("is_orig").select(F.col("read_id").alias("r1")), "r1", "left_semi")
    placed = overlaps.geometry(edges.select("r1", "r2", "offs", "nerr"), reads, keep_seqs=True)
    brothers = overlaps.in_frame(placed).select(F.col("r1").alias("target_id"), F.col("r2").alias("read_id"), F.col("padded").alias("seq"))
    return clustering.semi_join(edges, clustering.cluster_neighbors(brothers, _matrix(spark, d))).select("r1", "r2", "offs", "nerr")


QUERIES = {f.__name__: f for f in (read_distance, nearest_centroid, cluster_centroid, kmeans_assign_step, log_multinomial, log_beta, cluster_loglik, cluster_neighbors, cluster_semi_join)}

_BASE = """
br AS (
    SELECT target_id, read_id, arg_max(upper(seq), (loaded_at, upper(seq))) AS seq FROM brothers
    WHERE target_id IS NOT NULL AND read_id IS NOT NULL AND seq IS NOT NULL GROUP BY 1, 2),
cl AS (SELECT target_id, arg_max({'centers': centers, 'groups': groups}, (loaded_at, to_json(centers)::VARCHAR)) AS c FROM clusters WHERE target_id IS NOT NULL AND len(centers) > 0 AND groups IS NOT NULL GROUP BY 1),
ce AS (SELECT target_id, (i - 1)::INTEGER AS cluster, upper(c.centers[i]) AS center FROM cl, unnest(range(1, len(c.centers) + 1)) AS t(i)),
me AS (
    SELECT target_id, read_id, min(cluster) AS cluster, any_value(seq) AS seq
    FROM (SELECT target_id, (i - 1)::INTEGER AS cluster, unnest(c.groups[i]) AS read_id FROM cl, unnest(range(1, len(c.groups) + 1)) AS t(i)) JOIN br USING (target_id, read_id) GROUP BY 1, 2),""" + SMOOTHED.format(SMOOTHING)


def _dist(source: str, first: str, second: str, by: str) -> str:
    """Log-similarity of two aligned columns of a relation, per ``by``."""
    code = lambda c: f"instr('ACGT', substr({c}, (x + 1)::INTEGER, 1)) - 1"
    return f"""SELECT {by}, coalesce(sum(ln(p + 1e-6)), 0) AS s
        FROM (SELECT *, {code(first)} AS a, {code(second)} AS b FROM {source}, unnest(range(0, 150)) AS t(x)) LEFT JOIN cp ON pos = x AND true_b = a AND called_b = b GROUP BY {by}"""


def _centers(members: str) -> str:
    sums = ", ".join(f"round(coalesce(sum(n * p{b}), 0), 9) AS s{b}" for b in range(4))
    pick = " ".join(f"WHEN s{b} = greatest(s0, s1, s2, s3) THEN '{'ACGT'[b]}'" for b in range(4))
    return f"""
tb AS (SELECT pos, true_b AS base, {", ".join(f"max(ln(p)) FILTER (called_b = {b}) AS p{b}" for b in range(4))} FROM cp GROUP BY 1, 2),
ct AS (SELECT target_id, cluster, x AS pos, instr('ACGT', substr(seq, (x + 1)::INTEGER, 1)) - 1 AS base, count(*) AS n FROM {members}, unnest(range(0, 150)) AS t(x) GROUP BY ALL),
cs AS (SELECT target_id, cluster, ct.pos, {sums} FROM ct LEFT JOIN tb ON tb.pos = ct.pos AND tb.base = ct.base GROUP BY 1, 2, 3),
cc AS (SELECT target_id, cluster, string_agg(CASE {pick} END, '' ORDER BY pos) AS center FROM cs GROUP BY 1, 2),
centers AS (SELECT * FROM cc JOIN (SELECT target_id, cluster, count(*) AS size FROM {members} GROUP BY 1, 2) USING (target_id, cluster))"""


_PAIRS = _BASE + ", pr AS (SELECT * FROM br JOIN ce USING (target_id)), ds AS (" + _dist("pr", "seq", "center", "target_id, read_id, cluster") + """),
di AS (SELECT target_id, read_id, cluster, round(1 - exp(s), 9) AS dist FROM ds),
ne AS (SELECT target_id, read_id, arg_min(cluster, (dist, cluster)) AS cluster FROM di GROUP BY 1, 2)"""
_MULTI = """mu AS (
    SELECT target_id, cluster, lgamma(sum(n)) - sum(lgamma(n)) AS value FROM (SELECT target_id, cluster, seq, count(*)::DOUBLE AS n FROM me GROUP BY 1, 2, 3) GROUP BY 1, 2)"""
_BETA = """be AS (
    SELECT target_id, count(*) AS groups, sum(lgamma(n)) - lgamma(round(product(n))) AS value
    FROM (SELECT target_id, cluster, count(*)::DOUBLE AS n FROM me GROUP BY 1, 2) GROUP BY 1)"""
ORACLES = {
    "read_distance": f"WITH {_PAIRS} SELECT target_id, read_id, cluster, round(dist, 6) AS dist FROM di",
    "nearest_centroid": f"WITH {_PAIRS} SELECT * FROM ne",
    "cluster_centroid": f"WITH {_BASE}, {_centers('me')} SELECT * FROM centers",
    "kmeans_assign_step": f"WITH {_PAIRS}, nm AS (SELECT * FROM ne JOIN br USING (target_id, read_id)), {_centers('nm')} SELECT * FROM centers",
    "log_multinomial": f"WITH {_BASE}, {_MULTI} SELECT target_id, cluster, round(value, 5) AS value FROM mu",
    "log_beta": f"WITH {_BASE}, {_BETA} SELECT target_id, groups, round(value, 4) AS value FROM be",
    "cluster_loglik": f"""
        WITH {_BASE}, {_MULTI}, {_BETA}, pr AS (SELECT * FROM me JOIN ce USING (target_id, cluster)), ds AS ({_dist("pr", "center", "seq", "target_id, read_id, cluster")}),
        su AS (SELECT target_id, sum(s + value) AS members FROM ds JOIN mu USING (target_id, cluster) GROUP BY 1)
        SELECT target_id, groups AS k, round(members + CASE WHEN groups > 1 THEN lgamma(groups) + value ELSE 0 END, 3) AS loglik FROM su JOIN be USING (target_id)""",
}
