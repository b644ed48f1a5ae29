"""Connected components of pairwise links by hash-to-min.

The cluster set of a vertex is held as rows (vertex, member), never as one collected set.  In a round every
vertex sends its whole set to its least member and the least member to all others of its set:
(v, u) becomes (m, u) and (u, m) for the least member m of v's set.  The sets are stable when each vertex
holds its group's least vertex; that takes a number of rounds logarithmic in the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.scratch import Scratch


def groups(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``(group_id, id)``: every vertex linked to another one, with the least vertex it is linked to directly or not.

    Rows with a null end and links of a vertex with itself link nothing (their vertices appear only if other
    rows link them); repeated and reversed links count once; an empty table gives no rows; further columns
    are not read.  Each round's rows are written to the shared folder, so a lost executor costs one round.
    """
    spark = links.sparkSession
    x, y = F.col(a), F.col(b)
    ends = links.select(x.alias("v"), y.alias("u")).where(x.isNotNull() & y.isNotNull() & (x != y))
    both = F.explode(F.array(F.struct(F.col("v"), F.col("u")), F.struct(F.col("u").alias("v"), F.col("v").alias("u"))))
    scratch = Scratch(spark, "components")
    state = scratch.keep(ends.select(both.alias("e")).select("e.v", "e.u").distinct())
    before = None
    for _ in range(max_rounds):
        now = state.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u"))).first()
        if tuple(now) == before or not now[0]:
            return state.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("m")).select(F.least("id", "m").alias("group_id"), "id")
        before = tuple(now)
        least = state.groupBy("v").agg(F.min("u").alias("u1")).select("v", "u1", F.least("v", "u1").alias("m"))
        # a vertex with very many members is one row of ``least``: adaptive execution splits its other side
        both = lambda x: [F.struct(F.col("m").alias("v"), F.col(x).alias("u")), F.struct(F.col(x).alias("v"), F.col("m").alias("u"))]
        # the vertex belongs to its own set: it is sent beside its first member
        sent = state.join(least, "v").select(F.explode(F.when(F.col("u") == F.col("u1"), F.array(*both("u"), *both("v"))).otherwise(F.array(*both("u")))).alias("e"))
        nxt = scratch.keep(sent.select("e.v", "e.u").where("v != u").distinct())
        scratch.drop(state)
        state = nxt
    raise RuntimeError(f"links were not stable after {max_rounds} rounds")
