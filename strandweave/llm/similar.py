"""Clusters of mutually similar aligned reads, by reciprocal nearest neighbours with average linkage.

1. Equal sequences of a group are one node.  The nodes of a group are dealt to blocks of bounded size.  A task
   compares a block by matrix products and merges in rounds: in each, all pairs of clusters that are each
   other's nearest, and whose average similarity is at the threshold, are merged.  The average is over all
   pairs of their nodes that have a common column, and only clusters with a link (two similar nodes) are
   neighbours in the sparse graph.
2. Where a group has several blocks, the clusters of any two of them are compared likewise; what leaves a task
   is a row for each pair of clusters with a link, with the sum of all similarities between them and their
   number.  On this graph rounds of Spark jobs merge all mutually nearest clusters at once.
3. Merging stops where no average is at the threshold.  The wanted clusters are all that links join, directly or
   through others, so further rounds by the same rule, without the threshold, then close them; the averages
   decide in which order clusters merge, never whether a link is lost.
4. A cluster is described by its centre (the most frequent base of each column), its size and the members
   that differ least from the centre.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.scratch import Scratch

#: Nodes of a block; two blocks are compared at a time.
BLOCK = 1024
#: Nodes that share a task's group where groups are small.
CELL = 4096
#: Columns that are compared at a time.
COLUMNS = 512
#: Parts in which the members of a cluster are ranked before the best of all parts are.
PARTS = 64


def _codes(seqs: list[str]) -> np.ndarray:
    """Codes 0 to 3 of A, C, G, T and 4 of all else, a row a sequence, short ones filled up."""
    width = max(map(len, seqs), default=0)
    raw = np.frombuffer("".join(s.ljust(width, "_") for s in seqs).encode("ascii", "replace"), np.uint8)
    table = np.full(256, 4, np.uint8)
    table[list(b"ACGTacgt")] = [0, 1, 2, 3, 0, 1, 2, 3]
    return table[raw].reshape(len(seqs), width)


def similarity(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every row of x against every row of y: columns where both show a base, and those that agree."""
    shared = np.zeros((len(x), len(y)), np.float32)
    agree = np.zeros_like(shared)
    for c in range(0, x.shape[1], COLUMNS):
        a, b = x[:, c : c + COLUMNS], y[:, c : c + COLUMNS]
        shared += (a < 4).astype(np.float32) @ (b < 4).astype(np.float32).T
        for k in range(4):
            agree += (a == k).astype(np.float32) @ (b == k).astype(np.float32).T
    return shared, agree


def compared(x: np.ndarray, y: np.ndarray, most: Fraction) -> np.ndarray:
    """Of every pair: its similarity, 1 if it has one, and 1 if it is a link."""
    shared, agree = similarity(x, y)
    link = (shared > 0) & ((shared - agree) * most.denominator <= shared * most.numerator)
    return np.stack([agree / np.maximum(shared, 1), shared > 0, link]).astype(np.float64)


def summed(pairs: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``pairs`` added up by the cluster of their row and column, clusters numbered from 0 without a gap."""
    for axis, c in ((1, a), (2, b)):
        order = np.argsort(c, kind="stable")
        pairs = np.add.reduceat(np.take(pairs, order, axis=axis), np.flatnonzero(np.append(True, np.diff(c[order]) != 0)), axis=axis)
    return pairs


def merged(pairs: np.ndarray, least: float) -> np.ndarray:
    """The cluster of each node of one block, after rounds that merge all mutually nearest clusters.

    ``pairs`` as of :func:`compared`.  The rounds end without an average of at least ``least``, then go on
    without this limit until no link is left.
    """
    n = pairs.shape[1]
    ids, cluster = np.arange(n), np.arange(n)
    mean = lambda p: np.where(p[2] > 0, p[0] / np.maximum(p[1], 1), -2.0)
    near = mean(pairs)
    np.fill_diagonal(near, -2.0)
    for limit in (least, -1.0):
        while True:
            here = np.arange(len(near))
            best = np.argmax(near, axis=1)  # of equal ones the first, so the greatest average is always mutual
            go = np.flatnonzero((best[best] == here) & (here > best) & (near[here, best] >= limit))
            if not len(go):
                break
            for x in go:
                y = best[x]
                pairs[:, y] += pairs[:, x]
                pairs[:, :, y] += pairs[:, :, x]
                cluster[cluster == ids[x]] = ids[y]
            to = best[go]
            near[to] = mean(pairs[:, to])
            near[:, to] = near[to].T
            near[go] = near[:, go] = -2.0
            near[to, to] = -2.0
            pairs[2, go] = pairs[2, :, go] = 0
            live = np.flatnonzero(near.max(axis=1) > -2.0)
            if 2 * len(live) <= len(near):  # clusters without neighbours are done
                ids, near, pairs = ids[live], near[np.ix_(live, live)], pairs[:, live[:, None], live]
            if not len(near):
                return np.unique(cluster, return_inverse=True)[1]
    return np.unique(cluster, return_inverse=True)[1]


def _blocks(t: pa.Table, *keys: str) -> Iterator[np.ndarray]:
    """Row numbers of each group of rows that agree in ``keys``, within a task."""
    codes = np.stack([t[k].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False) for k in keys])
    order = np.lexsort(codes)
    cut = np.flatnonzero(np.any(np.diff(codes[:, order], axis=1) != 0, axis=0)) + 1
    return np.split(order, cut)


def _within(most: Fraction):
    def run(t: pa.Table) -> pa.Table:
        """With ``label``, the least head in each node's cluster, block by block."""
        heads = t["head"].combine_chunks()
        rank = pc.rank(heads, tiebreaker="dense").to_numpy().astype(np.int64)
        place = np.zeros(rank.max(initial=0) + 1, np.int64)
        place[rank] = label = np.arange(t.num_rows)
        seqs = t["seq"].to_pylist()
        for at in _blocks(t, "grp", "block"):
            if len(at) > 1:
                x = _codes([seqs[i] for i in at])
                cluster = merged(compared(x, x, most), 1 - float(most))
                first = np.full(len(at), len(place))
                np.minimum.at(first, cluster, rank[at])
                label[at] = place[first[cluster]]
        t = t.append_column("label", heads.take(pa.array(label)))
        # only groups of several blocks are compared again
        return t.set_column(t.column_names.index("seq"), "seq", pc.if_else(pc.greater(t["blocks"], 1), t["seq"], None))

    return run


def _between(most: Fraction):
    def run(t: pa.Table) -> pa.Table:
        """Of two blocks of a group every pair of clusters with a link, and all similarities between them."""
        seqs, block = t["seq"].to_pylist(), t["block"].to_numpy()
        label = t["label"].combine_chunks()
        out = {"grp": [], "a": [], "b": [], "s": [], "n": []}
        for at in _blocks(t, "grp", "i", "j"):
            one, two = at[block[at] == block[at].min()], at[block[at] != block[at].min()]
            if len(two):
                (ca, a), (cb, b) = ((d.dictionary, d.indices.to_numpy(zero_copy_only=False)) for d in (label.take(pa.array(i)).dictionary_encode() for i in (one, two)))
                s, n, link = summed(compared(_codes([seqs[i] for i in one]), _codes([seqs[i] for i in two]), most), a, b)
                x, y = np.nonzero(link)
                out["grp"] += [t["grp"][int(at[0])].as_py()] * len(x)
                out["a"] += ca.take(pa.array(x)).to_pylist()
                out["b"] += cb.take(pa.array(y)).to_pylist()
                out["s"] += s[x, y].tolist()
                out["n"] += n[x, y].astype(np.int64).tolist()
        kinds = {"grp": t.schema.field("grp").type, "a": label.type, "b": label.type, "s": pa.float64(), "n": pa.int64()}
        return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})

    return run


def merge_rounds(edges: DataFrame, scratch: Scratch, least: float, max_rounds: int = 200) -> DataFrame | None:
    """``(grp, node, cluster)`` of every node that is merged into another one, by rounds of mutual best pairs.

    ``edges`` are ``(grp, a, b, s, n)``, the sum and number of similarities between neighbours.  Averages below
    ``least`` merge only once none is left above it.
    """
    tidy = lambda d: d.where("a != b").groupBy("grp", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    state = scratch.keep(tidy(edges))
    maps: list[DataFrame] = []
    limit = least
    for _ in range(max_rounds):
        if state.isEmpty():
            break
        ends = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))
        each = state.select("grp", (-F.col("s") / F.col("n")).alias("far"), ends.alias("e"))
        # of equally near neighbours the least, so the greatest average is always mutual
        best = each.groupBy("grp", "e.x").agg(F.min(F.struct("far", "e.y")).alias("m")).select("grp", "x", "m.y", "m.far")
        other = best.select("grp", F.col("x").alias("y"), F.col("y").alias("x"))
        go = best.join(other, ["grp", "x", "y"]).where((F.col("y") < F.col("x")) & (F.col("far") <= -limit))
        moved = scratch.keep(go.select("grp", F.col("x").alias("node"), F.col("y").alias("cluster")))
        if moved.isEmpty():
            limit = -1.0
            continue
        maps.append(moved)
        nxt = state
        for c in ("a", "b"):
            nxt = nxt.join(moved.select("grp", F.col("node").alias(c), F.col("cluster").alias("_to")), ["grp", c], "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
        nxt = scratch.keep(tidy(nxt))
        scratch.drop(state)
        state = nxt
    else:
        raise RuntimeError(f"clusters still merge after {max_rounds} rounds")
    # from the last round back: a node's cluster is where its cluster went later
    whole = None
    for moved in reversed(maps):
        if whole is not None:
            later = whole.select("grp", F.col("node").alias("cluster"), F.col("cluster").alias("then"))
            step = moved.join(later, ["grp", "cluster"], "left").select("grp", "node", F.coalesce("then", "cluster").alias("cluster"))
            moved = scratch.keep(step.unionByName(whole))
        whole = moved
    return whole


def clusters(df: DataFrame, group: str, member: str, seq: str, most_differ: float = 0.1) -> DataFrame:
    """``(grp, member, seq, cluster)``: every distinct non-null (group, member, sequence) and its cluster.

    Two members of one group are similar if they differ in at most ``most_differ`` of the columns in which
    both show A, C, G or T, in either case; members without a common column are not.  ``cluster`` is the
    same member for all members of one group that are joined by similarity.  Rows with a null sequence,
    group or member are left out, repeated rows count once, a member with several sequences is joined with
    itself, an empty or all-gap sequence is a cluster of its own, shorter ones are filled up with gaps; an
    empty table gives no rows; only the three named columns are read.
    """
    spark, most = df.sparkSession, Fraction(str(most_differ))
    scratch = Scratch(spark, "similar")
    rows = df.select(F.col(group).alias("grp"), F.col(member).alias("member"), F.upper(seq).alias("seq")).where("grp is not null and member is not null and seq is not null")
    # within a group 128 bits stand for a sequence
    rows = scratch.keep(rows.distinct().withColumns({"h1": F.xxhash64("seq"), "h2": F.xxhash64(F.lit(1), "seq")}))
    node = ["grp", "h1", "h2"]
    nodes = scratch.keep(rows.groupBy(*node).agg(F.min("member").alias("head"), F.first("seq").alias("seq")))
    sizes = nodes.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    # a group of many nodes is one row of ``sizes``: adaptive execution splits the other side
    placed = nodes.join(sizes, "grp").withColumn("block", F.pmod("h1", F.col("blocks")).cast("int"))
    cells = max(1, nodes.count() // CELL)
    cell = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("grp"), F.lit(cells))).otherwise(F.xxhash64("grp", "block"))
    # a given number of partitions is not merged by size: comparing takes far more time than its bytes suggest
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("grp", "member")}
    schema = f"grp {kinds['grp']}, h1 long, h2 long, head {kinds['member']}, seq string, block int, blocks int, label {kinds['member']}"
    placed = placed.select("grp", "h1", "h2", "head", "seq", "block", "blocks", cell.alias("cell")).repartition(n, "cell")
    found = scratch.keep(placed.groupBy("cell").applyInArrow(lambda t: _within(most)(t.drop_columns(["cell"])), schema))
    pairs = found.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other != block")
    pairs = pairs.select("grp", "label", "seq", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    pairs = pairs.withColumn("cell", F.xxhash64("grp", "i", "j")).repartition(n, "cell")
    edges = pairs.groupBy("cell").applyInArrow(_between(most), f"grp {kinds['grp']}, a {kinds['member']}, b {kinds['member']}, s double, n long")
    labels = found.select(*node, "label")
    several = rows.groupBy("grp", "member").agg(F.count("*").alias("m")).where("m > 1").select("grp", "member")
    own = rows.join(several, ["grp", "member"], "left_semi").join(labels, node).groupBy("grp", "member").agg(F.min("label").alias("a"), F.collect_set("label").alias("bs"))  # one member's sequences
    own = own.select("grp", "a", F.explode("bs").alias("b"), F.lit(1.0).alias("s"), F.lit(1).cast("long").alias("n"))
    moved = merge_rounds(edges.unionByName(own), scratch, 1 - float(most))
    out = rows.join(labels, node).select("grp", "member", "seq", "label")
    if moved is None:
        return out.withColumnRenamed("label", "cluster")
    return out.join(moved.withColumnRenamed("node", "label"), ["grp", "label"], "left").select("grp", "member", "seq", F.coalesce("cluster", "label").alias("cluster"))


def membership(found: DataFrame, least: int = 2) -> DataFrame:
    """``(grp, first, member)`` of all members of clusters with at least ``least`` distinct members."""
    one = found.select("grp", "cluster", "member").distinct()
    sizes = one.groupBy("grp", "cluster").agg(F.min("member").alias("first"), F.count("*").alias("size")).where(F.col("size") >= least)
    return one.join(sizes, ["grp", "cluster"]).select("grp", "first", "member").distinct()


def described(found: DataFrame, typical: int = 3) -> DataFrame:
    """``(grp, first, size, center, typical)``: each cluster's least member, number of members, centre and
    the ``typical`` members that differ from it in fewest columns (of equal ones the least)."""
    cols = found.withColumn("c", F.explode(F.sequence(F.lit(1), F.greatest(F.length("seq"), F.lit(1))))).withColumn("base", F.substring(F.col("seq"), F.col("c"), F.lit(1)))
    votes = cols.groupBy("grp", "cluster", "c", "base").agg(F.count("*").alias("n"))
    # a column without any base shows a gap; of equally frequent bases the first in the alphabet
    top = votes.groupBy("grp", "cluster", "c").agg(F.max_by("base", F.struct(F.when(F.col("base").isin(*"ACGT"), F.col("n")).otherwise(F.lit(0)), F.lit(0) - F.ascii("base"))).alias("base"))
    top = top.withColumn("base", F.when(F.col("base").isin(*"ACGT"), F.col("base")).otherwise("_"))
    center = top.groupBy("grp", "cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "base"))), lambda x: x["base"]), "").alias("center"))
    near = found.join(center, ["grp", "cluster"]).withColumn(
        "differ",
        F.size(F.filter(F.arrays_zip(F.split("seq", "").alias("x"), F.split("center", "").alias("y")), lambda z: z["x"].isin(*"ACGT") & z["y"].isin(*"ACGT") & (z["x"] != z["y"]))),
    )
    near = near.groupBy("grp", "cluster", "member").agg(F.min("differ").alias("differ"), F.first("center").alias("center"))
    # the k best of each cluster are taken in two steps, so that a large cluster is ranked in many tasks
    near = near.withColumn("part", F.pmod(F.xxhash64("member"), F.lit(PARTS)))
    order = [F.col("differ"), F.col("member")]
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("grp", "cluster", "part").orderBy(*order)))
    near = near.withColumn("best", F.when(F.col("r") <= typical, F.struct(*order)))
    part = near.groupBy("grp", "cluster", "part").agg(F.min("member").alias("first"), F.count("*").alias("size"), F.min("center").alias("center"), F.array_sort(F.collect_list("best")).alias("best"))
    return (
        part.groupBy("grp", "cluster")
        .agg(F.min("first").alias("first"), F.sum("size").alias("size"), F.min("center").alias("center"), F.array_sort(F.flatten(F.collect_list("best"))).alias("best"))
        .select("grp", "first", "size", "center", F.transform(F.slice("best", 1, typical), lambda x: x["member"]).alias("typical"))
    )
