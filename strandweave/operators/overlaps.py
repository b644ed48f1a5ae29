"""Overlaps between reads: candidates that share k-mers, mismatches, and the best alignment of each pair.

An edge (r1, r2, offs, nerr) says that r2 begins ``offs`` columns after r1 (before it, if negative).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.functions.dna import hamming
from strandweave.functions.once import computed
from strandweave.operators.kmers import frequency_filter, index_counts, with_order
from strandweave.operators.pairs import near_pairs
from strandweave.operators.ranking import first_per_key
from strandweave.scratch import Scratch

#: A k-mer seen more often is paired by several tasks, each with about so many of its left reads.
HEAVY = 1000


def rate() -> Column:
    """The share of mismatches of an edge."""
    return F.col("nerr") / F.col("overlap")


def start1(offs: Column) -> Column:
    """Where the overlap begins in the first read."""
    return F.greatest(offs, F.lit(0))


def start2(offs: Column) -> Column:
    """Where the overlap begins in the second read."""
    return F.greatest(-offs, F.lit(0))


def geometry(edges: DataFrame, reads: DataFrame, keep_seqs: bool = False) -> DataFrame:
    """Edges with ``len1``, ``len2``, ``st1``, ``st2`` and ``overlap``; those without a common column are left out."""
    cols = ["len", "seq"] if keep_seqs else ["len"]
    one = reads.select(F.col("read_id").alias("r1"), *[F.col(c).alias(f"{c}1") for c in cols])
    two = reads.select(F.col("read_id").alias("r2"), *[F.col(c).alias(f"{c}2") for c in cols])
    out = edges.join(one, "r1").join(two, "r2").withColumn("st1", start1(F.col("offs"))).withColumn("st2", start2(F.col("offs")))
    return out.withColumn("overlap", F.least(F.col("len1") - F.col("st1"), F.col("len2") - F.col("st2"))).where("overlap > 0")


def with_mismatches(placed: DataFrame, name: str = "nerr") -> DataFrame:
    """Differing columns of the overlap; an N differs from a base and equals an N."""
    a, b = (F.substring(F.col(f"seq{i}"), F.col(f"st{i}") + 1, F.col("overlap")) for i in (1, 2))
    # a filter on the count would otherwise count once more
    return computed(placed.drop(name), **{name: hamming(a, b)})


def clean_edges(neighbors: DataFrame, reads: DataFrame) -> DataFrame:
    """``(r1, r2, offs, nerr, overlap, len1, len2)`` in both directions, the best one of each pair, and every
    read as its own neighbour.

    Rows with a null end or offset are left out, a row of a read with itself is replaced by the exact one, a
    null ``nerr`` is counted from the reads; edges to reads that are not stored are dropped.
    """
    rows = neighbors.where("r1 is not null and r2 is not null and offs is not null and r1 <> r2")
    both = rows.select(F.explode(mirrored()).alias("e")).select("e.*")
    one = both.groupBy("r1", "r2", "offs").agg(F.max("nerr").alias("nerr"))
    placed = geometry(one, reads, keep_seqs=True)
    # known counts send nulls to the counting function, which is next to nothing
    a, b = (F.when(F.col("nerr").isNull(), F.substring(F.col(f"seq{i}"), F.col(f"st{i}") + 1, F.col("overlap"))) for i in (1, 2))
    scored = placed.withColumn("nerr", F.coalesce("nerr", hamming(a, b))).select("r1", "r2", "offs", "nerr", "overlap", "len1", "len2")
    own = reads.where("len > 0").select(F.col("read_id").alias("r1"), F.col("read_id").alias("r2"), F.lit(0).alias("offs"), F.lit(0).alias("nerr"), F.col("len").alias("overlap"), F.col("len").alias("len1"), F.col("len").alias("len2"))
    return best_alignments(scored).unionByName(own)


def mirrored() -> Column:
    """Both directions of an edge, to be exploded."""
    r1, r2, offs, nerr = (F.col(c) for c in ("r1", "r2", "offs", "nerr"))
    return F.array(
        F.struct(r1.alias("r1"), r2.alias("r2"), offs.alias("offs"), nerr.alias("nerr")),
        F.struct(r2.alias("r1"), r1.alias("r2"), (-offs).alias("offs"), nerr.alias("nerr")),
    )


def passes(h: Column | int, e: Column | float) -> Column:
    """The overlap is long enough and its share of mismatches small enough."""
    return (F.col("overlap") >= h) & (F.col("nerr") <= F.col("overlap") * e)


def refilter(edges: DataFrame, h: int, e: float) -> DataFrame:
    """Stored edges that pass stricter limits; the alignment is not chosen again."""
    return edges.where(passes(h, e))


def best_alignments(edges: DataFrame, tie: list[str] | None = None) -> DataFrame:
    """Of each pair the edge with the smallest share of mismatches; ties by ``tie``, then by offset."""
    rest = [c for c in edges.columns if c not in ("r1", "r2")]
    order = F.struct(rate().alias("rate"), *(tie or []), "offs")
    best = edges.groupBy("r1", "r2").agg(F.min_by(F.struct(*rest), order).alias("b"))
    return best.select("r1", "r2", *[f"b.{c}" for c in rest])


def paired(a: DataFrame, b: DataFrame, occurrences: DataFrame, left_read: str) -> DataFrame:
    """All pairs of ``a`` and ``b`` with a common k-mer; the left reads of a heavy k-mer are dealt to parts."""
    parts = index_counts(occurrences).where(F.col("occ") > HEAVY).select("kmer", F.ceil(F.col("occ") / HEAVY).cast("int").alias("_parts"))
    n = F.coalesce("_parts", F.lit(1))
    a = a.join(parts, "kmer", "left").withColumn("_part", F.pmod(F.xxhash64(left_read), n).cast("int")).drop("_parts")
    b = b.join(parts, "kmer", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), n - 1))).drop("_parts")
    return a.join(b, ["kmer", "_part"]).drop("_part")


def offset_candidates(occurrences: DataFrame, left: Column | None = None, spread: bool = False) -> DataFrame:
    """``(r1, r2, offs, khash, kmer)``, r1 < r2: distinct placements of two reads by a common k-mer, with the
    first such k-mer in the order of the index.  ``left`` limits r1.

    The shuffle is by k-mer; what a k-mer can pair is bounded by the frequency filter before it.  Without
    one, ``spread`` deals heavy k-mers to several tasks.
    """
    a = with_order(occurrences).select("kmer", "khash", F.col("read_id").alias("r1"), F.col("pos").alias("pos1"))
    b = occurrences.select("kmer", F.col("read_id").alias("r2"), F.col("pos").alias("pos2"))
    if left is not None:
        a = a.where(left)
    pairs = (paired(a, b, occurrences, "r1") if spread else a.join(b, "kmer")).where("r1 < r2")
    first = pairs.groupBy("r1", "r2", (F.col("pos1") - F.col("pos2")).alias("offs")).agg(F.min(F.struct("khash", "kmer")).alias("k"))
    return first.select("r1", "r2", "offs", "k.khash", "k.kmer")


def neighbor_join(occurrences: DataFrame, reads: DataFrame, h: int, e: float, max_cov: int, subset: Column | None = None) -> DataFrame:
    """``(r1, r2, offs, nerr)``: overlaps of at least ``h`` columns with at most a share ``e`` of mismatches
    between reads that share a k-mer, the best of each pair, in both directions; a read is its own neighbour.

    With ``subset`` (a condition on ``read_id``) the left reads are those of the subset.
    """
    if subset is None and max_cov <= 0:
        best = all_pairs(occurrences, reads, h, e).select("r1", "r2", "offs", "nerr")
        return with_own(best.select(F.explode(mirrored()).alias("e")).select("e.*"), reads, h)
    left = None if subset is None else subset
    few = frequency_filter(occurrences, max_cov)
    if max_cov > 0:  # read on both sides of the join
        few = Scratch(reads.sparkSession, "occurrences").keep(few)
    if subset is None:
        cand = offset_candidates(few)
    else:  # r1 in the subset on either side of the order: mirror what begins with a greater read
        tagged = few.withColumn("inside", left)
        a = with_order(tagged.where("inside")).select("kmer", "khash", F.col("read_id").alias("x"), F.col("pos").alias("px"))
        b = tagged.select("kmer", F.col("read_id").alias("y"), F.col("pos").alias("py"), F.col("inside").alias("y_inside"))
        pairs = (a.join(b, "kmer") if max_cov > 0 else paired(a, b, few, "x")).where("x <> y and (x < y or not y_inside)")
        first = pairs.groupBy(F.col("x").alias("r1"), F.col("y").alias("r2"), (F.col("px") - F.col("py")).alias("offs")).agg(F.min(F.struct("khash", "kmer")).alias("k"), F.max("y_inside").alias("y_inside"))
        cand = first.select("r1", "r2", "offs", "k.khash", "k.kmer", "y_inside")
    scored = with_mismatches(geometry(cand, reads, keep_seqs=True).where(F.col("overlap") >= h))
    rest = [c for c in ("y_inside",) if c in cand.columns]
    near = scored.where(passes(h, e)).select("r1", "r2", "offs", "nerr", "overlap", "khash", "kmer", *rest)
    best = best_alignments(near, ["khash", "kmer"])
    if subset is None:
        pairs = best.select(F.explode(mirrored()).alias("e")).select("e.*")
        own = reads
    else:
        pairs = best.select(F.explode(F.when(F.col("y_inside"), mirrored()).otherwise(F.slice(mirrored(), 1, 1))).alias("e")).select("e.*")
        own = reads.where(subset)
    return with_own(pairs, own, h)


def all_pairs(occurrences: DataFrame, reads: DataFrame, h: int, e: float) -> DataFrame:
    """``(r1, r2, offs, nerr, overlap, len1, len2)``, r1 < r2: what :func:`neighbor_join` has without a frequency filter, a row a pair."""
    near, odd = near_pairs(occurrences, reads, h, e)
    if odd is None:
        return near
    # pairs of reads that don't spell their k-mers are compared one by one
    tagged = occurrences.join(odd.withColumn("odd", F.lit(True)), "read_id", "left")
    a = with_order(tagged).select("kmer", "khash", F.col("read_id").alias("r1"), F.col("pos").alias("pos1"), F.col("odd").alias("odd1"))
    b = tagged.select("kmer", F.col("read_id").alias("r2"), F.col("pos").alias("pos2"), F.col("odd").alias("odd2"))
    pairs = paired(a, b, occurrences, "r1").where("r1 < r2 and (odd1 or odd2)")
    first = pairs.groupBy("r1", "r2", (F.col("pos1") - F.col("pos2")).alias("offs")).agg(F.min(F.struct("khash", "kmer")).alias("k"))
    placed = geometry(first.select("r1", "r2", "offs", "k.khash", "k.kmer"), reads, keep_seqs=True).where(F.col("overlap") >= h)
    rest = with_mismatches(placed).where(passes(h, e)).select(*near.columns, "khash", "kmer")
    return near.unionByName(best_alignments(rest, ["khash", "kmer"]).select(near.columns))


def both_ways(pairs: DataFrame, reads: DataFrame, h: int) -> DataFrame:
    """Rows of :func:`all_pairs` in both directions, and those of reads of at least ``h`` bases to themselves."""
    back = {"r1": "r2", "r2": "r1", "len1": "len2", "len2": "len1"}
    ways = [F.struct("r1", "r2", "offs", "nerr", "overlap", "len1", "len2"), F.struct(*[(-F.col(c) if c == "offs" else F.col(back.get(c, c))).alias(c) for c in pairs.columns])]
    id_, len_, none = F.col("read_id"), F.col("len"), F.lit(0)
    own = reads.where(len_ >= h).select(id_.alias("r1"), id_.alias("r2"), none.alias("offs"), none.alias("nerr"), len_.alias("overlap"), len_.alias("len1"), len_.alias("len2"))
    return pairs.select(F.explode(F.array(*ways)).alias("e")).select("e.*").unionByName(own)


def with_own(pairs: DataFrame, reads: DataFrame, h: int) -> DataFrame:
    """Edges and those of reads of at least ``h`` bases to themselves."""
    own = reads.where(F.col("len") >= h).select(F.col("read_id").alias("r1"), F.col("read_id").alias("r2"), F.lit(0).alias("offs"), F.lit(0).alias("nerr"))
    return pairs.unionByName(own)


def degree_cap(edges: DataFrame, cap: int) -> DataFrame:
    """The ``cap`` best edges of each read: fewest mismatches for their overlap, then the smallest id."""
    return first_per_key(edges, ["r1"], [rate(), F.col("r2")], cap)


def merge_neighbors(*lists: DataFrame) -> DataFrame:
    """Adjacency lists as one: of each pair the better alignment, of equal ones that of the earlier list."""
    whole = None
    for i, x in enumerate(lists):
        x = x.withColumn("list", F.lit(i))
        whole = x if whole is None else whole.unionByName(x)
    return best_alignments(whole, ["list"]).drop("list")


def in_frame(placed: DataFrame, name: str = "padded") -> DataFrame:
    """The second read in the columns of the first: cut at its ends, gaps where it has no base."""
    body = F.substring(F.col("seq2"), F.col("st2") + 1, F.col("overlap"))
    lead = F.repeat(F.lit("_"), F.col("st1"))
    return placed.withColumn(name, F.rpad(F.concat(lead, body), F.col("len1"), F.lit("_")))
