"""Base calls by votes of overlapping reads: likelihoods, maximum a posteriori bases, qualities."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.functions.dna import base_code, code_base, iupac, rounded
from strandweave.functions.once import computed

#: Hypotheses: one base, or two bases in alphabetical order.
HOMOZYGOUS = [(b, b) for b in range(4)]
HETEROZYGOUS = list(combinations_with_replacement(range(4), 2))
#: Edges of a read that one task adds up; those of a deeper one are dealt to several.
DEEP = 1 << 14
#: Columns of reads that a task adds up at once: some 12 MB of sums for ten hypotheses.
COLUMNS = 1 << 16
#: Quality letters: the lowest, and the greatest value above it.
LOWEST, GREATEST = 33, 93


def likelihoods(confusion: DataFrame | None, max_len: int, spark=None, smoothing: float = 1.0) -> DataFrame:
    """``(pos, called, ll0..ll3)``: the log-likelihood of a called base under each true one, by position.

    ``confusion`` holds counts ``(pos, true_b, called_b, w)``; a null counts 0.  Each gets ``smoothing``
    added and is divided by its called base's total at that position; positions from the table's last one
    up to ``max_len`` repeat that last one.  Without a table a call is right with probability 0.99.
    """
    if confusion is None:
        grid = spark.range(max_len).select(F.col("id").cast("int").alias("pos"), F.explode(F.array(*map(F.lit, range(4)))).alias("called"))
        return grid.select("pos", "called", *[F.when(F.col("called") == b, math.log(0.99)).otherwise(math.log(0.01 / 3)).alias(f"ll{b}") for b in range(4)])
    w = normalized(confusion, smoothing)
    table = w.groupBy("pos", F.col("called_b").alias("called")).agg(*[F.max(F.when(F.col("true_b") == b, F.log("p"))).alias(f"ll{b}") for b in range(4)])
    last = table.agg(F.max("pos").alias("last"))
    more = table.join(last, F.col("pos") == F.col("last")).where(F.col("last") < max_len - 1)
    fill = more.withColumn("pos", F.explode(F.sequence(F.col("last") + 1, F.lit(max_len - 1)))).select(table.columns)
    return table.unionByName(fill)


def normalized(confusion: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """``(pos, true_b, called_b, p)``: smoothed counts by the total of their called base at that position."""
    w = F.coalesce("w", F.lit(0.0)) + smoothing
    rows = confusion.select("pos", "true_b", "called_b", w.alias("w"))
    total = rows.groupBy("pos", "called_b").agg(F.sum("w").alias("total"))
    return rows.join(total, ["pos", "called_b"]).select("pos", "true_b", "called_b", (F.col("w") / F.col("total")).alias("p"))


def placed(edges: DataFrame, reads: DataFrame) -> DataFrame:
    """``(r1, st1, st2, len2, orig2, own, bases)``: one row an edge of an original read, with the neighbour's bases in the overlap."""
    two = reads.select(F.col("read_id").alias("r2"), F.col("seq").alias("seq2"), F.col("is_orig").alias("orig2"))
    one = reads.where("is_orig").select(F.col("read_id").alias("r1"))
    st1, st2 = F.greatest(F.col("offs"), F.lit(0)), F.greatest(-F.col("offs"), F.lit(0))
    return edges.join(one, "r1", "left_semi").join(two, "r2").select(
        "r1", st1.alias("st1"), st2.alias("st2"), "len2", "orig2", (F.col("r1") == F.col("r2")).alias("own"), F.substring(F.col("seq2"), st2 + 1, F.col("overlap")).alias("bases")
    )


def votes(edges: DataFrame, reads: DataFrame) -> DataFrame:
    """``(r1, col, pos, base, rc, own)``: one row a column of each edge of an original read.

    ``base`` is what the neighbour's original strand shows (complemented for a reverse complement), at
    ``pos`` of that strand; an N casts no vote and has a row, with a null base, only for the read itself.
    """
    rows = placed(edges, reads).select("r1", "st1", "st2", "len2", "orig2", "own", F.posexplode(F.split("bases", "")).alias("i", "letter")).where("letter <> ''")
    code = base_code(F.col("letter"))
    base = F.when(code < 4, F.when(F.col("orig2"), code).otherwise(3 - code))
    at = F.col("st2") + F.col("i")
    pos = F.when(F.col("orig2"), at).otherwise(F.col("len2") - at - 1)
    return rows.select("r1", (F.col("st1") + F.col("i")).alias("col"), pos.cast("int").alias("pos"), base.cast("int").alias("base"), (~F.col("orig2")).alias("rc"), "own").where("base is not null or own")


def prior_votes(cov: float, h_rate: float = 0.0) -> int:
    """How often an original read votes once more for its own bases."""
    return 0 if h_rate else max(1, math.floor(math.sqrt(cov)))


def hypotheses(h_rate: float) -> list[tuple[int, int]]:
    return HETEROZYGOUS if h_rate > 0 else HOMOZYGOUS


def vote_table(ll: DataFrame, pairs: list[tuple[int, int]]) -> np.ndarray:
    """Log-likelihoods [strand, pos, base, hypothesis] of a vote from :func:`likelihoods`; 0 where the table has none."""
    rows = ll.collect()  # four rows a position of a read
    one = np.zeros((1 + max((r.pos for r in rows), default=0), 4, 4))
    for r in rows:
        one[r.pos, r.called] = [r[f"ll{b}"] or 0.0 for b in range(4)]
    both = np.stack([one, one[:, :, ::-1]])  # a vote of the other strand speaks for the complement
    return np.stack([both[..., a] if a == b else np.log(0.5 * np.exp(both[..., a]) + 0.5 * np.exp(both[..., b])) for a, b in pairs], axis=-1)


def _column_sums(table: np.ndarray):
    """Tasks over edges sorted by read: sums over the votes of each column, a row a column."""
    deep, many = table.shape[1], table.shape[-1]
    flat = [np.ascontiguousarray(table[..., h]).ravel() for h in range(many)]
    code = np.full(256, 4, np.int64)
    code[list(b"ACGT")] = range(4)

    def sums(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """The reads of a batch and [column, read, value]: rows, votes, own base + 1, and two sums for each hypothesis."""
        r1, st1, st2, len2 = (b.column(c).to_numpy().astype(np.int64) for c in ("r1", "st1", "st2", "len2"))
        orig, own = (b.column(c).to_numpy(zero_copy_only=False) for c in ("orig2", "own"))
        text = b.column("bases").cast(pa.large_binary())
        _, off, data = text.buffers()
        off = np.frombuffer(off, np.int64)[text.offset : text.offset + len(text) + 1]
        called = code[np.frombuffer(data, np.uint8)[off[0] : off[-1]]] if data else np.zeros(0, np.int64)
        edge = np.repeat(np.arange(len(r1)), np.diff(off))
        i = np.arange(len(edge)) - (off[:-1] - off[0])[edge]
        new = np.append(True, r1[1:] != r1[:-1])
        reads = np.flatnonzero(new)
        col = st1[edge] + i
        width = int(col.max(initial=-1)) + 1
        key = (np.cumsum(new) - 1)[edge] * width + col
        out = np.zeros((3 + 2 * many, len(reads) * width))
        votes, mine = called < 4, own[edge]
        out[0] = np.bincount(key[votes | mine], minlength=out.shape[1])
        at, place = st2[edge] + i, key[votes]
        rc = ~orig[edge]
        base = np.where(rc, 3 - called, called)[votes]
        pos = np.where(rc, len2[edge] - at - 1, at)[votes]
        out[1] = np.bincount(place, minlength=out.shape[1])
        self_ = mine[votes]
        out[2, place[self_]] = base[self_] + 1
        look = (rc[votes].astype(np.int64) * deep + np.minimum(pos, deep - 1)) * 4 + base
        for h in range(many):
            value = flat[h][look]
            out[3 + h] = np.bincount(place, value, out.shape[1])
            out[3 + many + h, place[self_]] = value[self_]
        return r1[reads], out.reshape(len(out), len(reads), width)

    def rows(reads: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        read, col = np.nonzero(x[0])
        got = x[:, read, col]
        cols = [pa.array(reads[read]), pa.array(col.astype(np.int32)), pa.array(got[1].astype(np.int64)), pa.array((got[2] - 1).astype(np.int32), mask=got[2] == 0)]
        return pa.RecordBatch.from_arrays([*cols, *map(pa.array, got[3:])], names=["r1", "col", "n", "orig", *(f"s{h}" for h in range(many)), *(f"o{h}" for h in range(many))])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches cut to :data:`COLUMNS`; a batch as it comes may have as many reads as rows."""
        for b in batches:
            width = pc.max(pc.add(b.column("st1"), pc.binary_length(b.column("bases")))).as_py() or 1
            rows = max(1, COLUMNS // width)
            yield from (b.slice(i, rows) for i in range(0, b.num_rows, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last read so far, which the next slice may go on with
        for b in slices(batches):
            reads, x = sums(b)
            if held is not None:
                if held[0][0] == reads[0]:
                    width = max(held[1].shape[2], x.shape[2])
                    x = np.pad(x, ((0, 0), (0, 0), (0, width - x.shape[2])))
                    more = np.pad(held[1], ((0, 0), (0, 0), (0, width - held[1].shape[2])))[:, 0]
                    own = np.maximum(x[2, 0], more[2])
                    x[:, 0] += more
                    x[2, 0] = own
                else:
                    yield rows(*held)
            if len(reads) > 1:
                yield rows(reads[:-1], x[:, :-1])
            held = reads[-1:], x[:, -1:].copy()
        if held is not None:
            yield rows(*held)

    return run


def columns(placed: DataFrame, ll: DataFrame, cov: float, h_rate: float = 0.0) -> DataFrame:
    """``(r1, col, n, orig, l.., q..)``: of each column its votes, the read's own base, and the log-likelihood
    of each hypothesis with (l) and without (q) prior votes; both hold the hypothesis' prior.

    ``placed`` (of :func:`placed`, best stored) is shuffled by read, one row an edge; tasks add up the votes of whole
    columns in arrays.  The edges of a read with more than DEEP of them are dealt to several tasks, whose sums are added.
    """
    pairs = hypotheses(h_rate)
    many = range(len(pairs))
    run = _column_sums(vote_table(ll, pairs))
    values = [f"{x}{h}" for x in "so" for h in many]
    schema = "r1 long, col int, n long, orig int, " + ", ".join(f"{v} double" for v in values)
    deep = placed.groupBy("r1").agg(F.count("*").alias("edges")).where(F.col("edges") > DEEP)
    sums = placed.join(deep, "r1", "left_anti").repartition("r1").sortWithinPartitions("r1").mapInArrow(run, schema)
    dealt = placed.join(deep, "r1").withColumn("part", F.pmod(F.xxhash64("bases", "st1", "st2"), F.ceil(F.col("edges") / DEEP)))
    parts = dealt.repartition("r1", "part").sortWithinPartitions("r1").drop("part", "edges").mapInArrow(run, schema)
    sums = sums.unionByName(parts.groupBy("r1", "col").agg(F.sum("n").alias("n"), F.max("orig").alias("orig"), *[F.sum(v).alias(v) for v in values]))
    extra, out = prior_votes(cov, h_rate), []
    for h, (a, b) in enumerate(pairs):
        prior = math.log(0.25) + math.log(1 - h_rate) if a == b else -math.log(6) + math.log(h_rate)
        out += [rounded(F.col(f"s{h}") + F.col(f"o{h}") * extra + prior, 9).alias(f"l{a}{b}"), rounded(F.col(f"s{h}") + prior, 9).alias(f"q{a}{b}")]
    return sums.select("r1", "col", "n", "orig", *out)


def best(pairs: list[tuple[int, int]]) -> Column:
    """The number of the first hypothesis with the greatest likelihood."""
    top = F.greatest(*[F.col(f"l{a}{b}") for a, b in pairs])
    return reduce(lambda c, x: c.when(F.col(f"l{x[1][0]}{x[1][1]}") == top, x[0]), list(enumerate(pairs))[1:], F.when(F.col(f"l{pairs[0][0]}{pairs[0][1]}") == top, 0))


def call(cols: DataFrame, max_votes: int, min_votes: int, h_rate: float = 0.0) -> DataFrame:
    """Columns with ``mapped`` (the best base or genotype letter), ``accepted``, ``base`` and ``qual``.

    A column with no votes, too many (``max_votes``, 0 for no limit) or too few keeps its base.  The quality
    is the share of the other hypotheses on the logarithmic scale, by vote, as a letter; a column that keeps
    an unknown base, or has no doubt at all, has the greatest one.
    """
    pairs = hypotheses(h_rate)
    pick = lambda key, value: reduce(lambda c, x: c.when(F.col(key) == x[0], value(*x[1])), list(enumerate(pairs))[1:], F.when(F.col(key) == 0, value(*pairs[0])))
    few = (F.col("n") != 0) & (F.col("n") >= min_votes)
    accepted = few & (F.col("n") <= max_votes) if max_votes else few
    homozygous = [(i, a) for i, (a, b) in enumerate(pairs) if a == b]
    own = reduce(lambda c, x: c.when(F.col("orig") == x[1], x[0]), homozygous[1:], F.when(F.col("orig") == homozygous[0][1], homozygous[0][0]))
    df = computed(cols, best=best(pairs), accepted=accepted)
    df = computed(df, ref=F.when(F.col("accepted"), F.col("best")).otherwise(own), mapped=iupac(pick("best", lambda a, b: F.lit(a)), pick("best", lambda a, b: F.lit(b))))
    df = computed(df, q_ref=pick("ref", lambda a, b: F.col(f"q{a}{b}")))
    # the odds of all other hypotheses against the chosen one, summed without it, so that small ones don't vanish
    others = reduce(lambda x, y: x + y, [F.when(F.col("ref") == i, 0.0).otherwise(F.exp(F.col(f"q{a}{b}") - F.col("q_ref"))) for i, (a, b) in enumerate(pairs)])
    df = computed(df, others=others)
    error = F.col("others") / (F.col("others") + 1)
    score = F.floor(rounded(-10 * F.log10(error) / F.greatest(F.lit(1), F.col("n")), 6))
    qual = F.when(error >= 1e-100, F.least(F.lit(GREATEST), F.greatest(F.lit(0), score)) + LOWEST).otherwise(LOWEST + GREATEST)
    base = F.when(F.col("accepted"), F.col("mapped")).otherwise(F.coalesce(code_base(F.col("orig")), F.lit("N")))
    return df.withColumn("base", base).withColumn("qual", F.chr(F.coalesce(qual, F.lit(LOWEST + GREATEST))))


def expected_calls(called: DataFrame, h_rate: float = 0.0) -> DataFrame:
    """``(pos, true_b, called_b, w)``: posterior counts of true and called bases over all columns, rejected
    ones too; half of a genotype's share counts for each of its bases."""
    pairs = hypotheses(h_rate)
    # the posterior doesn't depend on the hypothesis that the odds are taken against
    called = computed(called.where("orig is not null"), top=F.greatest(*[F.col(f"q{a}{b}") for a, b in pairs]))
    called = computed(called, **{f"e{a}{b}": F.exp(F.col(f"q{a}{b}") - F.col("top")) for a, b in pairs})
    called = computed(called, total=reduce(lambda x, y: x + y, [F.col(f"e{a}{b}") for a, b in pairs]))
    share = [F.col(f"e{a}{b}") / F.col("total") * 0.5 for a, b in pairs]
    sums = [F.sum(reduce(lambda x, y: x + y, [w for w, p in zip(share, pairs, strict=True) for c in p if c == b])).alias(f"w{b}") for b in range(4)]
    rows = called.groupBy(F.col("col").alias("pos"), F.col("orig").alias("called_b")).agg(*sums)
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("true_b"), F.col(f"w{b}").alias("w")) for b in range(4)])).alias("s")
    return rows.select("pos", "called_b", each).select("pos", "s.true_b", "called_b", "s.w")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(r1, col, values..)`` whose columns follow each other, as one row with the first column and the joined values."""
    for b in batches:
        if not b.num_rows:
            continue
        r1, col = (b.column(c).to_numpy() for c in ("r1", "col"))
        at = np.flatnonzero(np.append(True, (r1[1:] != r1[:-1]) | (col[1:] != col[:-1] + 1)))
        texts = []
        for x in b.columns[2:]:
            # the letters of a run are one stretch of the buffer, where nulls have none
            offsets = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
            texts.append(pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(offsets[at], offsets[-1])), x.buffers()[2]))
        yield pa.RecordBatch.from_arrays([pa.array(r1[at]), pa.array(col[at]), *texts], names=b.schema.names)


def joined_columns(called: DataFrame, *names: str) -> DataFrame:
    """One row a read: each named column's values by column, as one string.

    Tasks have a read's columns in order, so what is shuffled is a few pieces of a read and not a row a column.
    """
    rows = called.select("r1", "col", *names)
    rows = rows.mapInArrow(_pieces, rows.schema).groupBy("r1").agg(F.sort_array(F.collect_list(F.struct("col", *names))).alias("c"))  # at most a read's length
    return rows.select(F.col("r1").alias("read_id"), *[F.array_join(F.col(f"c.{n}"), "").alias(n) for n in names])


def corrected(called: DataFrame, reads: DataFrame) -> DataFrame:
    """``(read_id, src_row, seq, qual)`` of the original reads."""
    out = joined_columns(called, "base", "qual").withColumnsRenamed({"base": "seq"})
    return out.join(reads.where("is_orig").select("read_id", "src_row"), "read_id").select("read_id", "src_row", "seq", "qual")
