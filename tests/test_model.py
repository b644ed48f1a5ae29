import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.operators import clustering, model, voting
from strandweave.plans import base, model_queries, pipeline_queries, vote_queries
from strandweave.plans.pipeline import Options, correct


def test_independent_set_is_the_greedy_one(spark):
    rng = random.Random(2)
    links = {tuple(sorted(rng.sample(range(300), 2))) for _ in range(700)}
    kept, out = set(), set()
    near = {i: set() for i in range(300)}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    for i in range(300):
        if i not in out:
            kept.add(i)
            out |= near[i]
    df = spark.createDataFrame([(a, b) for a, b in links], "a long, b long")
    assert {r.id for r in model.not_independent(df).collect()} == out - kept


def test_histogram_of_a_subset_against_brute_force(spark):
    """Only reads of the subset are counted, and only they leave others out."""
    rng = random.Random(7)
    reads = {i: "".join(rng.choice("ACGTN") for _ in range(6)) for i in range(120)}
    pairs = {tuple(sorted(rng.sample(range(120), 2))) for _ in range(200)}
    offs = {p: rng.randint(-3, 3) for p in pairs}
    offs |= {(b, a): -o for (a, b), o in offs.items()} | {(i, i): 0 for i in range(120)}
    inside = {i for i in range(120) if rng.random() < 0.3}
    edges = [(a, b, o) for (a, b), o in offs.items() if a in inside]
    want, out = Counter(), set()
    for i in sorted(x for x in inside if x % 2 == 0):
        if i not in out:
            want[sum(o <= 0 and reads[b][-o] in "ACGT" for a, b, o in edges if a == i)] += 1
            out |= {b for a, b, _ in edges if a == i}
    rows = spark.createDataFrame([(i, s, i % 2 == 0, 6) for i, s in reads.items()], "read_id long, seq string, is_orig boolean, len int")
    got = model.coverage_histogram(spark.createDataFrame(edges, "r1 long, r2 long, offs int"), rows)
    assert {r.cov: r.n for r in got.collect()} == want


def test_poisson_fit(spark):
    hist = spark.createDataFrame([(k, round(1e6 * math.exp(-7 + k * math.log(7) - math.lgamma(k + 1)))) for k in range(30)], "cov long, n long")
    got = model.poisson_fit(hist).first()
    assert got.cov == 7 and got.tv < 1e-3
    assert model.poisson_fit(spark.createDataFrame([(0, 5), (1, 3)], "cov long, n long")).first().cov in (0, 1)


def test_heterozygous_column(spark):
    reads = spark.createDataFrame([(2 * i, "A" if i < 5 else "G", True, 1) for i in range(10)], "read_id long, seq string, is_orig boolean, len int")
    edges = spark.createDataFrame([(0, 2 * i, 0, int(i >= 5), 1, 1, 1) for i in range(10)], "r1 long, r2 long, offs int, nerr int, overlap int, len1 int, len2 int")
    ll = voting.likelihoods(None, 1, spark)
    het = voting.call(voting.columns(voting.placed(edges, reads), ll, 9, 0.01), 0, 0, 0.01).first()
    assert het.base == "R" and het.n == 10
    hom = voting.call(voting.columns(voting.placed(edges, reads), ll, 9), 0, 0).first()
    assert hom.base == "A"
    few = voting.call(voting.columns(voting.placed(edges, reads), ll, 9), 5, 0).first()
    assert few.base == "A" and not few.accepted


def test_column_without_votes(spark):
    reads = spark.createDataFrame([(0, "N", True, 1)], "read_id long, seq string, is_orig boolean, len int")
    edges = spark.createDataFrame([(0, 0, 0, 0, 1, 1, 1)], "r1 long, r2 long, offs int, nerr int, overlap int, len1 int, len2 int")
    got = voting.call(voting.columns(voting.placed(edges, reads), voting.likelihoods(None, 1, spark), 9), 0, 0).first()
    assert (got.base, got.qual, got.n) == ("N", "~", 0)


#: Seven gapped reads that form two clusters.
TOY = ["___ATGC", "GCGCTGC", "GCGCTAC", "GCGCT__", "TATATAT", "TCTAT__", "TATGTAT"]


def toy_matrix(spark):
    return spark.createDataFrame([(p, a, b, 0.997 if a == b else 0.001) for p in range(7) for a in range(4) for b in range(4)], "pos int, true_b int, called_b int, w double")


def test_toy_clusters(spark):
    m = clustering.Matrix(toy_matrix(spark), smoothing=0.0)
    brothers = spark.createDataFrame([(2, i, s) for i, s in enumerate(TOY)], "target_id long, read_id long, seq string")
    groups = spark.createDataFrame([(2, int(i > 3), i, s) for i, s in enumerate(TOY)], "target_id long, cluster int, read_id long, seq string")
    got = {r.cluster: r.center for r in clustering.centroids(groups, toy_matrix(spark), 0.0).collect()}
    assert got == {0: "GCGCTGC", 1: "TATATAT"}
    centers = spark.createDataFrame([(2, k, c) for k, c in got.items()], "target_id long, cluster int, center string")
    near = {r.read_id: r.cluster for r in clustering.nearest(clustering.distances(brothers, centers, m)).collect()}
    assert near == {i: int(i > 3) for i in range(7)}
    assert {r.read_id for r in clustering.cluster_neighbors(brothers, m).collect()} >= {2}


@pytest.mark.parametrize("recluster", [False, True])
def test_correct_mends_injected_errors(spark, recluster):
    rng = random.Random(11)
    strand = "".join(rng.choice("ACGT") for _ in range(300))
    truth, rows = {}, []
    for i in range(220):
        s = rng.randrange(250)
        seq = strand[s : s + 50]
        truth[i] = seq
        if rng.random() < 0.4:
            at = rng.randrange(50)
            seq = seq[:at] + rng.choice("ACGT".replace(seq[at], "")) + seq[at + 1 :]
        rows.append((i, seq))
    rows += [(900, "ACG"), (901, ""), (902, None)]
    truth[900] = "ACG"
    got = {r.src_row: r for r in correct(spark.createDataFrame(rows, "src_row long, seq string"), Options(subset=1.0, h_min=25, h_max=29, em_iterations=2, recluster=recluster)).collect()}
    assert set(got) == set(truth)
    wrong = sum(s != truth[i] for i, s in rows if i in truth)
    left = sum(got[i].seq != truth[i] for i in truth)
    assert wrong > 60 and left < wrong * 0.2
    assert all(len(r.qual) == len(r.seq) for r in got.values())


def test_fitting_queries_read_all_reads(spark, sf, monkeypatch):
    seen = {}
    monkeypatch.setattr(model, "em", lambda vote, *a: seen.update(em=vote))
    monkeypatch.setattr(model, "grid_histograms", lambda edges, *a: seen.update(grid=edges))
    model_queries.em_confusion(spark, sf)
    model_queries.param_grid_histograms(spark, sf)
    assert seen["em"].select("r1").distinct().count() == vote_queries.votes(spark, sf).select("r1").distinct().count()
    assert seen["grid"].count() == base.edges(spark, sf).count()
    assert Options().subset == 1


def test_registered_correction_runs_all_em_iterations(spark, sf, monkeypatch):
    monkeypatch.setattr(pipeline_queries, "_correct", lambda reads, options=None: options or Options())
    assert pipeline_queries.correct(spark, sf) == Options()
    assert Options().em_iterations == 10


def test_fit_sees_overlaps_by_frequent_kmers(spark, monkeypatch):
    class Seen(Exception):
        pass

    def seen(edges, *_):
        raise Seen(edges.where("r1 <> r2").count())

    monkeypatch.setattr(model, "grid_histograms", seen)
    rng = random.Random(3)
    read = "".join(rng.choice("ACGT") for _ in range(50))
    with pytest.raises(Seen) as got:
        correct(spark.createDataFrame([(i, read) for i in range(320)], "src_row long, seq string"))
    assert got.value.args[0] == 2 * 320 * 319


def test_large_target_is_fitted_on_all_sequences(spark):
    rng = random.Random(4)
    one, two = ("".join(rng.choice("ACGT") for _ in range(60)) for _ in range(2))
    seqs = [one[:i] + ("A" if one[i] != "A" else "C") + one[i + 1 :] for i in range(0, 60, 3)] + [two] * 8 + ["__" + two[2:]]
    large = [(t, i, x) for t in range(8) for i, x in enumerate(seqs)]  # seeds differ by target
    brothers = spark.createDataFrame([*large, (8, 0, two)], "target_id long, read_id long, seq string")
    table = [(p, a, b, 0.997 if a == b else 0.001) for p in range(60) for a in range(4) for b in range(4)]
    m = clustering.Matrix(spark.createDataFrame(table, "pos int, true_b int, called_b int, w double"), smoothing=0.0)
    got = {}
    for r in clustering.fit_centers(brothers, m, fit=4).collect():
        got.setdefault(r.target_id, set()).add(r.center)
    assert set(got) == set(range(9)) and got[8] == {two}
    assert sum(got[t] == {one, two} for t in range(8)) >= 2


def brute_centers(log, target, seqs, seed=1):
    """The same fit of one target by plain loops: one cluster number after the other, one read at a time."""
    distinct = sorted(set(seqs))
    n = [seqs.count(x) for x in distinct]
    like = lambda x, c: sum(log[p]["ACGT_".index(a)]["ACGT_".index(b)] for p, (a, b) in enumerate(zip(x, c, strict=True)))
    h = {x: clustering_hash(x) for x in distinct}
    variate = lambda x, *key: float(clustering.exponential(np.array([h[x]], np.int64), *key)[0])

    def seeds(k, stream):
        out = []
        for i in range(1, k + 1):
            for j in range(clustering.DRAWS):
                weight = [m * (max((1 - math.exp(max(like(x, c) for c in out))) ** 2, 1e-200) if out else 1) for x, m in zip(distinct, n, strict=True)]
                x = min(zip(distinct, weight, strict=True), key=lambda t: variate(t[0], seed, target, i, stream, j) / t[1])[0]
                new = ""
                for p, c in enumerate(x):
                    rows = [(y, m) for y, m in zip(distinct, n, strict=True) if y[p] != "_"]
                    new += min(rows, key=lambda t: math.log(variate(t[0], seed, target, i, stream, j, p)) - like(t[0], x) - math.log(t[1]))[0][p] if c == "_" and rows else c
                if new not in out:
                    break
            out.append(new)
        return out

    def kmeans(k):
        for stream in clustering.STREAMS:
            centers = seeds(k, stream)
            for _ in range(clustering.ITERATIONS):
                group = [min(range(k), key=lambda g: (round(1 - math.exp(like(x, centers[g])), 12), g)) for x in distinct]
                if len(set(group)) < k:
                    break
                made = []
                for g in range(k):
                    rows = [(x, m) for x, m, o in zip(distinct, n, group, strict=True) if o == g]
                    score = lambda p, b: round(sum(m * log[p]["ACGT".index(x[p])][b] for x, m in rows if x[p] != "_"), 9)  # noqa: E731, B023
                    made.append("".join("ACGT"[max(range(4), key=lambda b: (score(p, b), -b))] for p in range(len(distinct[0]))))
                total, sizes = 0.0, []
                for g in range(k):
                    rows = [(x, m) for x, m, o in zip(distinct, n, group, strict=True) if o == g]
                    sizes.append(sum(m for _, m in rows))
                    own = sum(m * sum(log[p]["ACGT_".index(b)]["ACGT_".index(a)] for p, (a, b) in enumerate(zip(x, centers[g], strict=True))) for x, m in rows)
                    total += own + sizes[-1] * (math.lgamma(sizes[-1]) - sum(math.lgamma(m) for _, m in rows))
                if k > 1:
                    total += math.lgamma(k) + sum(map(math.lgamma, sizes)) - math.lgamma(math.prod(sizes))
                if made == centers:
                    return made, total
                centers = made
        return None

    found, last, k = [], -math.inf, 1
    while k <= len(distinct) and (got := kmeans(k)) and got[1] > last:
        (found, last), k = got, k + 1
    return found


def clustering_hash(x):
    return HASHES[x]


HASHES = {}


@pytest.mark.parametrize("fit", [4096, 5])
def test_centers_equal_brute_force(spark, fit):
    """Whole targets and targets cut into parts that several tasks work on."""
    rng = random.Random(9)
    rows = []
    for t, kinds in enumerate([1, 2, 3, 5]):
        base = ["".join(rng.choice("ACGT") for _ in range(24)) for _ in range(kinds)]
        for i in range(4 + 5 * kinds):
            x = "".join(rng.choice("ACGT") if rng.random() < 0.02 else c for c in rng.choice(base))
            cut = rng.choice([0, 0, 3, 7])
            rows.append((t, i, "_" * cut + x[cut:] if rng.random() < 0.5 else x[: 24 - cut] + "_" * cut))
    brothers = spark.createDataFrame(rows, "target_id long, read_id long, seq string")
    HASHES.update({r.seq: r.h for r in brothers.select("seq", F.xxhash64("seq").alias("h")).collect()})
    table = [(p, a, b, 0.997 if a == b else 0.001) for p in range(24) for a in range(4) for b in range(4)]
    m = clustering.Matrix(spark.createDataFrame(table, "pos int, true_b int, called_b int, w double"), smoothing=0.0)
    kmeans = clustering.KMeans(brothers, m, 1, fit)
    assert kmeans.split == (fit == 5)
    got = {}
    for r in sorted(kmeans.best().collect(), key=lambda r: r.cluster):
        got.setdefault(r.target_id, []).append(r.center)
    log = m.wide(24)
    assert got == {t: brute_centers(log, t, [s for u, _, s in rows if u == t]) for t in range(4)}
    assert max(map(len, got.values())) > 1


def test_a_large_target_spreads_over_tasks(spark):
    reads = spark.range(100_000).select(F.lit(1).alias("target_id"), F.col("id").alias("read_id"), F.translate(F.substring(F.md5(F.col("id").cast("string")), 1, 24), "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"))
    table = [(p, a, b, 0.25) for p in range(24) for a in range(4) for b in range(4)]
    m = clustering.Matrix(spark.createDataFrame(table, "pos int, true_b int, called_b int, w double"), smoothing=0.0)
    blocks = clustering.KMeans(reads, m, 1, clustering.FIT).blocks.select("part", F.size("seqs").alias("n")).collect()
    assert len(blocks) == 25 and max(r.n for r in blocks) < 4500 and sum(r.n for r in blocks) == 100_000


def test_target_without_its_own_row_is_placed_by_its_read(spark):
    one, two = "ACGTTGCAAGCTTAGCCATGATCG", "TTACGGATCCGTAACGGTTAACCA"
    rows = [(7, i, one) for i in range(5)] + [(7, 10 + i, two) for i in range(5)]
    brothers = spark.createDataFrame(rows, "target_id long, read_id long, seq string")
    table = [(p, a, b, 0.997 if a == b else 0.001) for p in range(24) for a in range(4) for b in range(4)]
    m = clustering.Matrix(spark.createDataFrame(table, "pos int, true_b int, called_b int, w double"), smoothing=0.0)
    own = spark.createDataFrame([(7, two), (8, one)], "target_id long, seq string")
    assert {r.read_id for r in clustering.cluster_neighbors(brothers, m).collect()} == {r for _, r, _ in rows}
    centers = {r.center for r in clustering.fit_centers(brothers, m).collect()}
    want = {10, 11, 12, 13, 14} if len(centers) > 1 else {r for _, r, _ in rows}
    assert {r.read_id for r in clustering.cluster_neighbors(brothers, m, own=own).collect()} == want


def test_votes_of_a_deep_read_are_dealt_to_tasks(spark, monkeypatch):
    """The same columns whether one task adds up a read's edges, several do, or batches cut them."""
    rng = random.Random(6)
    strand = "".join(rng.choice("ACGT") for _ in range(60))
    reads = [(2 * i, "".join(rng.choice("ACGTN") if rng.random() < 0.1 else c for c in strand[: rng.choice([60, 40])]), True) for i in range(40)]
    reads += [(i + 1, s[::-1].translate(str.maketrans("ACGT", "TGCA")), False) for i, s, _ in reads]
    df = spark.createDataFrame([(*r, len(r[1])) for r in reads], "read_id long, seq string, is_orig boolean, len int")
    size = {r[0]: len(r[1]) for r in reads}
    edges = [(0, r, 0, 0, min(size[0], size[r]), size[0], size[r]) for r in size] + [(r, r, 0, 0, size[r], size[r], size[r]) for r in size if r]
    edges += [(2, r, 5, 0, min(size[2] - 5, size[r]), size[2], size[r]) for r in size if r != 2]
    placed = voting.placed(spark.createDataFrame(edges, "r1 long, r2 long, offs int, nerr int, overlap int, len1 int, len2 int"), df)
    ll = voting.likelihoods(None, 60, spark)
    key = lambda d: sorted((r.r1, r.col, r.n, r.orig or -1, *(round(v, 6) for v in r[4:])) for r in d.collect())
    for h_rate in (0.0, 0.01):
        whole = key(voting.columns(placed, ll, 9, h_rate))
        with monkeypatch.context() as m:
            m.setattr(voting, "DEEP", 7)
            assert key(voting.columns(placed, ll, 9, h_rate)) == whole
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
        try:
            assert key(voting.columns(placed, ll, 9, h_rate)) == whole
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_votes_of_many_reads_are_added_up_in_slices(spark, monkeypatch):
    """A batch with as many reads as rows made one array of all their columns, hundreds of MB for ten hypotheses."""
    rng = random.Random(12)
    widths = []

    class Counted:
        def __getattr__(self, name):
            return getattr(np, name)

        def zeros(self, shape, *args):
            widths.append(shape)
            return np.zeros(shape, *args)

    reads = [(2 * i, "".join(rng.choice("ACGTN") for _ in range(40)), True, 40) for i in range(60)]
    df = spark.createDataFrame(reads, "read_id long, seq string, is_orig boolean, len int")
    edges = [(2 * i, 2 * j, 0, 0, 40, 40, 40) for i in range(60) for j in {i, rng.randrange(60)}]
    placed = voting.placed(spark.createDataFrame(edges, "r1 long, r2 long, offs int, nerr int, overlap int, len1 int, len2 int"), df)
    table = voting.vote_table(voting.likelihoods(None, 40, spark), voting.hypotheses(0.01))
    batches = placed.orderBy("r1").toArrow().to_batches()
    whole = sorted(map(repr, (r for b in voting._column_sums(table)(iter(batches)) for r in b.to_pylist())))
    monkeypatch.setattr(voting, "COLUMNS", 200)
    monkeypatch.setattr(voting, "np", Counted())
    assert sorted(map(repr, (r for b in voting._column_sums(table)(iter(batches)) for r in b.to_pylist()))) == whole
    assert max(s[1] for s in widths if isinstance(s, tuple)) <= 200


def test_columns_are_joined_from_pieces(spark):
    """A row a column was shuffled; now a row a run of columns, whatever their order."""
    rng = random.Random(13)
    rows = [(r, c, rng.choice(["A", "C", None]), rng.choice("!~")) for r in range(9) for c in range(50) if (r + c) % 17]
    want = {r: tuple("".join(x[i] or "" for x in rows if x[0] == r) for i in (2, 3)) for r in range(9)}
    for order in (rows, rng.sample(rows, len(rows))):
        df = spark.createDataFrame(order, "r1 long, col int, base string, qual string")
        assert {x.read_id: (x.base, x.qual) for x in voting.joined_columns(df, "base", "qual").collect()} == want
    assert df.coalesce(1).orderBy("r1", "col").mapInArrow(voting._pieces, df.schema).count() < 50


def test_all_limits_share_rounds_and_rows(spark, monkeypatch):
    """Each limit had rows of its own: 39 times the edges were shuffled and written in every round."""
    rng = random.Random(14)
    reads = spark.createDataFrame([(i, "".join(rng.choice("ACGTN") for _ in range(30)), i % 2 == 0, 30) for i in range(80)], "read_id long, seq string, is_orig boolean, len int")
    edges = [(i, i, 0, 0, 30) for i in range(80) if i != 6]
    for a, b in {tuple(sorted(rng.sample(range(80), 2))) for _ in range(260)}:
        o, n, v = rng.randint(-9, 9), rng.randint(0, 5), rng.randint(10, 30)
        edges += [(a, b, o, n, v), (b, a, -o, n, v)]
    df = spark.createDataFrame(edges, "r1 long, r2 long, offs int, nerr int, overlap int")
    hs, es = [12, 18, 25], [0.05, 0.1, 0.2]
    want = {(h, e, *r) for h in hs for e in es for r in model.coverage_histogram(df.where(f"overlap >= {h} and nerr <= overlap * {e}D"), reads).collect()}
    rows = []
    keep = model.Scratch.keep
    monkeypatch.setattr(model.Scratch, "keep", lambda self, x: (y := keep(self, x), rows.append(y.count()))[0])
    for bits in (60, 4):
        monkeypatch.setattr(model, "BITS", bits)
        assert {tuple(r) for r in model.grid_histograms(df, reads, hs, es).collect()} == want
    assert max(rows) <= len(edges)
