import random

from pyspark.sql import functions as F

from strandweave.operators import kmers, overlaps, pairs


def reads_df(spark, seqs):
    rows = [(i, s, i % 2 == 0, len(s)) for i, s in enumerate(seqs)]
    return spark.createDataFrame(rows, "read_id long, seq string, is_orig boolean, len int")


def brute(seqs, k, h, e):
    """Best placement of each pair of reads that share a k-mer (first of an original, last of a complement)."""
    def occ(i, s):
        at = {}
        for p in range(len(s) - k + 1):
            w = s[p : p + k]
            if i % 2 or w not in at:
                at[w] = p
        return at

    index = [occ(i, s) for i, s in enumerate(seqs)]
    out = {(i, i, 0, 0) for i, s in enumerate(seqs) if len(s) >= h}
    for a in range(len(seqs)):
        for b in range(a + 1, len(seqs)):
            best = None
            for w in index[a].keys() & index[b].keys():
                off = index[a][w] - index[b][w]
                x, y = max(off, 0), max(-off, 0)
                n = min(len(seqs[a]) - x, len(seqs[b]) - y)
                err = sum(c != d for c, d in zip(seqs[a][x : x + n], seqs[b][y : y + n], strict=True))
                code = sum({"C": 1, "G": 2, "T": 3}.get(c, 0) << (2 * (i % 16)) for i, c in enumerate(w)) % (1 << 32)
                if n >= h and err <= n * e and (best is None or (err / n, code, w) < best[0]):
                    best = ((err / n, code, w), off, err)
            if best:
                out |= {(a, b, best[1], best[2]), (b, a, -best[1], best[2])}
    return out


def test_neighbor_join_against_brute_force(spark):
    rng = random.Random(5)
    strand = "".join(rng.choice("ACGT") for _ in range(200))
    seqs = []
    for _ in range(24):
        s = rng.randrange(150)
        read = list(strand[s : s + rng.choice([30, 36, 5])])
        if read and rng.random() < 0.5:
            read[rng.randrange(len(read))] = rng.choice("ACGTN")
        seqs.append("".join(read))
    seqs += [seqs[0], seqs[0], "ACACACACACACACACACACAC", "N" * 30]
    reads = reads_df(spark, seqs)
    index = kmers.dedupe(kmers.explode_kmers(reads, 8))
    got = overlaps.neighbor_join(index, reads, 15, 0.2, 0)
    want = brute(seqs, 8, 15, 0.2)
    assert {tuple(r) for r in got.collect()} == want
    part = overlaps.neighbor_join(index, reads, 15, 0.2, 0, F.col("read_id") < 9)
    assert {tuple(r) for r in part.collect()} == {x for x in want if x[0] < 9}


def test_heavy_kmers_in_parts(spark, monkeypatch):
    monkeypatch.setattr(overlaps, "HEAVY", 3)
    rng = random.Random(6)
    strand = "".join(rng.choice("ACGT") for _ in range(40))
    seqs = [strand[s : s + 25] for s in (rng.randrange(16) for _ in range(20))]
    reads = reads_df(spark, seqs)
    index = kmers.dedupe(kmers.explode_kmers(reads, 8))
    want = brute(seqs, 8, 15, 0.2)
    assert {tuple(r) for r in overlaps.neighbor_join(index, reads, 15, 0.2, 0).collect()} == want
    part = overlaps.neighbor_join(index, reads, 15, 0.2, 0, F.col("read_id") < 9)
    assert {tuple(r) for r in part.collect()} == {x for x in want if x[0] < 9}



def test_frequency_filter_at_its_limit(spark):
    rows = [("A", i, 0) for i in range(6)] + [("C", i, 0) for i in range(5)]
    occ = spark.createDataFrame(rows, "kmer string, read_id long, pos int")
    assert {r.kmer for r in kmers.frequency_filter(occ, 2).collect()} == {"C"}
    assert kmers.frequency_filter(occ, 0).count() == 11


def test_short_reads_have_no_kmers(spark):
    assert kmers.explode_kmers(reads_df(spark, ["", "ACG", "ACGT"]), 4).count() == 1


def test_gap_padding_of_unequal_lengths(spark):
    reads = reads_df(spark, ["ATGCATGCA", "TGCATGC", "CCATGCATGCAGG"])
    edges = spark.createDataFrame([(0, 1, 1, 0), (0, 2, -2, 0), (1, 0, -1, 0)], "r1 long, r2 long, offs int, nerr int")
    got = {(r.r1, r.r2): r.padded for r in overlaps.in_frame(overlaps.geometry(edges, reads, True)).collect()}
    assert got == {(0, 1): "_TGCATGC_", (0, 2): "ATGCATGCA", (1, 0): "TGCATGC"}


def test_degree_cap_and_merge(spark):
    edges = spark.createDataFrame([(1, i, 0, i, 100) for i in range(10)], "r1 long, r2 long, offs int, nerr int, overlap int")
    assert {r.r2 for r in overlaps.degree_cap(edges, 3).collect()} == {0, 1, 2}
    other = spark.createDataFrame([(1, 5, 9, 1, 100), (1, 6, 9, 6, 100)], edges.schema)
    merged = {r.r2: r.offs for r in overlaps.merge_neighbors(edges, other).collect()}
    assert merged[5] == 9 and merged[6] == 0


def test_join_by_all_kmers_shuffles_what_passes(spark, monkeypatch):
    """Every candidate was shuffled with its k-mer; now a pair without another common k-mer isn't shuffled at all."""
    rng = random.Random(8)
    strand = "".join(rng.choice("ACGT") for _ in range(60))
    seqs = [strand[s : s + 25] for s in (rng.randrange(36) for _ in range(40))] + ["GAAAT" * 6, "AAATG" * 6, "ACGNN" * 6, strand[:9], ""]
    reads = reads_df(spark, seqs)
    index = kmers.dedupe(kmers.explode_kmers(reads, 8))
    few = index.where("pos % 9 = 0")  # k-mers by which many pairs meet once
    lone = overlaps.near_pairs(few, reads, 12, 0.2)[0]
    assert lone.count() > 20 and lone.count() == lone.select("r1", "r2").distinct().count()
    for block, size in ((1 << 13, 1 << 17), (3, 5)):
        monkeypatch.setattr(pairs, "BLOCK", block)
        monkeypatch.setattr(pairs, "PAIRS", size)
        assert {tuple(r) for r in overlaps.neighbor_join(index, reads, 15, 0.2, 0).collect()} == brute(seqs, 8, 15, 0.2)
        got = overlaps.neighbor_join(few, reads, 12, 0.2, 0).collect()
        assert len(got) == len(set(map(tuple, got)))
        old = overlaps.neighbor_join(few, reads, 12, 0.2, 1 << 20).collect()  # a limit that drops nothing
        assert set(map(tuple, got)) == set(map(tuple, old))


def test_join_by_all_kmers_shuffles_no_pair(spark, monkeypatch):
    """A pair with several common k-mers was shuffled for each of them; now one cell yields it, and the shuffles are by occurrence."""
    rng = random.Random(9)
    unit = ["".join(rng.choice("ACGT") for _ in range(9)) for _ in range(4)]
    pieces = [w for u in unit for w in (u, u[:4] + rng.choice("ACGTN") + u[5:])]
    seqs = ["".join(rng.choice(pieces) for _ in range(rng.choice([3, 4, 5]))) for _ in range(70)] + ["ACACACACACACACACAC", "CACACACACACACACACACA", "NNNNNNNNNNNNNNNN"]
    reads = reads_df(spark, seqs)
    index = kmers.dedupe(kmers.explode_kmers(reads, 7))
    whole, odd = overlaps.near_pairs(index, reads, 12, 0.3)
    want = brute(seqs, 7, 12, 0.3)
    assert odd is None and {tuple(r)[:4] for r in whole.collect()} == {x for x in want if x[0] < x[1]}
    assert whole.count() == sum(x[0] < x[1] for x in want) > 500
    assert {(r.r1, r.r2): (r.len1, r.len2) for r in whole.collect()} == {x[:2]: (len(seqs[x[0]]), len(seqs[x[1]])) for x in want if x[0] < x[1]}
    monkeypatch.setattr(pairs, "BLOCK", 5)
    got = overlaps.neighbor_join(index, reads, 12, 0.3, 0)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_join_by_kmers_that_reads_do_not_spell(spark):
    """The join goes by the k-mers of the index, whatever the reads say."""
    rng = random.Random(10)
    strand = "".join(rng.choice("ACGT") for _ in range(60))
    seqs = [strand[s : s + 25] for s in (rng.randrange(36) for _ in range(20))] + [strand[5:15] + "R" + strand[16:30]]
    reads = reads_df(spark, seqs)
    index = kmers.dedupe(kmers.explode_kmers(reads, 8)).where("pos % 2 = 0 or read_id <> 3")
    index = index.unionByName(spark.createDataFrame([("ACGTACGT", 3, 2), ("ACGTACGT", 4, 9), ("GG", 5, 1), ("GG", 6, 30)], "kmer string, read_id long, pos int"))
    got = overlaps.neighbor_join(index, reads, 12, 0.9, 0).collect()
    old = overlaps.neighbor_join(index, reads, 12, 0.9, 1 << 20).collect()  # a limit that drops nothing
    assert sorted(map(tuple, got)) == sorted(map(tuple, old))
    assert overlaps.near_pairs(index, reads, 12, 0.9)[1].count() >= 3


def test_stored_pairs_in_both_directions(spark):
    """A pair is one row where it is stored; with the reads' own rows it is what the join and the reads' lengths make."""
    rng = random.Random(12)
    strand = "".join(rng.choice("ACGT") for _ in range(60))
    reads = reads_df(spark, [strand[s : s + rng.choice([20, 25])] for s in (rng.randrange(36) for _ in range(20))] + ["ACG"])
    index = kmers.dedupe(kmers.explode_kmers(reads, 8))
    got = overlaps.both_ways(overlaps.all_pairs(index, reads, 12, 0.2), reads, 12)
    want = overlaps.geometry(overlaps.neighbor_join(index, reads, 12, 0.2, 0), reads).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.schema == want.schema
