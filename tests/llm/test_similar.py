import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from strandweave.llm import queries, similar
from strandweave.llm.similar import clusters, described, membership

SCHEMA = "target_id long, read_id long, seq string, node long, cluster string"


def brute(rows, most=10):
    by = defaultdict(set)
    for t, r, s, *_ in rows:
        if None not in (t, r, s):
            by[t].add((r, s.upper()))
    out = set()
    for t, reads in by.items():
        reads = sorted(reads)
        group = list(range(len(reads)))
        for i, (r1, a) in enumerate(reads):
            for j, (r2, b) in enumerate(reads[:i]):
                pairs = [(x, y) for x, y in zip(a, b, strict=False) if x in "ACGT" and y in "ACGT"]
                if r1 == r2 or a == b or pairs and sum(x != y for x, y in pairs) * most <= len(pairs):
                    g, h = group[i], group[j]
                    group = [h if x == g else x for x in group]
        for g in set(group):
            ids = {reads[i][0] for i in range(len(reads)) if group[i] == g}
            if len(ids) > 1:
                out |= {(t, min(ids), r) for r in ids}
    return out


def found(spark, rows):
    c = clusters(spark.createDataFrame(rows, SCHEMA), "target_id", "read_id", "seq")
    return {tuple(r) for r in membership(c).collect()}


def noisy(rng, s, share):
    return "".join(rng.choice("ACGTN_acgt") if rng.random() < share else c for c in s)


@pytest.mark.parametrize("block", [1024, 7])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    rng = random.Random(block)
    rows = []
    for t in range(5):
        kinds = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(3)]
        for r in range([40, 3, 1, 25, 30][t]):
            cut = rng.randrange(20)
            s = "_" * cut + noisy(rng, rng.choice(kinds), rng.choice([0, 0.03, 0.08, 0.3]))[cut:]
            rows.append((t, r, s[: rng.choice([60, 60, 45])], 0, "x"))
    rows += rows[:10] + [(1, 50, None, 0, ""), (None, 1, "A", 0, ""), (1, None, "A", 0, ""), (6, 1, "", 0, ""), (6, 2, "____", 0, ""), (6, 3, "NNNN", 0, "")]
    rows += [(7, 1, "A" * 40, 0, ""), (7, 2, "a" * 40, 0, ""), (8, 1, "C" * 40, 0, ""), (8, 1, "G" * 40, 0, ""), (8, 2, "G" * 40, 0, "")]
    assert found(spark, rows) == brute(rows)


def test_chain_of_likeness_and_star(spark):
    steps = ["A" * (100 - 9 * i) + "C" * (9 * i) for i in range(11)]
    rng = random.Random(9)
    center = "".join(rng.choice("ACGT") for _ in range(100))
    star = [center[: i * 9] + "".join({"A": "C", "C": "G", "G": "T", "T": "A"}[c] for c in center[i * 9 : i * 9 + 9]) + center[i * 9 + 9 :] for i in range(11)]
    rows = [(1, i, s, 0, "") for i, s in enumerate(steps)] + [(2, i, s, 0, "") for i, s in enumerate([center, *star])]
    got = found(spark, rows)
    assert got == brute(rows) and len(got) == 23


def test_description(spark):
    rows = [(1, i, s, 0, "") for i, s in enumerate(["ACGTACGTAC__", "ACGTACGTACGT", "ACGTACGTACGA", "ACGTACGTACGT"])] + [(1, 9, "T" * 12, 0, ""), (2, 4, "NN", 0, "")]
    got = {(r.grp, r["first"]): (r.size, r.center, r.typical) for r in described(clusters(spark.createDataFrame(rows, SCHEMA), "target_id", "read_id", "seq"), 2).collect()}
    assert got == {(1, 0): (4, "ACGTACGTACGT", [0, 1]), (1, 9): (1, "T" * 12, [9]), (2, 4): (1, "__", [4])}


def average_linkage(sim, least):
    """Merges one mutually nearest pair after the other, each average computed anew from all pairs."""
    groups = [[i] for i in range(len(sim[0]))]
    while True:
        means = {}
        for i, a in enumerate(groups):
            for j, b in enumerate(groups[:i]):
                at = np.ix_(a, b)
                if sim[2][at].any():
                    means[j, i] = sim[0][at].sum() / sim[1][at].sum()
        pair = max(means, key=means.get, default=None)
        if pair is None or means[pair] < least:
            return {frozenset(g) for g in groups}
        groups[pair[0]] += groups.pop(pair[1])


def test_rounds_are_average_linkage():
    """Mutually nearest pairs merged at once give what merging the nearest pair of all gives."""
    rng = np.random.default_rng(4)
    for size in (2, 9, 30):
        seeds = rng.integers(0, 4, (3, 80))
        x = seeds[rng.integers(0, 3, size)]
        noise = rng.random(x.shape)
        x = np.where(noise < 0.04, rng.integers(0, 4, x.shape), x)
        x = np.where(rng.random(x.shape) < 0.1, 4, x).astype(np.uint8)
        sim = similar.compared(x, x, Fraction("0.1"))
        np.einsum("kii->ki", sim)[:] = 0
        want = average_linkage(sim, 0.9)
        rounds = similar.merged(sim.copy(), 0.9)
        # closing the clusters joins whole ones only
        assert all(len({int(rounds[i]) for i in g}) == 1 for g in want)
        linked = {frozenset(g) for g in average_linkage(sim, -1)}
        assert {frozenset(np.flatnonzero(rounds == c).tolist()) for c in set(rounds.tolist())} == linked


def test_clusters_of_the_test_tables(spark, sf):
    """Every cluster's size, centre and most typical reads, by brute force."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/brothers.parquet").select("target_id", "read_id", "seq").collect()]
    groups = defaultdict(set)
    for t, first, r in brute(rows):
        groups[t, first].add(r)
    seqs = {(t, r, s.upper()) for t, r, s in rows if None not in (t, r, s)}
    for t, r, _ in seqs:
        if not any(r in g for (u, _), g in groups.items() if u == t):
            groups[t, r] = {r}
    got = {(r.target_id, r.first_read): r for r in queries.p5_clusters(spark, sf).collect()}
    assert set(got) == set(groups)
    for (t, first), ids in groups.items():
        own = [(r, s) for u, r, s in seqs if u == t and r in ids]
        width = max(len(s) for _, s in own)
        center = ""
        for c in range(width):
            n = Counter(s[c : c + 1] for _, s in own if s[c : c + 1] in set("ACGT"))
            center += min(n, key=lambda b: (-n[b], b)) if n else "_"
        differ = defaultdict(lambda: width)
        for r, s in own:
            differ[r] = min(differ[r], sum(a != b for a, b in zip(s, center, strict=False) if a in "ACGT" and b in "ACGT"))
        row = got[t, first]
        assert (row["size"], row.center) == (len(ids), center)
        assert row.typical == sorted(ids, key=lambda r: (differ[r], r))[:3]


def test_empty_table(spark):
    assert found(spark, []) == set()
