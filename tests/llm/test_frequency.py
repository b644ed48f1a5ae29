import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from strandweave.llm.burst_trie import SCHEMA, BurstTrie, combine, cut, pack, unpack
from strandweave.llm.frequency import marked, prefixes, term_counts


def table(terms):
    return combine(pa.table([pa.array(terms, pa.large_binary()), np.ones(len(terms), np.int64), np.ones(len(terms), np.int64)], schema=SCHEMA))


@pytest.mark.parametrize("capacity", [1, 4, 100, 10_000])
def test_trie_counts_and_merges(capacity):
    rng = random.Random(capacity)
    words = [bytes(rng.choices(b"ab\x00\xff", k=rng.randint(0, 8))) for _ in range(3000)]
    a, b = BurstTrie(capacity), BurstTrie(3)
    for i in range(0, 3000, 500):
        (a if i % 1000 else b).insert(table(words[i : i + 500]))
    a.merge(b)
    got = {}
    for prefix, t in a.leaves():
        for term, n in zip(t["term"].to_pylist(), t["occurrences"].to_pylist(), strict=True):
            assert term.startswith(prefix)
            got[term] = n
    want = defaultdict(int)
    for w in words:
        want[w] += 1
    assert got == want and list(got) == sorted(want)


def test_front_coding_round_trip():
    for words in ([b""], [b"x" * 5000, b"x" * 5001, b"y"], [bytes([i % 7, i % 3]) * (i % 5) for i in range(300)]):
        t = table(words)
        assert unpack(*pack(t).values()).equals(t)


def test_prefixes_cover_all_terms():
    words = [f"{i:05}".encode() for i in range(2000)]
    bounds = prefixes(words, 20)
    assert bounds[0] == b"" and 10 <= len(bounds) <= 300
    assert sum(t.num_rows for _, t in cut(table([*words, b"", b"zz"]), bounds)) == 2002


SCHEMA_DF = "term string, record long, n long, mark string, leaf int"


def brute(rows):
    n, seen = defaultdict(int), defaultdict(set)
    for t, r, *_ in rows:
        if t is not None:
            n[t] += 1
            seen[t] |= {r} - {None}
    return {t: (n[t], len(seen[t])) for t in n}


def test_counts_with_clashing_columns_nulls_and_repeats(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["", "a", "aa", "ab", "é", "\u0000", None]), rng.choice([None, 1, 2, 3]), 9, "x", 1) for _ in range(2000)]
    rows += [("hot", 1, 0, "", 0)] * 1000 + [("x" * 50_000, i, 0, "", 0) for i in range(3)] + [("x" * 50_000 + "y", 1, 0, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA_DF).repartition(6)
    for leaves in (1, 7, 64):
        assert {r.term: (r.occurrences, r.records) for r in term_counts(df, "term", "record", leaves).collect()} == brute(rows)


def test_marks_at_their_limits(spark):
    rows = [("once", 1), ("no record", None), ("twice", 1), ("twice", 2), ("same record", 3), ("same record", 3)]
    rows += [(f"pad{i}", i) for i in range(200)] + [(f"pad{i}", i + 1) for i in range(200)]
    got = {r.term: r.mark for r in marked(spark.createDataFrame(rows, "term string, record long"), "term", "record", 0.01, 2).collect()}
    # 201 records: 1 % are 2.01, so two records are not common
    assert got["once"] == got["no record"] == got["same record"] == "rare" and got["twice"] is None
    got = {r.term: r.mark for r in marked(spark.createDataFrame(rows[:-1], "term string, record long"), "term", "record", 0.01, 2).collect()}
    assert got["twice"] == "common"  # 200 records


def test_empty_table(spark):
    assert marked(spark.createDataFrame([], SCHEMA_DF), "term", "record").collect() == []
    only = marked(spark.createDataFrame([("a", None)], "term string, record long"), "term", "record").collect()
    assert [tuple(r) for r in only] == [("a", 1, 0, "rare")]


def test_cut_looks_only_at_the_bounds_between_its_terms():
    class Counted(list):
        looked = 0

        def __getitem__(self, i):
            Counted.looked += 1
            return super().__getitem__(i)

    t = table([b"m%03d" % i for i in range(200)])
    bounds = Counted([b"", *(b"%c%05d" % (c, i) for c in b"abcnopq" for i in range(20_000)), b"m050", b"m100"])
    bounds.sort()
    got = [(bounds[i], part["term"][0].as_py(), part.num_rows) for i, part in cut(t, bounds)]
    assert [g[1:] for g in got] == [(b"m000", 50), (b"m050", 50), (b"m100", 100)] and Counted.looked < 100
