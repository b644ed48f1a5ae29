import random
from collections import defaultdict

import numpy as np
import pytest

from strandweave.llm.spans import coverage, packed, parse, schedule, shared_spans

SCHEMA = "target_id long, read_id long, seq string, rid long, at int"


def brute(rows, size):
    rows = {(t, r, s.upper()) for t, r, s, *_ in rows if r is not None and s is not None}
    where = defaultdict(set)
    for t, r, s in rows:
        for i in range(len(s) - size + 1):
            if set(s[i : i + size]) <= set("ACGT"):
                where[s[i : i + size]].add(r)
    out = set()
    for t, r, s in rows:
        start = end = None
        for i in range(len(s) - size + 1):
            if len(where.get(s[i : i + size], ())) > 1:
                if end is None or i > end:
                    if end is not None:
                        out.add((t, r, start, end - start))
                    start = i
                end = i + size
        if end is not None:
            out.add((t, r, start, end - start))
    return out


def found(spark, rows, size):
    return {tuple(r) for r in shared_spans(spark.createDataFrame(rows, SCHEMA), "target_id", "read_id", "seq", size).collect()}


@pytest.mark.parametrize("size", [5, 16, 48, 70])
def test_against_brute_force(spark, size):
    rng = random.Random(size)
    pool = ["".join(rng.choice("ACGT") for _ in range(300)), "G" * 300, "ACT" * 100, "AACC" * 75, "".join(rng.choice("AC") for _ in range(300))]
    rows = []
    for r in range(60):
        s = ""
        for _ in range(rng.randint(1, 3)):
            p, n = rng.choice(pool), rng.choice([size - 1, size, size, size + 1, 2 * size])
            i = rng.randrange(300 - n)
            s += p[i : i + n] + rng.choice(["", "N", "_", rng.choice("ACGT")])
        rows.append((r % 3, r, rng.choice([str.upper, str.lower])("_" * rng.randrange(4) + s), 0, 0))
    rows += rows[:5] + [(9, 1, rows[1][2], 0, 0), (None, 77, rows[2][2], 0, 0), (1, None, rows[3][2], 0, 0), (1, 78, None, 0, 0), (1, 79, "", 0, 0), (1, 80, "N" * 200, 0, 0)]
    assert found(spark, rows, size) == brute(rows, size)


def test_same_read_under_two_targets_is_not_shared(spark):
    s = "ACGTTGCATTGACCAGTAGGCATCAGGATTACAGATCCAGTTGACCATGGA"
    assert found(spark, [(1, 5, s, 0, 0), (2, 5, s, 0, 0)], 48) == set()
    assert found(spark, [(1, 5, s, 0, 0), (1, 6, s[:48], 0, 0)], 48) == {(1, 5, 0, 48), (1, 6, 0, 48)}


def test_long_sequences_and_coverage(spark):
    rng = random.Random(8)
    a, b = ("".join(rng.choice("ACGT") for _ in range(60_000)) for _ in range(2))
    rows = [(1, 1, a, 0, 0), (1, 2, b[:1000] + a[20_000:30_000] + b[1000:], 0, 0), (None, 3, "ACGN", 0, 0)]
    got = found(spark, rows, 48)  # a letter or two beside the copied part may agree by chance
    assert {r for _, r, _, _ in got} == {1, 2} and len(got) == 2 and all(10_000 <= n < 10_010 for *_, n in got)
    got = {r.member: (r.bases, r.shared) for r in coverage(spark.createDataFrame(rows, SCHEMA), "target_id", "read_id", "seq").collect()}
    assert got[3] == (3, 0) and got[1][0] == 60_000 and 10_000 <= got[1][1] < 10_010


def test_empty_table(spark):
    assert found(spark, [], 48) == set()


def test_equal_spans_hold_the_same_symbols_and_choose_one():
    """Whatever stands around a span, the symbols between its margins are the same."""
    rng = random.Random(3)
    rounds, margin, longest = schedule(48)
    assert len(rounds) == 3 and 2 * margin + 2 * longest - 1 <= 48
    for trial in range(400):
        letters = rng.choice([4, 2, 1])
        w = [rng.randrange(letters) for _ in range(48)] if trial % 3 else ([rng.randrange(4) for _ in range(rng.randint(1, 5))] * 48)[:48]
        inner = []
        for _ in range(2):
            left = rng.choice([[rng.randrange(letters) for _ in range(40)], w[:1] * 40])
            code = np.array(left + w + [rng.randrange(letters) for _ in range(40)] + [4], np.uint8)
            inner.append({(int(b) - 40, int(e) - 40, int(n)) for b, e, n in zip(*parse(code, rounds), strict=True) if b - 40 >= margin and e - 40 <= 48 - margin})
        assert inner[0] == inner[1] and inner[0]


def test_packed_bases():
    rng = np.random.default_rng(5)
    code = rng.integers(0, 4, 100).astype(np.uint8)
    for length in (1, 5, 31, 32):
        got = packed(code, length)
        for i in (0, 17, 100 - length):
            assert int(got[i]) == int("".join(map(str, code[i : i + length])), 4)
