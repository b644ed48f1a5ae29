import random

import pytest

from strandweave.llm.components import groups


def brute(links):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b, *_ in links:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def found(spark, links, schema="a long, b long, id long, m string"):
    return {r.id: r.group_id for r in groups(spark.createDataFrame(links, schema), "a", "b").collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_links(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(600), rng.randrange(600), 0, "x") for _ in range(350)] + [(None, 3, 0, ""), (4, None, 0, ""), (5, 5, 0, ""), (1000, 1001, 0, ""), (1001, 1000, 0, "")]
    assert found(spark, links) == brute(links)


def test_long_chain_and_star(spark):
    ids = list(range(200))
    random.Random(3).shuffle(ids)
    links = [(a, b, 0, "") for a, b in zip(ids, ids[1:], strict=False)] + [(5000, 5000 + i, 0, "") for i in range(1, 300)] + [(7000 + i, 8000, 0, "") for i in range(300)]
    assert found(spark, links) == brute(links)


def test_nothing_to_link(spark):
    assert found(spark, []) == {}
    assert found(spark, [(1, 1, 0, ""), (None, None, 0, None), (2, None, 0, "")]) == {}
