import random

import pytest

from henhouse.llm.components import components


@pytest.mark.parametrize("seed, at_once", [(1, 200_000), (1, 25), (2, 60)])
def test_components_equal_union_find(spark, monkeypatch, seed, at_once):
    monkeypatch.setattr("henhouse.llm.components.CONTRACT_LINKS", at_once)
    rng = random.Random(seed)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(130)]
    links += [(i, i + 1) for i in range(400, 440)] + [(500, 500 + i) for i in range(30)] + [(7, 7)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        if a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    want = {x: root(x) for x in up}
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == want and got.count() == len(want)


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
