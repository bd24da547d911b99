"""Components of link tables, empty ones too."""

import random

import pytest

from driftline.llm.components import components


@pytest.mark.parametrize("n", [0, 1, 40])
def test_components(spark, n):
    rng = random.Random(n)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(n)]
    links = [(a, b) for a, b in links if a != b]
    up = {x: x for pair in links for x in pair}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(links, "a bigint, b bigint"))
    assert {r.node: r.root for r in got.collect()} == {x: root(x) for x in up}
