"""Connected components against union-find."""

import random

import pytest

from ticklens.llm.components import components


def expected(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    return {(x, find(x)) for u, v in edges if u != v for x in (u, v)}


CHAIN = [(k, k + 1) for k in range(40)]
SHUFFLED = [(7 * k % 41, 7 * (k + 1) % 41) for k in range(40)]
STAR = [(0, k) for k in range(1, 60)] + [(k, 0) for k in range(1, 60)]
RANDOM = [(random.Random(k).randrange(90), random.Random(k + 500).randrange(90)) for k in range(80)]


@pytest.mark.parametrize("edges", [CHAIN, SHUFFLED, STAR, RANDOM, [(5, 5)], [(2, 1), (1, 2), (2, 1)], []])
def test_components(spark, edges):
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {tuple(g) for g in got} == expected(edges) and len(got) == len(expected(edges))
