"""Maximal cliques against a plain search."""

import random
from itertools import combinations

import pytest

from weftline.operators import graph


def plain_cliques(edges, least=3):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    found, stack = [], [(frozenset(), set(near), set())]
    while stack:
        r, p, x = stack.pop()
        if not p and not x:
            found.append(r)
            continue
        if not p:
            continue
        pivot = max(p | x, key=lambda u: len(near[u] & p))
        for v in list(p - near[pivot]):
            stack.append((r | {v}, p & near[v], x & near[v]))
            p, x = p - {v}, x | {v}
    return sorted(sorted(c) for c in found if len(c) >= least)


@pytest.mark.parametrize("seed, n, share", [(1, 30, 0.3), (2, 25, 0.7), (3, 60, 0.1), (4, 12, 1.0)])
def test_random_graphs(spark, seed, n, share):
    r = random.Random(seed)
    edges = [(f"n{a}", f"n{b}") if r.random() < 0.5 else (f"n{b}", f"n{a}") for a, b in combinations(range(n), 2) if r.random() < share]
    edges += edges[:3] + [("n1", "n1"), ("apart", "too")]
    t = spark.createDataFrame(edges, "a string, b string").repartition(3)
    for least in (2, 3, 4):
        assert sorted(x.members for x in graph.maximal_cliques(t, min_size=least).collect()) == plain_cliques(edges, least)


def test_one_component_of_many_nodes(spark):
    """5,000 nodes in one component, with a hub that knows a third of them and cliques of 8."""
    r = random.Random(8)
    n = 5000
    edges = {(i, i + 1) for i in range(n - 1)} | {(0, i) for i in range(2, n, 3)}
    edges |= {tuple(sorted(r.sample(range(n), 2))) for _ in range(9000)}
    for _ in range(300):
        edges |= set(combinations(sorted(r.sample(range(n), 8)), 2))
    named = [(f"{a:05d}", f"{b:05d}") for a, b in edges]
    got = graph.clique_reads(spark.createDataFrame(named, "a string, b string").repartition(4)).collect()
    assert {x.component for x in got} == {"00000"}
    assert sorted(x.clique for x in got) == list(range(len(got)))
    assert [x.members for x in sorted(got, key=lambda x: x.clique)] == plain_cliques(named)


def test_peeling_bounds_later_neighbours(spark):
    edges = [("hub", f"leaf{i}") for i in range(500)] + [(f"leaf{i}", f"leaf{i + 1}") for i in range(499)]
    level = {x.node: x.level for x in graph.peel(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert len(level) == 501
    later = {}
    for a, b in edges:
        first, second = sorted((a, b), key=lambda k: (level[k], k))
        later.setdefault(first, set()).add(second)
    assert max(map(len, later.values())) <= 2 * 1.5 * 2
    assert graph.maximal_cliques(spark.createDataFrame([], "a string, b string")).collect() == []
