"""Strongly connected components and what entries reach, against plain Python."""

import random

import pytest

from millrace.operators import graph


def reached(edges, start):
    out, todo = {start}, [start]
    while todo:
        node = todo.pop()
        for a, b in edges:
            if a == node and b not in out:
                out.add(b)
                todo.append(b)
    return out


def by_hand(edges):
    nodes = sorted({n for e in edges for n in e})
    whole = {n: reached(edges, n) for n in nodes}
    component = {n: min(m for m in nodes if m in whole[n] and n in whole[m]) for n in nodes}
    entered = {component[b] for a, b in edges if component[a] != component[b]}
    return component, {(component[n], m) for n in nodes if component[n] not in entered for m in whole[n]}


def graphs():
    rng = random.Random(10)
    ring = [(k, (k + 1) % 12) for k in range(12)]
    return [
        [(rng.randrange(30), rng.randrange(30)) for _ in range(45)],
        [*ring, (20, 3), (5, 30), (30, 31), (31, 30), (31, 40), (50, 50), *[(60, k) for k in range(3)]],
    ]


@pytest.mark.parametrize("few", [0, 1 << 17])
@pytest.mark.parametrize("which", [0, 1])
def test_components_equal_brute_force(spark, few, which):
    edges = graphs()[which]
    df = spark.createDataFrame(edges + edges[:3], "src long, dst long")
    assert {r.node: r.component for r in graph.strong_components(df, few).collect()} == by_hand(edges)[0]


def test_reach_expands_to_all_pairs(spark):
    for edges in graphs():
        reach, members = graph.reach(spark.createDataFrame(edges, "src long, dst long"))
        assert {tuple(r) for r in graph.expanded(reach, members).collect()} == by_hand(edges)[1]
        assert reach.count() <= graph.expanded(reach, members).count()


def test_a_long_ring_is_one_component(spark):
    ring = spark.range(50_000).selectExpr("cast(id as string) as src", "cast((id + 1) % 50000 as string) as dst")
    got = graph.strong_components(ring).groupBy("component").count().collect()
    assert [tuple(r) for r in got] == [("0", 50_000)]
    assert graph.strong_components(ring.limit(0)).count() == 0
