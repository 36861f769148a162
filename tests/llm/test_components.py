"""Connected components: the least id, and no more plans than are needed."""

import random

import pytest

from tidemark.llm import components


@pytest.fixture
def settled(monkeypatch):
    """Names of the tables that components settles."""
    names, settle = [], components.settle
    monkeypatch.setattr(components, "settle", lambda df, name, *a: names.append(name) or settle(df, name, *a))
    return names


def least_reached(edges):
    least = {x: x for e in edges for x in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    return least


def found(spark, edges):
    return {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b", "t").collect()}


def test_stars_need_no_round(spark, settled):
    edges = [(5, 1), (1, 6), (7, 1), (9, 8), (9, 8)]
    assert found(spark, edges) == least_reached(edges) == {1: 1, 5: 1, 6: 1, 7: 1, 8: 8, 9: 8}
    assert settled == ["t-edges"]


def test_a_star_around_its_greatest_needs_one_round(spark, settled):
    edges = [(9, x) for x in range(1, 9)]
    assert found(spark, edges) == dict.fromkeys(range(1, 10), 1)
    assert settled == ["t-edges", "t-large", "t-edges"]


def test_components_of_graphs_by_chance(spark):
    r = random.Random(5)
    edges = [(base + r.randrange(n), base + r.randrange(n)) for base, n, m in ((0, 30, 20), (100, 40, 80), (200, 3, 2)) for _ in range(m)]
    edges += [(300 + i, 301 + i) for i in range(7)] + [(400, 400)]
    want = least_reached([e for e in edges if e[0] != e[1]])
    assert found(spark, edges) == want
