"""Communities against greedy modularity in plain Python."""

import itertools

import numpy as np
import pytest

from colloquy.operators import graph


def quality(edges, at):
    both = 2 * sum(w for _, _, w in edges)
    inner, total = {}, {}
    for a, b, w in edges:
        for x in (a, b):
            total[at[x]] = total.get(at[x], 0) + w
        if at[a] == at[b]:
            inner[at[a]] = inner.get(at[a], 0) + 2 * w
    return sum(inner.get(c, 0) / both - (t / both) ** 2 for c, t in total.items())


def greedy(edges):
    """Join the two communities that gain most until none gains."""
    at = {x: x for e in edges for x in e[:2]}
    both = 2 * sum(w for _, _, w in edges)
    while True:
        between, total = {}, {}
        for a, b, w in edges:
            a, b = at[a], at[b]
            total[a], total[b] = total.get(a, 0) + w, total.get(b, 0) + w
            if a != b:
                between[min(a, b), max(a, b)] = between.get((min(a, b), max(a, b)), 0) + w
        best = max(((2 * (w / both - total[a] * total[b] / both**2), -a, -b) for (a, b), w in between.items()), default=(0,))
        if best[0] <= 1e-12:
            return at
        at = {x: -best[1] if c == -best[2] else c for x, c in at.items()}


def planted(seed, n, groups, inside, outside):
    rng = np.random.default_rng(seed)
    return [(a, b, float(rng.uniform(0.3, 1))) for a, b in itertools.combinations(range(n), 2) if rng.random() < (inside if a % groups == b % groups else outside)]


def star(n):
    return [(0, i, 1.0) for i in range(1, n)] + [(n, n + i, 1.0) for i in range(1, n)] + [(0, n, 0.5)]


@pytest.mark.parametrize("edges", [planted(1, 200, 8, 0.4, 0.03), planted(2, 120, 3, 0.2, 0.1), star(60)], ids=["clear", "mixed", "stars"])
def test_as_good_as_greedy(spark, edges):
    df = spark.createDataFrame(edges + [(b, a, w / 2) for a, b, w in edges[:20]] + [(7, 7, 9.0), (1, 2, 0.0)], "src long, dst long, weight double")
    got = {r["node"]: r["topic"] for r in graph.communities(df).collect()}
    assert set(got) == {x for e in edges for x in e[:2]} and all(got[t] == t for t in got.values()) and all(t <= x for x, t in got.items())
    assert quality(edges, got) >= 0.95 * quality(edges, greedy(edges))
    made = graph.modularity(spark.createDataFrame(edges, "src long, dst long, weight double"), spark.createDataFrame(list(got.items()), "node long, topic long")).first()[0]
    assert abs(made - quality(edges, got)) < 1e-5


def test_two_groups_that_one_edge_joins_stay_apart(spark):
    clique = lambda at: [(a, b, 1.0) for a, b in itertools.combinations(range(at, at + 5), 2)]
    edges = spark.createDataFrame([*clique(0), *clique(10), (4, 10, 0.4)], "src long, dst long, weight double")
    assert {r["topic"] for r in graph.communities(edges).collect()} == {0, 10} and {r["topic"] for r in graph.groups(edges).collect()} == {0}
    assert graph.communities(edges.limit(0)).collect() == []
