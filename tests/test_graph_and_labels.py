import itertools
import random

import numpy as np
import pytest

from terrane.operators import graph, labels
from terrane.operators.joins import overlap_intervals


def path(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "id int")
    edges = spark.createDataFrame([(i, i + 1) for i in range(4)], "src int, dst int")
    return graph.Graph(nodes, edges)


def test_merge_nodes(spark):
    nodes = spark.createDataFrame([(i,) for i in (10, 20, 30, 40, 50)], "id int")
    edges = spark.createDataFrame([(10, 30), (30, 10), (20, 40), (40, 30), (30, 50), (20, 50), (40, 40)], "src int, dst int")
    g = graph.merge_nodes(graph.Graph(nodes, edges), 30, 40, 7)
    assert {k: v - {k} for k, v in graph.as_sets(g).items()} == {7: {10, 50}, 10: {7}, 20: {7, 50}, 50: set()}


def test_components_keep_isolated_nodes(spark):
    assert {r["id"]: r["component"] for r in graph.connected_components(path(spark)).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5}


def test_long_path(spark):
    n = 200
    ids = list(range(n))
    random.Random(1).shuffle(ids)
    g = graph.Graph(spark.createDataFrame([(i,) for i in ids], "id int"), spark.createDataFrame(list(zip(ids, ids[1:])), "src int, dst int"))
    assert graph.connected_components(g).where("component = 0").count() == n


def test_distance_graph_has_loops(spark):
    nodes = spark.createDataFrame([(0,), (1,)], "id int")
    pairs = spark.createDataFrame([(0, 1, 0.5)], "a int, b int, value double")
    assert graph.as_sets(graph.distances_to_graph(nodes, pairs, 0.1)) == {0: {0}, 1: {1}}
    assert graph.as_sets(graph.distances_to_graph(nodes, pairs, 0.6, loops=False)) == {0: {1}, 1: {0}}
    assert graph.as_sets(graph.similarities_to_graph(nodes, pairs, 0.5)) == {0: set(), 1: set()}


@pytest.mark.parametrize("seed", range(8))
def test_cliques_and_colours_against_brute_force(seed):
    r = random.Random(seed)
    n = 8
    g = {i: set() for i in range(n)}
    for i, j in itertools.combinations(range(n), 2):
        if r.random() < 0.45:
            g[i].add(j)
            g[j].add(i)
    full = [set(s) for k in range(1, n + 1) for s in itertools.combinations(range(n), k) if all(b in g[a] for a, b in itertools.combinations(s, 2))]
    best = [s for s in full if not any(s < t for t in full)]
    assert sorted(map(sorted, graph.max_cliques(g))) == sorted(map(sorted, best))
    for order in ("given", "degree", "largest_first"):
        color = graph.greedy_coloring(g, order)
        assert all(color[a] != color[b] for a in g for b in g[a]) and set(color) == set(g)


def test_intervals_against_brute_force(spark):
    r = random.Random(4)
    a = [(i, s, s + r.choice([0, 1, 5, 30])) for i in range(80) for s in [r.randrange(100)]]
    b = [(i, s, s + r.choice([0, 1, 5, 30])) for i in range(80) for s in [r.randrange(100)]]
    left, right = spark.createDataFrame(a, "id1 int, start1 int, end1 int"), spark.createDataFrame(b, "id2 int, start2 int, end2 int")
    for closed in (False, True):
        less = (lambda x, y: x <= y) if closed else (lambda x, y: x < y)
        exp = {(i, j) for i, s1, e1 in a for j, s2, e2 in b if (s1 <= s2 and less(s2, e1)) or (s2 < s1 and less(s1, e2))}
        got = [(r_["id1"], r_["id2"]) for r_ in overlap_intervals(left, right, 7.0, closed, sort=True).collect()]
        assert got == sorted(exp)


def test_labels():
    targets = np.array([(1.0, 0.1), (-1.0, 0.2), (0.1, 1.0)])
    places = labels.initial_places(np.zeros(2), 1.0, targets)
    assert np.allclose(np.linalg.norm(places, axis=1), 1.25) and len({tuple(p) for p in places.round(6)}) == 3
    crossed = np.array([(0.0, 1.0), (1.0, 1.0)])
    assert labels.fix_crossings(crossed, np.array([(1.0, 0.0), (0.0, 0.0)])).tolist() == [[1.0, 1.0], [0.0, 1.0]]
    a, b = labels.box_ring((0, 0, 1, 1)), labels.box_ring((3, 0, 4, 1))
    assert labels.distance(a, b) == 2 and labels.distance(a, a + 0.5) == 0
    v, d = labels.vector_between(a, b)
    assert d == 2 and np.allclose(v, (-1, 0), atol=1e-6)
    axes = labels.Axes((-5, -5, 5, 5))
    faults = labels.quality([a, a + 0.5], [b], axes)
    assert faults["hard_label_label"] == 2 and faults["hard_label_region"] == 0 and faults["hard_overflows"] == 0
    moved = labels.optimize([a, a + 0.5], [b, b], b, axes)
    assert labels.penalty(labels.quality(moved, [b], axes)) < labels.penalty(faults)
    with pytest.raises(ValueError):
        labels.optimize([a], [], b, axes)
    fit = labels.fit_axes(lambda lim: [(0, 0, 2, 1), (1, 3, 4, 5)], samples=(0, 0, 3, 3))
    assert fit[2] - fit[0] == pytest.approx(fit[3] - fit[1]) and fit[0] <= 0 and fit[3] >= 5


def test_flatten():
    from terrane.functions.lists import flatten

    assert flatten([[1], 2, [[3, 4]], 5]) == [1, 2, 3, 4, 5]
    assert flatten(7) == [7] and flatten([]) == [] and flatten([(1, 2), []]) == [(1, 2)]
