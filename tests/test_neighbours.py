import numpy as np
import pytest

from terrane.operators import embedding, joins, neighbours


def points(seed: int, n: int) -> np.ndarray:
    """Clusters, a lattice with many equal distances, copies of one point and points far away."""
    r = np.random.default_rng(seed)
    xy = np.concatenate([r.normal(0, 0.01, (n // 3, 2)), r.integers(0, 12, (n // 3, 2)) / 8, np.full((n // 4, 2), 0.25), r.normal(50, 9, (n // 20, 2))])
    return xy[r.permutation(len(xy))]


@pytest.mark.parametrize(("k", "leaf"), [(1, 8), (5, 8), (7, 64), (3, 10**6)])
def test_nearest_against_brute_force(spark, k, leaf):
    xy = points(k, 500)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "sample_id long, x double, y double")
    got = {}
    for r in neighbours.nearest(df, k, leaf).collect():
        got.setdefault(r["src"], []).append((r["distance"], r["dst"]))
    for i, p in enumerate(xy):
        exact = sorted((float(np.hypot(*(p - q))), j) for j, q in enumerate(xy) if j != i)[:k]
        assert sorted(got[i]) == exact


@pytest.mark.parametrize(("k", "leaf", "merged"), [(1, 8, 10**6), (5, 8, 500), (40, 8, 2000), (130, 8, 10**6), (3, 10**6, 10**6), (900, 8, 10**6)])
def test_kth_distances_against_brute_force(spark, monkeypatch, k, leaf, merged):
    monkeypatch.setattr(neighbours, "MERGED", merged)
    xy = points(k, 500)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "sample_id long, x double, y double")
    got = {r["sample_id"]: r["distance"] for r in neighbours.kth_distances(df, k, leaf).collect()}
    d = np.sort(np.hypot(xy[:, None, 0] - xy[:, 0], xy[:, None, 1] - xy[:, 1]), axis=1)
    assert [got[i] for i in range(len(xy))] == d[:, min(k, len(xy) - 1)].tolist()


def test_small_and_large_inputs_agree(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points(9, 300))], "sample_id long, x double, y double")
    one = sorted(map(tuple, joins.knn_graph(df, 4).collect())), embedding.embedding_scale(df)
    monkeypatch.setattr(joins, "HELD_POINTS", 0)
    monkeypatch.setattr(embedding, "HELD_POINTS", 0)
    monkeypatch.setattr(neighbours, "LEAF", 16)
    assert sorted(map(tuple, joins.knn_graph(df, 4).collect())) == one[0] and embedding.embedding_scale(df) == pytest.approx(one[1])


def test_few_points(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0), (3, 0.0, 0.0)], "sample_id long, x double, y double")
    assert sorted((r["src"], r["dst"], r["distance"]) for r in neighbours.nearest(df, 5).collect()) == [(1, 2, 5.0), (1, 3, 0.0), (2, 1, 5.0), (2, 3, 5.0), (3, 1, 0.0), (3, 2, 5.0)]
    assert neighbours.nearest(df.limit(0), 2).count() == 0 and neighbours.nearest(df.limit(1), 2).count() == 0
