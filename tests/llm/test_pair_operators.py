import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm.components import connected_components
from terrane.llm.embed_dedup import near_vectors
from terrane.llm.hnsw import Graph, _within, within
from terrane.llm.minhash import bands_for, cross_links, near_duplicates


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, size):
    w = (text or "").encode().lower().split()
    n = min(size, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def groups_brute(docs, size, percent):
    sets = {d: shingles(t, size) for d, t in docs}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    found = roots(sets, links)
    return {d: (len(sets[d]), found[d]) for d in sets}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, size, percent):
    """A family of near copies of all similarities, small ones, exact copies, short and empty texts; small blocks."""
    from terrane.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK", 16)
    r = random.Random(size)
    words = [f"w{i}" for i in range(4000)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    docs = []
    base = text(120)
    for _ in range(70):
        own = list(base)
        for _ in range(r.randrange(0, 9)):
            own[r.randrange(len(own))] = r.choice(words)
        docs.append(" ".join(own))
    for _ in range(12):
        own = text(60)
        docs += [" ".join(own), " ".join(own[:-1] + [r.choice(words)]), " ".join(own).upper().replace("W", "W")]
    docs += ["same text here"] * 5 + ["a b", "a  b", "a", "A", "", " \n", None]
    r.shuffle(docs)
    rows = list(enumerate(docs))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_duplicates(df, shingle=size, percent=percent).collect()}
    assert got == groups_brute(rows, size, percent)


def test_near_duplicates_odd(odd_docs, no_docs):
    rows = near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[5]["component_id"] == 4 and not by[5]["kept"] and by[4]["kept"] and by[1]["component_id"] == 1
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert near_duplicates(no_docs).count() == 0


def test_bands():
    for percent, rows in ((0.85, 6), (0.8, 6), (0.8, 5)):
        assert (1 - percent**rows) ** bands_for(percent, rows) <= 1e-5


def test_cross_links_against_brute_force():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 40, 80)
    for _ in range(5):
        sets = []
        for _ in range(50):
            x = base.copy()
            k = r.integers(0, 12)
            x[r.choice(80, k, replace=False)] = r.integers(0, 1 << 40, k)
            sets.append(np.unique(x))
        component = r.integers(0, 15, 50)
        got = {(i, component[j]) for i, j in cross_links(sets, component, component != 0, 85, 7).tolist()}
        exp = {(i, component[j]) for i in range(50) for j in range(50) if component[i] not in (0, component[j]) and 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - c)}
        assert got == exp


def test_components(spark):
    r = random.Random(9)
    links = [(i, i + 1) for i in range(40)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)] + [(7, 7), (3, 4), (None, 5)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {x["id"]: x["component"] for x in connected_components(df).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == roots({n for p in real for n in p}, real)
    assert connected_components(df.limit(0)).count() == 0


# ---- vectors


def vectors_brute(rows, threshold=0.98):
    links = []
    count = dict.fromkeys((i for i, _, _ in rows), 0)
    fine = [(i, np.array(v, float) / np.linalg.norm(v), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0]
    for (i, x, a), (j, y, b) in itertools.combinations(fine, 2):
        if a == b and len(x) == len(y) and x @ y >= threshold:
            links.append((i, j))
            count[i] += 1
            count[j] += 1
    found = roots(count, links)
    return {i: (count[i], found[i]) for i in count}


@pytest.mark.parametrize("shard_size", [8192, 40])
def test_near_vectors_against_brute_force(spark, shard_size):
    r = np.random.default_rng(2)
    rows = []
    for c in range(30):
        base = r.normal(size=16)
        for _ in range(int(r.integers(1, 12))):
            rows.append((len(rows), (base + r.normal(0, 0.1, 16)).astype(np.float32).tolist(), int(c % 3)))
    rows += [(len(rows) + k, rows[0][1], rows[0][2]) for k in range(6)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 16, 1), (n + 3, [float("nan")] * 16, 1), (n + 4, [None] + [1.0] * 15, 1), (n + 5, rows[0][1], None), (n + 6, [2.0] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"id": F.lit("x"), "key": F.lit("y"), "n": F.lit(1)})
    out = near_vectors(df, shard_size=shard_size).collect()
    assert {x["vec_id"]: (x["n_links"], x["component_id"]) for x in out} == vectors_brute(rows)
    assert all(x["kept"] == (x["vec_id"] == x["component_id"]) for x in out)


def test_near_vectors_odd(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [2.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    rows = sorted(((x["vec_id"], x["n_links"], x["component_id"], x["kept"]) for x in near_vectors(df).collect()), key=repr)
    assert rows == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 0, None, True)]
    assert near_vectors(df.limit(0)).count() == 0


def test_graph_recall():
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 32))
    x = (centres[r.integers(0, 40, 3000)] + r.normal(0, 0.25, (3000, 32))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph(x)
    ids, sims = g.search(x[:300], 32)
    truth = np.argsort(-(x[:300] @ x.T), axis=1)[:, :10]
    assert np.mean([len(np.intersect1d(a[:10], b)) for a, b in zip(ids, truth)]) / 10 > 0.9
    assert (np.diff(sims, axis=1) <= 1e-6).all()
    found = within(g, x, 0.95)
    exact = [np.flatnonzero(x @ v >= 0.95) for v in x]
    assert sum(len(np.intersect1d(a, b)) for a, b in zip(found, exact)) >= 0.98 * sum(map(len, exact))
    assert Graph(x[:1]).search(x[:2], 8)[0][:, 0].tolist() == [0, 0]


def test_sparse_links_are_found_without_evidence():
    """Few links among many queries, and few beside a hot group: an audit that sees none, or the hot ones alone, proves nothing."""
    r = np.random.default_rng(5)
    unit = lambda v: (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    x = unit(r.normal(size=(3000, 128)))
    x[:200] = unit(x[0] + r.normal(0, 0.002, (200, 128)))
    g = Graph(x)
    near = unit(x[500:1300] + r.normal(0, 0.009, (800, 128)))
    near = near[[not len(f) for f in _within(g, near, 0.98, 16, 1024)]][:20]  # what the narrow beam misses
    assert len(near) and ((near @ x.T >= 0.98).sum(1) > 0).all()
    for others in (unit(r.normal(size=(1500, 128))), np.concatenate((x[:200], unit(r.normal(size=(1300, 128)))))):
        q = np.concatenate((others[:1], near, others[1:]))
        found = within(g, q, 0.98)
        assert [sorted(f.tolist()) for f in found] == [np.flatnonzero(q[i] @ x.T >= 0.98).tolist() for i in range(len(q))]


def test_sparse_links_of_large_shards(spark):
    """A label of several shards of far more than 128 vectors, a few of which have a partner."""
    r = np.random.default_rng(6)
    x = r.normal(size=(1600, 48))
    x[1500:] = x[:100] + r.normal(0, 0.1, (100, 48))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = [(int(a), int(b)) for a, b in np.argwhere(unit @ unit.T >= 0.98) if a < b]
    count = np.bincount(np.array(links).ravel(), minlength=len(x))
    found = roots(range(len(x)), links)
    out = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), shard_size=400).collect()
    assert {o["vec_id"]: (o["n_links"], o["component_id"]) for o in out} == {i: (count[i], found[i]) for i in range(len(x))}
