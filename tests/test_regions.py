import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import geometry, regions
from terrane.operators.embedding import Grid, binned, density, embedding_scale
from terrane.plans.annotate import extract_annotations, generate_region_annotations, merge_annotations, merge_overfragmented
from terrane.plans.contrastive import contrastive
from terrane.plans.descriptive import descriptive, descriptive_merge, enrich, filter_annotations, generate_layout


def blobs(spark, means, std, n, seed=0, numeric=False, kind=None):
    draw = np.random.default_rng(seed)
    means = [(m, m) if np.isscalar(m) else m for m in means]
    rows = []
    for c, m in enumerate(means):
        for x, y in draw.normal(m, std, (n, 2)).tolist():
            rows.append((len(rows), x, y, float(c) if numeric else str(c)))
    if kind == "constant":
        rows = [(i, x, y, "0") for i, x, y, _ in rows]
    if kind == "shuffled":
        labels = draw.permutation([r[3] for r in rows])
        rows = [(i, x, y, str(c)) for (i, x, y, _), c in zip(rows, labels)]
    return spark.createDataFrame(rows, f"sample_id long, x double, y double, cluster {'double' if numeric else 'string'}")


def annotate(df, **kw):
    space, groups = generate_region_annotations(df.select("sample_id", "cluster"), df.select("sample_id", "x", "y"), scale_factor=kw.pop("scale_factor", 0.5), filter_uninformative_features=False, **kw)
    return space, [a for g in groups.values() for a in g]


@pytest.mark.parametrize(
    ("means", "std", "n", "numeric", "expected"),
    [((1, -1), 0.25, 50, False, 2), ([(1, 1), (1, -1), (-1, -1), (-1, 1)], 0.25, 50, False, 4), ((1, 1, 1, -1), 0.25, 50, False, 2), ((1, -1, 1), 0.1, 100, True, 3), ((1, 1, -1, 1, 1), 0.1, 100, True, 3)],
)
def test_clusters_merge(spark, means, std, n, numeric, expected):
    _, found = annotate(blobs(spark, means, std, n, numeric=numeric), merge_min_sample_overlap=0.5)
    assert len(found) == expected


def test_split_parts(spark):
    space, found = annotate(blobs(spark, (1, -1), 0.25, 50, kind="constant"), filter_constant_features=False)
    assert len(found) == 1
    parts = space.split(found[0])
    assert len(parts) == 2 and len(found[0].leaves()) == 1
    _, shared = space.pair_shares(parts)
    assert not shared


def test_shuffled_labels_merge_and_split(spark):
    space, found = annotate(blobs(spark, (-1, 1), 0.25, 100, kind="shuffled"), scale_factor=1.0)
    assert len(found) == 1 and len(found[0].leaves()) == 2
    assert len(space.split(found[0])) == 2


def ring(spark, spots=(), radius=0.5, half=1.0, seed=0, n=500):
    p = np.random.default_rng(seed).uniform(-half, half, (n, 2))
    inner = np.zeros(n, bool)
    for s in spots or [(0, 0)]:
        inner |= np.linalg.norm(p - s, axis=1) < radius
    return spark.createDataFrame([(i, float(x), float(y), str(bool(k))) for i, ((x, y), k) in enumerate(zip(p, inner))], "sample_id long, x double, y double, inner string")


def holes(spark, df, scale_factor=1.0):
    samples = df.select("sample_id", "x", "y")
    scale = embedding_scale(samples, scale_factor)
    grid = Grid.around(samples, scale)
    inds = df.select(F.when(F.col("inner") == "True", 1).otherwise(0).cast("long").alias("ind_id"), "sample_id")
    cells = regions.region_cells(binned(samples, grid, inds), grid, scale)
    rows = geometry.outlines(cells, grid).groupBy("ind_id").agg(F.sum(F.col("hole").cast("int")).alias("holes"), F.sum((~F.col("hole")).cast("int")).alias("rings")).collect()
    return {r["ind_id"]: (r["rings"], r["holes"]) for r in rows}


def test_one_hole(spark):
    assert holes(spark, ring(spark), 0.5) == {0: (1, 1), 1: (1, 0)}


def test_four_holes(spark):
    spots = [(1, 1), (1, -1), (-1, -1), (-1, 1)]
    found = holes(spark, ring(spark, spots, half=2.0, n=2000), 0.35)
    assert found[1] == (4, 0) and found[0][1] == 4


def test_density_is_normalised(spark):
    df = blobs(spark, (1, -1), 0.25, 50)
    samples = df.select("sample_id", "x", "y")
    grid = Grid.around(samples, 0.2)
    for kernel in ("gaussian", "box", "epa", "exponential"):
        r = density(binned(samples, grid), grid, 0.2, kernel).agg(F.sum("z_sum"), F.max("z_max"), F.min("z_max")).first()
        assert abs(r[0] - 1) < 1e-9 and abs(r[1] - 1) < 1e-9 and r[2] >= 0
    with pytest.raises(ValueError):
        density(binned(samples, grid), grid, 0.2, "cubic")


def test_membership_follows_the_outline(spark):
    """Samples inside by the cells' corners are those inside the rings."""
    from terrane.operators.labels import contains

    df = blobs(spark, (0.4, -0.4), 0.3, 150, seed=3)
    samples = df.select("sample_id", "x", "y")
    scale = embedding_scale(samples, 0.5)
    grid = Grid.around(samples, scale)
    cells = regions.region_cells(binned(samples, grid), grid, scale).cache()
    inside = {r["sample_id"] for r in regions.samples_inside(samples, cells, grid).collect()}
    rings = [np.array([(p["x"], p["y"]) for p in r["points"]]) for r in geometry.outlines(cells, grid).collect()]
    for r in samples.collect():
        assert (sum(contains(g, np.array([r["x"], r["y"]])) for g in rings) % 2 == 1) == (r["sample_id"] in inside)
    total = geometry.region_areas(cells, grid).first()["area"]
    signed = sum(geometry.area(g) for g in rings)
    assert abs(total - signed) < 1e-9


def test_rangeset(spark):
    df = blobs(spark, (1, -1), 0.25, 50)
    space, groups = generate_region_annotations(df.select("sample_id", "cluster"), df.select("sample_id", "x", "y"), region_method="rangeset")
    found = [a for g in groups.values() for a in g]
    assert len(found) == 2
    with pytest.raises(ValueError):
        extract_annotations(df, space.indicators, region_method="other")


def test_delaunay_covers_the_hull():
    p = np.random.default_rng(5).random((200, 2))
    tri = regions.delaunay(p)
    corner = p[tri]
    areas = [abs(geometry.area(c)) for c in corner]
    assert abs(sum(areas) - geometry.area(geometry.hull(p))) < 1e-3
    assert len(regions.delaunay(p[:2])) == 0
    grid = np.array([(i, j) for i in range(5) for j in range(5)], float)
    assert abs(sum(abs(geometry.area(c)) for c in grid[regions.delaunay(grid)]) - 16) < 1e-6


def explained(spark):
    df = blobs(spark, [(1, 1), (1, -1), (-1, -1), (-1, 1)], 0.25, 60)
    f = df.select("sample_id", "cluster", (F.col("x") + 0.0).alias("a"), (2 * F.col("x")).alias("b"), F.when(F.col("y") > 0, "up").otherwise("down").alias("side"))
    space, groups = generate_region_annotations(f, df.select("sample_id", "x", "y"), n_discretization_bins=2, scale_factor=0.5)
    return space, groups, [a for g in groups.values() for a in g]


def test_explanations(spark):
    space, groups, flat = explained(spark)
    panels = contrastive(space, flat, max_panels=2)
    assert len(panels) == 2
    names = {a.name for p in contrastive(space, flat, max_panels=None) for a in p}
    assert any("\n" in n for n in names)  # a and b split alike and are told together
    layout = descriptive(space, flat, max_panels=2)
    assert len(layout) == 1 and len(layout[0]) == 4  # the four clusters, each told by all that fits
    for panel in layout:
        _, shared = space.pair_shares(panel)
        assert not shared
    assert contrastive(space, []) == [] and descriptive(space, []) == []
    with pytest.raises(ValueError):
        descriptive_merge(space, flat, method="other")
    assert generate_layout(space, flat, max_panels=1, allow_greedy_approx=False)
    assert filter_annotations(space, flat, 10_000) == []
    enriched = enrich(space, [[flat[0]]], flat, 0.5)[0][0]
    assert set(flat[0].variables) <= set(enriched.variables) and enriched.pieces == flat[0].pieces


def test_merging_descriptions(spark):
    space, groups, flat = explained(spark)
    a, b = next(g for g in groups.values() if g[0].name.startswith("a"))
    one = merge_annotations([a, b])
    assert len(one.clauses) == 1 and one.leaves() == sorted([a, b], key=lambda x: x.order)
    other = next(x for x in flat if x.base_variable != a.base_variable)
    both = merge_annotations([a, other])
    assert len(both.clauses) == 2
    with pytest.raises(TypeError):
        both.base_variable
    rows = {r["ra_id"]: set() for r in space.members([a, other, both]).select("ra_id").distinct().collect()}
    for r in space.members([a, other, both]).collect():
        rows[r["ra_id"]].add(r["sample_id"])
    assert rows.get(2, set()) == rows[0] & rows[1]
    assert merge_overfragmented(space, {0: [a]})[0] == [a]


def test_whole_grids_are_returned(spark):
    """Every kernel's density at all 10,000 points of every indicator, against sums over all weights."""
    import numpy as np

    from terrane import queries as core
    from terrane.operators.embedding import KERNELS, WIDTHS, binned

    sf = "/root/testdata/sf0.001"
    samples, scale, grid, ind = core._frame(spark, sf)
    bins = binned(samples, grid, ind.membership).toPandas()
    ids = set(bins["ind_id"])
    assert core.queries()["kde_binned"](spark, sf).count() == len(bins)
    got = core.queries()["kde_kernels"](spark, sf).toPandas()
    assert len(got) == 8 * len(ids) * grid.n**2
    t = np.arange(grid.n)
    for ind_id in sorted(ids)[::4]:
        w = bins[bins["ind_id"] == ind_id]
        far = np.hypot(((t[:, None, None] - w["gx"].to_numpy()) * grid.dx), ((t[None, :, None] - w["gy"].to_numpy()) * grid.dy)) / scale
        for kernel in sorted(set(KERNELS) - {"box"}):
            own = got[(got["ind_id"] == ind_id) & (got["kernel"] == kernel)].sort_values(["gx", "gy"])
            exact = (KERNELS[kernel](far / WIDTHS[kernel]) * w["w"].to_numpy()).sum(-1)
            assert np.abs(own["z"].to_numpy().reshape(grid.n, grid.n) - exact).max() < 1e-4
