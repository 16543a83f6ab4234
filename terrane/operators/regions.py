"""Regions of indicators: where their density is high, or where their members lie close together.

A density region is the area above a level of the bilinear grid. Whether a sample lies in it is told by the
four corners of its cell alone, so membership is an equi-join of cells and a CASE, not a search of polygons.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.operators.embedding import Grid, as_matrix, smooth

CORNERS = ("00", "10", "01", "11")
CELLS = "ind_id long, gx int, gy int, " + ", ".join(f"z{c} double" for c in CORNERS) + ", " + ", ".join(f"p{c} int" for c in CORNERS)


def parts_of(z: np.ndarray, level: float) -> np.ndarray:
    """Number of the connected part of every grid point above the level, -1 below. Neighbours along the axes are
    connected, and both diagonal ones of a cell whose mean is above the level."""
    above = z > level
    n, m = z.shape
    index = np.arange(n * m).reshape(n, m)
    pairs = [(index[:-1][k], index[1:][k]) for k in [above[:-1] & above[1:]]] + [(index[:, :-1][k], index[:, 1:][k]) for k in [above[:, :-1] & above[:, 1:]]]
    a, b, c, d = above[:-1, :-1], above[1:, :-1], above[:-1, 1:], above[1:, 1:]
    mean = (z[:-1, :-1] + z[1:, :-1] + z[:-1, 1:] + z[1:, 1:]) / 4 > level
    one, two = a & d & ~b & ~c & mean, b & c & ~a & ~d & mean
    pairs += [(index[:-1, :-1][one], index[1:, 1:][one]), (index[1:, :-1][two], index[:-1, 1:][two])]
    i, j = np.concatenate([p for p, _ in pairs]), np.concatenate([q for _, q in pairs])
    label = index.ravel().copy()
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    out = np.full(n * m, -1)
    kept = above.ravel()
    out[kept] = np.unique(label[kept], return_inverse=True)[1]
    return out.reshape(n, m)


def cells_of(z: np.ndarray, level: float) -> dict[str, np.ndarray]:
    """The cells with a corner above the level: place, corners and the corners' parts."""
    part = parts_of(z, level)
    take = lambda a: {"00": a[:-1, :-1], "10": a[1:, :-1], "01": a[:-1, 1:], "11": a[1:, 1:]}
    corner, own = take(z), take(part)
    gx, gy = np.nonzero(np.maximum.reduce(list(own.values())) >= 0)
    return {"gx": gx, "gy": gy} | {f"z{c}": corner[c][gx, gy] for c in CORNERS} | {f"p{c}": own[c][gx, gy] for c in CORNERS}


def region_cells(bins: DataFrame, grid: Grid, bandwidth: float, kernel: str = "gaussian", level: float = 0.25) -> DataFrame:
    """The cells of every indicator's region, from (ind_id, gx, gy, w); densities are scaled to a maximum of one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z = smooth(as_matrix(pdf, grid), grid, bandwidth, kernel)
        return pd.DataFrame({"ind_id": pdf["ind_id"].iloc[0], **cells_of(z / z.max(), level)})

    return bins.groupBy("ind_id").applyInPandas(run, CELLS)


def part_at(level: float) -> Column:
    """Part in which the place (fx, fy) of a cell lies; null outside of the region. Borders are inside.

    One SQL expression: four corners give many cases, and building them as columns one by one takes a second.
    """
    at = f"{level!r}D"
    z = {c: f"z{c}" for c in CORNERS}
    up = {c: f"(z{c} > {at})" for c in CORNERS}
    count = "(" + " + ".join(f"int({up[c]})" for c in CORNERS) + ")"
    beyond = f"(z00 + z10 + z01 + z11) / 4 > {at}"
    along = {"00": ("fx", "fy", "10", "01"), "10": ("(1 - fx)", "fy", "00", "11"), "01": ("fx", "(1 - fy)", "11", "00"), "11": ("(1 - fx)", "(1 - fy)", "01", "10")}

    def cut(a: str, b: str) -> str:
        """How far from corner a the level lies on the way to corner b."""
        return f"(({z[a]} - {at}) / ({z[a]} - {z[b]}))"

    def corner(c: str) -> str:
        """Distance from a corner in units of the triangle that the level cuts off there."""
        dx, dy, nx, ny = along[c]
        return f"({dx} / {cut(c, nx)} + {dy} / {cut(c, ny)})"

    def single(c: str) -> str:
        return f"CASE WHEN {corner(c)} <= 1 THEN p{c} END"

    def side(a: str, b: str, na: str, nb: str, far: str, run: str) -> str:
        """Two corners a and b of one side; ``far`` is the distance from it, ``run`` the place along it."""
        return f"CASE WHEN {far} <= {cut(a, na)} + ({cut(b, nb)} - {cut(a, na)}) * {run} THEN p{a} END"

    def saddle(a: str, b: str, c: str, d: str) -> str:
        """Two diagonal corners a and b above, c and d below."""
        return f"CASE WHEN {beyond} THEN CASE WHEN {corner(c)} >= 1 AND {corner(d)} >= 1 THEN p{a} END ELSE coalesce({single(a)}, {single(b)}) END"

    cases = [(f"{count} = 4", "p00")]
    cases += [(f"{count} = 1 AND {up[c]}", single(c)) for c in CORNERS]
    cases += [(f"{count} = 3 AND NOT {up[c]}", f"CASE WHEN {corner(c)} >= 1 THEN p{keep} END") for c, keep in (("00", "11"), ("10", "01"), ("01", "10"), ("11", "00"))]
    pairs = [("00", "01", side("00", "01", "10", "11", "fx", "fy")), ("10", "11", side("10", "11", "00", "01", "(1 - fx)", "fy")), ("00", "10", side("00", "10", "01", "11", "fy", "fx")), ("01", "11", side("01", "11", "00", "10", "(1 - fy)", "fx")), ("00", "11", saddle("00", "11", "10", "01")), ("10", "01", saddle("10", "01", "00", "11"))]
    cases += [(f"{count} = 2 AND {up[a]} AND {up[b]}", then) for a, b, then in pairs]
    return F.expr("CASE " + " ".join(f"WHEN {when} THEN {then}" for when, then in cases) + " END")


def samples_inside(samples: DataFrame, cells: DataFrame, grid: Grid, level: float = 0.25) -> DataFrame:
    """(ind_id, part_id, sample_id) of every sample in every region: one equi-join on cells."""
    inside = grid.place(samples).join(cells, ["gx", "gy"]).withColumn("part_id", part_at(level))
    return inside.where(F.col("part_id").isNotNull()).select("ind_id", "part_id", "sample_id")


def merge_regions(inside: DataFrame, groups: DataFrame, method: str = "union") -> DataFrame:
    """(group, sample_id) of the union or intersection of the regions ``groups`` (group, ind_id) lists."""
    if method not in ("union", "intersection"):
        raise ValueError("method must be union or intersection")
    rows = inside.select("ind_id", "sample_id").distinct().join(groups, "ind_id")
    if method == "union":
        return rows.select("group", "sample_id").distinct()
    size = groups.groupBy("group").agg(F.countDistinct("ind_id").alias("size"))
    found = rows.groupBy("group", "sample_id").agg(F.countDistinct("ind_id").alias("n"))
    return found.join(size, "group").where(F.col("n") == F.col("size")).select("group", "sample_id")


# ---- regions by triangulation


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles of distinct points by insertion: those whose circle holds the new point give way to a fan."""
    n = len(points)
    if n < 3:
        return np.zeros((0, 3), int)
    centre, span = points.mean(0), max(float(np.ptp(points, axis=0).max()), 1e-9)
    p = np.vstack([(points - centre) / span, [[-60.0, -40.0], [60.0, -40.0], [0.0, 80.0]]])
    tri = np.array([[n, n + 1, n + 2]])
    circle = _circles(p, tri)
    for i in np.lexsort((points[:, 1], points[:, 0])):
        bad = ((circle[:, :2] - p[i]) ** 2).sum(1) < circle[:, 2] * (1 - 1e-12)
        edges = np.sort(tri[bad][:, [[0, 1], [1, 2], [2, 0]]].reshape(-1, 2), axis=1)
        kept, counts = np.unique(edges, axis=0, return_counts=True)
        new = np.column_stack([kept[counts == 1], np.full((counts == 1).sum(), i)])
        a, b, c = p[new[:, 0]], p[new[:, 1]], p[new[:, 2]]
        area = (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])
        new = new[np.abs(area) > 1e-14]
        tri, circle = np.vstack([tri[~bad], new]), np.vstack([circle[~bad], _circles(p, new)])
    return tri[(tri < n).all(1)]


def _circles(p: np.ndarray, tri: np.ndarray) -> np.ndarray:
    """Centre and squared radius of the circle through each triangle's corners."""
    a, b, c = p[tri[:, 0]], p[tri[:, 1]], p[tri[:, 2]]
    b, c = b - a, c - a
    d = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
    d = np.where(d == 0, 1e-300, d)
    bb, cc = (b**2).sum(1), (c**2).sum(1)
    u = np.column_stack([(c[:, 1] * bb - b[:, 1] * cc) / d, (b[:, 0] * cc - c[:, 0] * bb) / d])
    return np.column_stack([a + u, (u**2).sum(1)])


TRIANGLES = "ind_id long, part_id int, " + ", ".join(f"{a}{i} double" for i in range(3) for a in "xy")


def triangulated(members: DataFrame, scale: float) -> DataFrame:
    """Triangles of the members (ind_id, x, y) whose longest side is below two scales, with the part that
    triangles sharing a side form. Members are at most the sampled number, so a group fits a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        points = np.unique(pdf[["x", "y"]].to_numpy(float), axis=0)
        tri = delaunay(points)
        corner = points[tri]
        longest = np.sqrt(((corner - np.roll(corner, 1, axis=1)) ** 2).sum(2)).max(1) if len(tri) else np.zeros(0)
        tri, corner = tri[longest < 2 * scale], corner[longest < 2 * scale]
        part = np.arange(len(tri))
        sides: dict[tuple[int, int], int] = {}

        def find(i):
            while part[i] != i:
                i = part[i]
            return i

        for t, (a, b, c) in enumerate(tri.tolist()):
            for e in ((a, b), (b, c), (a, c)):
                other = sides.setdefault(tuple(sorted(e)), t)
                one, two = find(other), find(t)
                part[max(one, two)] = min(one, two)
        roots = np.unique([find(i) for i in range(len(tri))], return_inverse=True)[1] if len(tri) else np.zeros(0, int)
        return pd.DataFrame({"ind_id": pdf["ind_id"].iloc[0], "part_id": roots, **{f"{a}{i}": corner[:, i, k] for i in range(3) for k, a in enumerate("xy")}}, index=range(len(tri)))

    return members.groupBy("ind_id").applyInPandas(run, TRIANGLES)


def max_edge(x0: Column, y0: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.greatest(F.hypot(x0 - x1, y0 - y1), F.hypot(x1 - x2, y1 - y2), F.hypot(x2 - x0, y2 - y0))


def inside_triangles(samples: DataFrame, triangles: DataFrame, width: float) -> DataFrame:
    """(ind_id, part_id, sample_id) of the samples in closed triangles: an equi-join on squares of ``width``, into
    all of which that it touches a triangle is put."""
    square = lambda c: F.floor(c / width).cast("long")
    lo = {a: square(F.least(*[F.col(f"{a}{i}") for i in range(3)]) - 1e-9) for a in "xy"}
    hi = {a: square(F.greatest(*[F.col(f"{a}{i}") for i in range(3)]) + 1e-9) for a in "xy"}
    placed = triangles.withColumn("bx", F.explode(F.sequence(lo["x"], hi["x"]))).withColumn("by", F.explode(F.sequence(lo["y"], hi["y"])))
    own = samples.select("sample_id", "x", "y", square(F.col("x")).alias("bx"), square(F.col("y")).alias("by"))
    x, y = F.col("x"), F.col("y")
    turn = [(F.col(f"x{j}") - F.col(f"x{i}")) * (y - F.col(f"y{i}")) - (F.col(f"y{j}") - F.col(f"y{i}")) * (x - F.col(f"x{i}")) for i, j in ((0, 1), (1, 2), (2, 0))]
    inside = (F.least(*turn) >= -1e-12) | (F.greatest(*turn) <= 1e-12)
    return own.join(placed, ["bx", "by"]).where(inside).select("ind_id", "part_id", "sample_id").distinct()
