"""Areas, outlines and hulls of density regions, worked out cell by cell."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators.embedding import Grid

#: Corners of a cell in the order around it.
AROUND = ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))


def area(points: np.ndarray) -> float:
    """Signed area of a polygon; positive if its points run anticlockwise."""
    if len(points) < 3:
        return 0.0
    x, y = points[:, 0], points[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def centroid(points: np.ndarray) -> np.ndarray:
    x, y = points[:, 0], points[:, 1]
    cross = x * np.roll(y, -1) - np.roll(x, -1) * y
    total = cross.sum()
    if abs(total) < 1e-300:
        return points.mean(0)
    return np.array([((x + np.roll(x, -1)) * cross).sum(), ((y + np.roll(y, -1)) * cross).sum()]) / (3 * total)


def cell_polygons(z: tuple[float, float, float, float], level: float) -> list[np.ndarray]:
    """What of a unit cell lies above the level, as convex polygons; z by corner in the order around the cell. An
    ambiguous cell whose mean is not above the level has two."""
    up = [v > level for v in z]
    if up == [True, False, True, False] or up == [False, True, False, True]:
        if sum(z) / 4 <= level:
            return [_corner(z, i, level) for i in range(4) if up[i]]
    out = []
    for i in range(4):
        j = (i + 1) % 4
        if up[i]:
            out.append(AROUND[i])
        if up[i] != up[j]:
            out.append(_crossing(z, i, j, level))
    return [np.array(out)] if len(out) > 2 else []


def _crossing(z, i: int, j: int, level: float) -> tuple[float, float]:
    t = (z[i] - level) / (z[i] - z[j])
    (a, b), (c, d) = AROUND[i], AROUND[j]
    return (a + (c - a) * t, b + (d - b) * t)


def _corner(z, i: int, level: float) -> np.ndarray:
    return np.array([AROUND[i], _crossing(z, i, (i + 1) % 4, level), _crossing(z, i, (i - 1) % 4, level)])


def clip(polygon: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The part of a polygon inside a convex, anticlockwise window."""
    for a, b in zip(window, np.roll(window, -1, axis=0)):
        if not len(polygon):
            break
        side = (b[0] - a[0]) * (polygon[:, 1] - a[1]) - (b[1] - a[1]) * (polygon[:, 0] - a[0])
        kept = []
        for p, s, q, t in zip(polygon, side, np.roll(polygon, -1, axis=0), np.roll(side, -1)):
            if s >= 0:
                kept.append(p)
            if (s > 0) != (t > 0) and s != t and s * t < 0:
                kept.append(p + (q - p) * (s / (s - t)))
        polygon = np.array(kept).reshape(-1, 2)
    return polygon


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, anticlockwise."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def half(order):
        out: list[np.ndarray] = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(points) + half(points[::-1]))


def _corners(row: pd.DataFrame, suffix: str = "") -> np.ndarray:
    return row[[f"z00{suffix}", f"z10{suffix}", f"z11{suffix}", f"z01{suffix}"]].to_numpy(float)


def region_areas(cells: DataFrame, grid: Grid, level: float = 0.25) -> DataFrame:
    """(ind_id, area) of density regions."""

    def run(frames):
        for pdf in frames:
            own = [sum(area(p) for p in cell_polygons(tuple(z), level)) for z in _corners(pdf)]
            yield pd.DataFrame({"ind_id": pdf["ind_id"], "area": np.array(own, float) * grid.dx * grid.dy})

    return cells.mapInPandas(run, "ind_id long, area double").groupBy("ind_id").agg(F.sum("area").alias("area"))


def intersection_areas(cells: DataFrame, grid: Grid, level: float = 0.25) -> DataFrame:
    """(a, b, area_a, area_b, area) of the pairs of regions, a < b: cells at one place are clipped with each other."""
    corner = [f"z{c}" for c in ("00", "10", "01", "11")]
    left = cells.select(F.col("ind_id").alias("a"), "gx", "gy", *corner)
    right = cells.select(F.col("ind_id").alias("b"), "gx", "gy", *[F.col(c).alias(f"{c}_b") for c in corner])
    both = left.join(right, ["gx", "gy"]).where(F.col("a") < F.col("b"))

    def run(frames):
        for pdf in frames:
            own = []
            for za, zb in zip(_corners(pdf), _corners(pdf, "_b")):
                own.append(sum(max(0.0, area(clip(p, q))) for p in cell_polygons(tuple(za), level) for q in cell_polygons(tuple(zb), level)))
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "area": np.array(own, float) * grid.dx * grid.dy})

    common = both.mapInPandas(run, "a long, b long, area double").groupBy("a", "b").agg(F.sum("area").alias("area"))
    own = region_areas(cells, grid, level)
    every = own.select(F.col("ind_id").alias("a"), F.col("area").alias("area_a")).crossJoin(own.select(F.col("ind_id").alias("b"), F.col("area").alias("area_b"))).where(F.col("a") < F.col("b"))  # regions, not samples
    return every.join(common, ["a", "b"], "left").select("a", "b", "area_a", "area_b", F.coalesce("area", F.lit(0.0)).alias("area"))


def area_metrics(areas: DataFrame) -> DataFrame:
    """Adds intersection_percentage (of the smaller region), iou and iou_dist."""
    least, union = F.least("area_a", "area_b"), F.col("area_a") + F.col("area_b") - F.col("area")
    iou = F.when(union > 0, F.col("area") / union).otherwise(0.0)
    return areas.withColumns({"intersection_percentage": F.when(least > 0, F.col("area") / least).otherwise(0.0), "iou": iou, "iou_dist": 1 - iou})


def outlines(cells: DataFrame, grid: Grid, level: float = 0.25) -> DataFrame:
    """(ind_id, part_id, ring, hole, area, cx, cy, points array<struct<x,y>>): the borders of every part, holes
    clockwise. A group is one region's cells, whatever the number of samples."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        follow: dict[tuple, list[tuple]] = defaultdict(list)
        part: dict[tuple, int] = {}
        inside = set(zip(pdf["gx"].tolist(), pdf["gy"].tolist()))
        for gx, gy, z, p in zip(pdf["gx"].tolist(), pdf["gy"].tolist(), _corners(pdf), pdf[["p00", "p10", "p11", "p01"]].to_numpy()):
            for polygon in cell_polygons(tuple(z), level):
                at = [(round(gx + x, 9), round(gy + y, 9)) for x, y in polygon]
                for (x0, y0), (x1, y1) in zip(at, at[1:] + at[:1]):
                    side = (x0 == x1 and x0 in (gx, gx + 1)) or (y0 == y1 and y0 in (gy, gy + 1))
                    if side and _neighbour(gx, gy, x0, y0, x1, y1) in inside:
                        continue  # goes on in the next cell
                    if (x0, y0) != (x1, y1):
                        follow[(x0, y0)].append((x1, y1))
                        part[(x0, y0)] = int(p.max())
        rows = []
        while follow:
            start = now = next(iter(follow))
            points, own = [], part[start]
            while now in follow:
                points.append(now)
                after = follow[now].pop()
                if not follow[now]:
                    del follow[now]
                now = after
                if now == start:
                    break
            xy = np.array(points) * [grid.dx, grid.dy] + [grid.x0, grid.y0]
            size = area(xy)
            if len(points) > 2:
                c = centroid(xy)
                rows.append((own, size < 0, abs(size), c[0], c[1], [{"x": float(x), "y": float(y)} for x, y in xy]))
        out = pd.DataFrame(rows, columns=["part_id", "hole", "area", "cx", "cy", "points"])
        out.insert(0, "ind_id", pdf["ind_id"].iloc[0])
        out.insert(2, "ring", range(len(out)))
        return out

    return cells.groupBy("ind_id").applyInPandas(run, "ind_id long, part_id int, ring int, hole boolean, area double, cx double, cy double, points array<struct<x:double,y:double>>")


def _neighbour(gx: int, gy: int, x0: float, y0: float, x1: float, y1: float) -> tuple[int, int]:
    if x0 == x1:
        return (gx - 1, gy) if x0 == gx else (gx + 1, gy)
    return (gx, gy - 1) if y0 == gy else (gx, gy + 1)


def anchors(rings: DataFrame) -> DataFrame:
    """(ind_id, x, y): centroid of every region's largest part."""
    return rings.where(~F.col("hole")).groupBy("ind_id").agg(F.max_by("cx", "area").alias("x"), F.max_by("cy", "area").alias("y"))


def hull_ratio(areas: DataFrame, rings: DataFrame) -> DataFrame:
    """(a, b, ratio): of the hull around two regions the share that is in neither one's own hull, over that and the
    regions themselves."""
    points = rings.where(~F.col("hole")).groupBy("ind_id").agg(F.flatten(F.collect_list("points")).alias("points"))
    both = areas.join(points.select(F.col("ind_id").alias("a"), F.col("points").alias("pa")), "a").join(points.select(F.col("ind_id").alias("b"), F.col("points").alias("pb")), "b")

    def run(frames):
        for pdf in frames:
            ratio = []
            for pa_, pb, a, b, i in zip(pdf["pa"], pdf["pb"], pdf["area_a"], pdf["area_b"], pdf["area"]):
                one, two = (hull(np.array([(p["x"], p["y"]) for p in q])) for q in (pa_, pb))
                between = area(hull(np.vstack((one, two)))) - area(one) - area(two) + max(0.0, area(clip(one, two)))
                between = max(0.0, between)
                ratio.append(between / (between + a + b - i))
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "ratio": np.array(ratio, float)})

    return both.mapInPandas(run, "a long, b long, ratio double")
