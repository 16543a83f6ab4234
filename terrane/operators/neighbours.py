"""Exact nearest neighbours in the plane for any number of samples, without a join of all pairs.

Equal points are one point that lists its smallest ids. A k-d tree over a bounded sample deals the points into
leaves. Within its leaf every point finds a distance that its k nearest cannot exceed; it then asks the leaves that
a circle of that radius reaches, and the best answers of all of them are its neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.sources.ingest import sample_exact
from terrane.sources.shared import settled

#: Points of a leaf, about, and what the tree is built from at most.
LEAF, TREE_POINTS = 4096, 200_000
#: Distances that a task merges, about.
MERGED = 4_000_000
_ROWS = 256


@dataclass
class Tree:
    """Inner nodes: axis, split and children; a child below zero is the leaf -1 - child. Up to the split is left."""

    axis: np.ndarray
    split: np.ndarray
    child: np.ndarray
    leaves: int

    @staticmethod
    def over(points: np.ndarray, leaves: int) -> Tree:
        axis, split, child = [], [], []
        count = 0

        def grow(own: np.ndarray, wanted: int) -> int:
            nonlocal count
            spans = np.ptp(own, axis=0) if len(own) else np.zeros(2)
            a = int(np.argmax(spans))
            if wanted < 2 or len(own) < 2 or not spans[a] > 0:
                count += 1
                return -count
            values = np.sort(own[:, a])
            at = values[(len(values) - 1) // 2]
            if at == values[-1]:
                at = values[values < at][-1]
            node = len(axis)
            axis.append(a)
            split.append(at)
            child.append([0, 0])
            low = own[:, a] <= at
            child[node][0] = grow(own[low], wanted - wanted // 2)
            child[node][1] = grow(own[~low], wanted // 2)
            return node

        grow(points, leaves)
        return Tree(np.array(axis, int), np.array(split, float), np.array(child, int).reshape(-1, 2), count)

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.full(len(points), 0 if len(self.axis) else -1)
        while (inner := np.flatnonzero(node >= 0)).size:
            at = node[inner]
            right = points[inner, self.axis[at]] > self.split[at]
            node[inner] = self.child[at, right.astype(int)]
        return -1 - node

    def reached(self, points: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the point, leaf) for every leaf that its circle reaches."""
        row, node = np.arange(len(points)), np.full(len(points), 0 if len(self.axis) else -1)
        rows, leaves = [], []
        while len(row):
            done = node < 0
            rows.append(row[done])
            leaves.append(-1 - node[done])
            row, node = row[~done], node[~done]
            value, split = points[row, self.axis[node]], self.split[node]
            left, right = value - radius[row] <= split, value + radius[row] >= split
            row, node = np.concatenate((row[left], row[right])), np.concatenate((self.child[node[left], 0], self.child[node[right], 1]))
        return np.concatenate(rows), np.concatenate(leaves)


def _xy(pdf: pd.DataFrame) -> np.ndarray:
    return pdf[["x", "y"]].to_numpy(float)


def _apart(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return np.hypot(one[:, None, 0] - two[:, 0], one[:, None, 1] - two[:, 1])


def _dealt(points: DataFrame, n: int, leaf: int) -> tuple[Broadcast, DataFrame]:
    """The tree over ``n`` points (least, x, y, ...), and the points with their leaf."""
    wanted = min(-(-n // leaf), TREE_POINTS // 16)
    held = sample_exact(points.select("least", "x", "y"), TREE_POINTS if wanted > 1 else 1, "least").toPandas()
    tree = points.sparkSession.sparkContext.broadcast(Tree.over(_xy(held), wanted))

    def place(frames):
        for pdf in frames:
            yield pdf.assign(leaf=tree.value.leaf(_xy(pdf)).astype(np.int32))

    own = points.drop("ids")
    kinds = ", ".join(f"{name} {kind}" for name, kind in own.dtypes)
    return tree, settled(own.mapInPandas(place, f"{kinds}, leaf int"))


def nearest(samples: DataFrame, k: int, leaf: int = LEAF) -> DataFrame:
    """(src, dst, distance): the k nearest other samples of each, smaller ids first among equals."""
    kind = samples.schema["sample_id"].dataType.simpleString()
    own = samples.select("sample_id", "x", "y")
    ranked = own.withColumn("rank", F.row_number().over(W.partitionBy("x", "y").orderBy("sample_id"))).where(F.col("rank") <= k + 1)
    points = settled(ranked.groupBy("x", "y").agg(F.array_sort(F.collect_list("sample_id")).alias("ids")).withColumn("least", F.element_at("ids", 1)))
    tree, placed = _dealt(points, points.count(), max(leaf, 4 * (k + 1)))

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        xy = _xy(pdf)
        radius = np.full(len(xy), np.inf)
        for lo in range(0, len(xy), _ROWS) if len(xy) > k else ():
            radius[lo : lo + _ROWS] = np.partition(_apart(xy[lo : lo + _ROWS], xy), k, axis=1)[:, k]  # its own distance is among them
        row, reached = tree.value.reached(xy, radius * (1 + 1e-12))
        return pd.DataFrame({"asker": pdf["least"].to_numpy()[row], "x": xy[row, 0], "y": xy[row, 1], "leaf": reached.astype(np.int32)})

    asked = placed.groupBy("leaf").applyInPandas(bound, f"asker {kind}, x double, y double, leaf int")

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("least").reset_index(drop=True)  # so that among equals the smaller id comes first
        xy, names = _xy(right), right["least"].to_numpy()
        out = []
        for lo in range(0, len(left), _ROWS) if len(right) else ():
            part = left.iloc[lo : lo + _ROWS]
            d = _apart(_xy(part), xy)
            d[part["asker"].to_numpy()[:, None] == names] = np.inf
            pick = np.argsort(d, axis=1, kind="stable")[:, :k]
            far = np.take_along_axis(d, pick, 1).ravel()
            fine = np.isfinite(far)
            out.append(pd.DataFrame({"asker": np.repeat(part["asker"].to_numpy(), pick.shape[1])[fine], "least": names[pick.ravel()][fine], "distance": far[fine]}))
        return pd.concat(out) if out else pd.DataFrame({"asker": [], "least": [], "distance": []})

    near = asked.groupBy("leaf").cogroup(placed.groupBy("leaf")).applyInPandas(answer, f"asker {kind}, least {kind}, distance double")
    near = near.withColumn("rank", F.row_number().over(W.partitionBy("asker").orderBy("distance", "least"))).where(F.col("rank") <= k)
    # the ids at every point found, and those at the point itself
    with_ids = near.join(points.select("least", "ids"), "least").select("asker", "distance", "ids")
    every = with_ids.unionByName(points.select(F.col("least").alias("asker"), F.lit(0.0).alias("distance"), "ids"))
    listed = every.select("asker", "distance", F.explode("ids").alias("dst"))
    listed = listed.withColumn("rank", F.row_number().over(W.partitionBy("asker").orderBy("distance", "dst"))).where(F.col("rank") <= k + 1)
    found = listed.groupBy("asker").agg(F.array_sort(F.collect_list(F.struct("distance", "dst"))).alias("near"))
    found = settled(found.join(points.select(F.col("least").alias("asker"), "x", "y"), "asker").select("x", "y", "near"))
    each = own.join(found, ["x", "y"]).withColumn("near", F.slice(F.filter("near", lambda s: s["dst"] != F.col("sample_id")), 1, k))
    return each.select(F.col("sample_id").alias("src"), F.explode("near").alias("n")).select("src", "n.dst", "n.distance")


def _kth(d: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """For every row of distances the least within which the points weigh more than k; infinite if all weigh less."""
    if weight.sum() <= k:
        return np.full(len(d), np.inf)
    if (weight == 1).all():
        return np.partition(d, k, axis=1)[:, k]
    order = np.argsort(d, axis=1)
    first = (np.cumsum(weight[order], axis=1) > k).argmax(axis=1)
    return np.take_along_axis(d, np.take_along_axis(order, first[:, None], 1), 1)[:, 0]


def kth_distances(samples: DataFrame, k: int, leaf: int = LEAF) -> DataFrame:
    """(sample_id, distance) to the k-th nearest other sample, the last one where there are fewer.

    Most points are done with within their leaf. Of the others every leaf that the circle reaches returns one row
    with the distances within it, and no neighbours are listed.
    """
    kind = samples.schema["sample_id"].dataType.simpleString()
    own = samples.select("sample_id", "x", "y")
    points = settled(own.groupBy("x", "y").agg(F.min("sample_id").alias("least"), F.least(F.count(F.lit(1)), F.lit(k + 1)).cast("int").alias("weight")))
    n = points.count()
    tree, placed = _dealt(points, n, max(leaf, 4 * (k + 1)))
    # as many partitions as leaves: their few bytes would else fall together into one task
    leaves = placed.repartition(tree.value.leaves, "leaf")

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        xy, weight = _xy(pdf), pdf["weight"].to_numpy()
        radius = np.concatenate([_kth(_apart(xy[lo : lo + _ROWS], xy), weight, k) for lo in range(0, len(xy), _ROWS)])
        row, reached = tree.value.reached(xy, radius * (1 + 1e-12))
        alone = (np.bincount(row, minlength=len(xy)) == 1) & np.isfinite(radius)
        reached = np.where(alone[row], -1, reached)
        return pd.DataFrame({"asker": pdf["least"].to_numpy()[row], "x": xy[row, 0], "y": xy[row, 1], "radius": radius[row], "leaf": reached.astype(np.int32)})

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        xy, weight = _xy(right), right["weight"].to_numpy()
        names, near, weights = [], [], []
        for lo in range(0, len(left), _ROWS) if len(right) else ():
            part = left.iloc[lo : lo + _ROWS]
            d = _apart(_xy(part), xy)
            within = d <= part["radius"].to_numpy()[:, None]
            for name, own_d, take in zip(part["asker"].to_numpy(), d, within):
                at = np.flatnonzero(take)
                if len(at) > k + 1:
                    at = at[np.argpartition(own_d[at], k)[: k + 1]]
                if len(at):
                    names.append(name)
                    near.append(own_d[at])
                    weights.append(weight[at])
        return pd.DataFrame({"asker": names, "near": pd.Series(near, dtype=object), "weights": pd.Series(weights, dtype=object)})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        names, asker = np.unique(pdf["asker"].to_numpy(), return_inverse=True)
        asker = np.repeat(asker, pdf["near"].map(len).to_numpy())
        d, weight = np.concatenate(pdf["near"].to_list()), np.concatenate(pdf["weights"].to_list()).astype(np.int64)
        order = np.lexsort((d, asker))
        asker, d, total = asker[order], d[order], np.cumsum(weight[order])
        start = np.searchsorted(asker, np.arange(len(names)))
        before = np.concatenate(([0], total))[start]
        less = np.add.reduceat((total - before[asker] <= k).astype(np.int64), start)
        last = np.append(start[1:], len(asker)) - 1
        return pd.DataFrame({"asker": names, "distance": d[np.minimum(start + less, last)]})

    asked = settled(leaves.groupBy("leaf").applyInPandas(bound, f"asker {kind}, x double, y double, radius double, leaf int"))
    done, open_ = asked.where(F.col("leaf") < 0).select("asker", F.col("radius").alias("distance")), asked.where(F.col("leaf") >= 0)
    near = open_.repartition(tree.value.leaves, "leaf").groupBy("leaf").cogroup(leaves.groupBy("leaf")).applyInPandas(answer, f"asker {kind}, near array<double>, weights array<int>")
    tasks = -(-n * 3 * k // MERGED)
    near = near.withColumn("task", F.pmod(F.hash("asker"), F.lit(tasks))).repartition(tasks, "task")
    found = done.unionByName(near.groupBy("task").applyInPandas(merge, f"asker {kind}, distance double"))
    found = settled(found.join(points.select(F.col("least").alias("asker"), "x", "y"), "asker").select("x", "y", "distance"))
    return own.join(found, ["x", "y"]).select("sample_id", "distance")
