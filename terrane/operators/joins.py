"""Interval and neighbour joins without nested loops."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.operators import neighbours
from terrane.operators.embedding import HELD_POINTS


def overlapping(s1: Column, e1: Column, s2: Column, e2: Column, closed: bool = False) -> Column:
    """Half-open intervals by default; a set-2 interval without length counts where it begins inside set 1's."""
    if closed:
        return ((s1 <= s2) & (s2 <= e1)) | ((s2 < s1) & (s1 <= e2))
    return ((s1 <= s2) & (s2 < e1)) | ((s2 < s1) & (s1 < e2))


def overlap_intervals(left: DataFrame, right: DataFrame, width: float, closed: bool = False, sort: bool = False) -> DataFrame:
    """(id1, id2) of overlapping intervals of (id1, start1, end1) and (id2, start2, end2).

    Every interval goes into each stretch of ``width`` that it touches and the stretches are equi-joined; a pair is
    kept in the first stretch that both are in. ``width`` near the usual length keeps both copies and partners few.
    """
    stretch = lambda c: F.floor(c / width).cast("long")
    spread = lambda df, n: df.withColumn(f"first{n}", stretch(F.col(f"start{n}"))).withColumn("stretch", F.explode(F.sequence(F.col(f"first{n}"), F.greatest(stretch(F.col(f"end{n}")), F.col(f"first{n}")))))
    both = spread(left, 1).join(spread(right, 2), "stretch").where(F.col("stretch") == F.greatest("first1", "first2"))
    out = both.where(overlapping(F.col("start1"), F.col("end1"), F.col("start2"), F.col("end2"), closed)).select("id1", "id2")
    return out.orderBy("id1", "id2") if sort else out


def arange_multi(df: DataFrame, start: str, stop: str, out: str = "value") -> DataFrame:
    """A row for each integer from start up to, not including, stop; none where stop is not larger."""
    numbers = F.when(F.col(stop) > F.col(start), F.sequence(F.col(start), F.col(stop) - 1)).otherwise(F.array())
    return df.withColumn(out, F.explode(numbers))


def nearest(samples: DataFrame, k: int) -> DataFrame:
    """(src, dst, distance): the k nearest other samples of each, smaller ids first among equals."""
    n = samples.count()
    kind = samples.schema["sample_id"].dataType.simpleString()
    if n <= HELD_POINTS:
        held = samples.select("sample_id", "x", "y").toPandas().sort_values("sample_id")
        shared = samples.sparkSession.sparkContext.broadcast((held["sample_id"].to_numpy(), held["x"].to_numpy(float), held["y"].to_numpy(float)))

        def near(frames):
            ids, x, y = shared.value
            for pdf in frames:
                for lo in range(0, len(pdf), 256):
                    part = pdf.iloc[lo : lo + 256]
                    d = np.hypot(part["x"].to_numpy(float)[:, None] - x, part["y"].to_numpy(float)[:, None] - y)
                    d[part["sample_id"].to_numpy()[:, None] == ids] = np.inf
                    pick = np.argsort(d, axis=1, kind="stable")[:, : min(k, len(ids) - 1)]
                    yield pd.DataFrame({"src": np.repeat(part["sample_id"].to_numpy(), pick.shape[1]), "dst": ids[pick.ravel()], "distance": np.take_along_axis(d, pick, 1).ravel()})

        return samples.select("sample_id", "x", "y").mapInPandas(near, f"src {kind}, dst {kind}, distance double")
    return neighbours.nearest(samples, k)


def knn_graph(samples: DataFrame, k: int = 5) -> DataFrame:
    """(src, dst) of the k-nearest-neighbour graph, both ways."""
    edges = nearest(samples, k).select("src", "dst")
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def radius_graph(samples: DataFrame, radius: float = 1.0) -> DataFrame:
    """(src, dst) of the samples at most ``radius`` apart, both ways: squares of that width, each with its neighbours."""
    square = lambda c: F.floor(F.col(c) / radius).cast("long")
    own = samples.select("sample_id", "x", "y", square("x").alias("bx"), square("y").alias("by"))
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    other = own.select(F.col("sample_id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"), "bx", "by")
    other = other.withColumn("i", F.explode(around)).withColumn("j", F.explode(around)).select("dst", "x2", "y2", (F.col("bx") + F.col("i")).alias("bx"), (F.col("by") + F.col("j")).alias("by"))
    both = own.join(other, ["bx", "by"]).where((F.col("sample_id") != F.col("dst")) & (F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")) <= radius))
    return both.select(F.col("sample_id").alias("src"), "dst")
