"""Scale, grid and density of an embedding: samples(sample_id, x, y)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators import neighbours

#: Up to so many points (16 bytes each) every task has all of them; beyond, they are dealt into leaves of a tree.
HELD_POINTS = 20_000
GRID = 100


def neighbour_distances(samples: DataFrame, k: int, n: int) -> DataFrame:
    """(sample_id, distance) to the k-th nearest other sample."""
    spark = samples.sparkSession
    if n <= HELD_POINTS:
        held = samples.select("sample_id", "x", "y").toPandas()
        shared = spark.sparkContext.broadcast((held["sample_id"].to_numpy(), held["x"].to_numpy(float), held["y"].to_numpy(float)))

        def near(frames):
            ids, x, y = shared.value
            for pdf in frames:
                for lo in range(0, len(pdf), 256):
                    part = pdf.iloc[lo : lo + 256]
                    d = np.hypot(part["x"].to_numpy(float)[:, None] - x, part["y"].to_numpy(float)[:, None] - y)
                    d[part["sample_id"].to_numpy()[:, None] == ids] = np.inf
                    yield pd.DataFrame({"sample_id": part["sample_id"], "distance": np.partition(d, k - 1, axis=1)[:, k - 1]})

        kind = samples.schema["sample_id"].dataType.simpleString()
        return samples.select("sample_id", "x", "y").mapInPandas(near, f"sample_id {kind}, distance double")
    return neighbours.kth_distances(samples, k)


def embedding_scale(samples: DataFrame, factor: float = 1.0) -> float:
    """Median distance to the k-th neighbour, k the root of the number of samples, times ``factor``."""
    n = samples.count()
    k = int(np.floor(np.sqrt(n)))
    if n < 2 or not k:
        return 0.0
    return neighbour_distances(samples, min(k, n - 1), n).agg(F.percentile("distance", F.lit(0.5))).first()[0] * factor


@dataclass(frozen=True)
class Grid:
    """Evenly spaced ticks around the samples: where they begin, how far apart, and how many an axis has."""

    x0: float
    y0: float
    dx: float
    dy: float
    n: int = GRID

    @staticmethod
    def around(samples: DataFrame, scale: float, n: int = GRID) -> Grid:
        """A border of three scales, at least a twentieth of the range."""
        lo_x, hi_x, lo_y, hi_y = samples.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        bx, by = max(0.05 * (hi_x - lo_x), 3 * scale), max(0.05 * (hi_y - lo_y), 3 * scale)
        return Grid(lo_x - bx, lo_y - by, (hi_x - lo_x + 2 * bx) / (n - 1), (hi_y - lo_y + 2 * by) / (n - 1), n)

    def place(self, samples: DataFrame) -> DataFrame:
        """sample_id, the cell (gx, gy) and the place in it (fx, fy)."""
        u, v = (F.col("x") - self.x0) / self.dx, (F.col("y") - self.y0) / self.dy
        last = F.lit(self.n - 2)
        gx, gy = F.least(F.floor(u).cast("int"), last), F.least(F.floor(v).cast("int"), last)
        return samples.select("sample_id", gx.alias("gx"), gy.alias("gy"), (u - gx).alias("fx"), (v - gy).alias("fy"))


def grid_ticks(samples: DataFrame, grid: Grid) -> DataFrame:
    spark = samples.sparkSession
    return spark.range(grid.n).select(F.col("id").cast("int").alias("g"), (F.lit(grid.x0) + F.col("id") * grid.dx).alias("x"), (F.lit(grid.y0) + F.col("id") * grid.dy).alias("y"))


def binned(samples: DataFrame, grid: Grid, weights: DataFrame | None = None) -> DataFrame:
    """(ind_id, gx, gy, w): linear binning, every sample shared among the corners of its cell. ``weights``:
    (ind_id, sample_id) or with a column w; without it all samples count as one indicator 0."""
    placed = grid.place(samples)
    if weights is None:
        placed = placed.withColumns({"ind_id": F.lit(0).cast("long"), "w": F.lit(1.0)})
    else:
        weights = weights if "w" in weights.columns else weights.withColumn("w", F.lit(1.0))
        placed = placed.join(weights, "sample_id")
    corner = lambda i, j: F.struct((F.col("gx") + i).alias("gx"), (F.col("gy") + j).alias("gy"), (F.col("w") * (F.col("fx") if i else 1 - F.col("fx")) * (F.col("fy") if j else 1 - F.col("fy"))).alias("w"))
    parts = placed.select("ind_id", F.explode(F.array(corner(0, 0), corner(1, 0), corner(0, 1), corner(1, 1))).alias("c"))
    return parts.groupBy("ind_id", F.col("c.gx").alias("gx"), F.col("c.gy").alias("gy")).agg(F.sum("c.w").alias("w")).where(F.col("w") > 0)


KERNELS = {
    "gaussian": lambda u: np.exp(-0.5 * u * u),
    "exponential": lambda u: np.exp(-u),
    "box": lambda u: (u <= 1).astype(float),
    "tri": lambda u: np.clip(1 - u, 0, None),
    "epa": lambda u: np.clip(1 - u * u, 0, None),
    "biweight": lambda u: np.clip(1 - u * u, 0, None) ** 2,
    "triweight": lambda u: np.clip(1 - u * u, 0, None) ** 3,
    "tricube": lambda u: np.clip(1 - u**3, 0, None) ** 3,
    "cosine": lambda u: np.where(u <= 1, np.cos(np.clip(u, 0, 1) * np.pi / 2), 0.0),
}
#: Width of each kernel in its standard deviations (along one axis), so that a bandwidth means the same for all.
WIDTHS = {"gaussian": 1.0, "exponential": 2**-0.5, "box": 3**0.5, "tri": 6**0.5, "epa": 5**0.5, "biweight": 7**0.5, "triweight": 3.0, "tricube": (243 / 35) ** 0.5, "cosine": (1 - 8 / np.pi**2) ** -0.5}


def smooth(weights: np.ndarray, grid: Grid, bandwidth: float, kernel: str = "gaussian") -> np.ndarray:
    """Weights on the grid (first axis x) convolved with the kernel; not normalised."""
    g = np.arange(grid.n)
    if kernel == "gaussian":
        kx = np.exp(-0.5 * ((g[:, None] - g) * grid.dx / bandwidth) ** 2)
        ky = np.exp(-0.5 * ((g[:, None] - g) * grid.dy / bandwidth) ** 2)
        return kx @ weights @ ky.T
    far = np.arange(-grid.n + 1, grid.n)
    u = np.hypot(far[:, None] * grid.dx, far * grid.dy) / (bandwidth * WIDTHS[kernel])
    size = 4 * grid.n
    spectrum = np.fft.rfft2(KERNELS[kernel](u), (size, size)) * np.fft.rfft2(weights, (size, size))
    full = np.fft.irfft2(spectrum, (size, size))
    return np.clip(full[grid.n - 1 : 2 * grid.n - 1, grid.n - 1 : 2 * grid.n - 1], 0, None)


def as_matrix(pdf: pd.DataFrame, grid: Grid) -> np.ndarray:
    out = np.zeros((grid.n, grid.n))
    out[pdf["gx"].to_numpy(), pdf["gy"].to_numpy()] = pdf["w"].to_numpy()
    return out


def density(bins: DataFrame, grid: Grid, bandwidth: float, kernel: str = "gaussian") -> DataFrame:
    """(ind_id, gx, gy, z, z_sum, z_max): smoothed weights, and scaled to a sum and to a maximum of one. A group is
    one grid, whatever the number of samples."""
    if kernel not in KERNELS:
        raise ValueError(f"kernel must be one of {sorted(KERNELS)}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z = smooth(as_matrix(pdf, grid), grid, bandwidth, kernel)
        gx, gy = np.indices(z.shape)
        return pd.DataFrame({"ind_id": pdf["ind_id"].iloc[0], "gx": gx.ravel(), "gy": gy.ravel(), "z": z.ravel(), "z_sum": (z / z.sum()).ravel(), "z_max": (z / z.max()).ravel()})

    return bins.groupBy("ind_id").applyInPandas(run, "ind_id long, gx int, gy int, z double, z_sum double, z_max double")
